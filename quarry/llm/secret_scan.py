"""Secret scans: rules for known shapes, and character Markov models for the rest.

Base rules find assignments, access keys and long hex numbers. What they leave is searched for runs of LEAST letters, digits and signs
or more, each scored by two models of characters given the two before: one of random strings, one of ordinary identifiers.
A run whose log-likelihood ratio is over `ratio`, and over `each` a character, is a span of kind `model`.

The models are trained here from labelled samples (samples()): random are the values that base rules find in sampled documents
and drawn strings of several alphabets; ordinary are the words of sampled documents in which no base rule finds any, and PROGRAM_WORDS, as they are and
joined to names. The sample's documents are those of least hash; this bound is on training alone, scans cover whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.llm.words import chunks

#: Base rules by kind: pattern, group whose length counts, and that length. Letters of keywords are in either case, of ASCII only.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Characters of the models; all others part what is scored.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of the least run that is scored.
LEAST = 16
#: Weight of the shorter context in a longer one's estimates.
BACK = 4.0
CHARS = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0 stands before the first
SIZE = len(ALPHABET) + 1
#: Finds texts that may hold a match, faster than the rules.
SIEVE = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|[A-Za-z0-9+/_=-]{{{LEAST}}}"""

# Words that names in programs are often made of.
PROGRAM_WORDS = [
    "abstract", "access", "account", "action", "address", "apache", "application", "array", "attribute", "base", "batch", "buffer",
    "builder", "button", "cache", "callback", "channel", "class", "client", "code", "collection", "column", "command", "component",
    "config", "connection", "container", "content", "context", "control", "controller", "count", "create", "current", "data", "database",
    "date", "default", "delete", "description", "device", "directory", "document", "download", "element", "email", "enable", "encoded",
    "error", "event", "exception", "execute", "factory", "field", "file", "filter", "format", "form", "frame", "function", "group", "handler",
    "header", "height", "host", "http", "identifier", "image", "index", "input", "instance", "integer", "interface", "internal", "item",
    "java", "javascript", "key", "label", "language", "length", "library", "limit", "link", "linux", "list", "listener", "local", "login",
    "manager", "max", "memory", "message", "method", "min", "model", "module", "name", "network", "node", "number", "object", "option",
    "order", "output", "package", "page", "parameter", "parser", "password", "path", "pattern", "policy", "position", "prefix", "process",
    "product", "profile", "project", "property", "provider", "proxy", "python", "query", "queue", "reader", "record", "reference",
    "register", "remote", "request", "resource", "response", "result", "retry", "role", "root", "schema", "script", "search", "secret",
    "security", "select", "server", "service", "session", "settings", "size", "source", "spark", "start", "state", "status", "storage",
    "stream", "string", "style", "system", "table", "target", "task", "template", "test", "text", "thread", "time", "timeout", "title",
    "token", "transaction", "tree", "type", "update", "upload", "user", "utility", "validator", "value", "variable", "vector", "version",
    "view", "visible", "width", "window", "with", "worker", "wrapper", "writer",
]


def compiled() -> dict[str, tuple[re.Pattern, int, int]]:
    return {kind: (re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in RULES.items()}


def base_spans(text: str, rules: dict[str, tuple[re.Pattern, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by kind: leftmost matches that don't overlap, of which short ones are dropped."""
    return [(kind, *m.span()) for kind, (p, group, least) in rules.items() for m in p.finditer(text) if m.end(group) - m.start(group) >= least]


@dataclass
class Models:
    """Log-likelihood ratio of each character given the two before, random over ordinary; and from where on a run is a secret."""

    table: np.ndarray
    ratio: float
    each: float

    def score(self, run: str) -> float:
        s = np.array([0, 0, *(CHARS[c] for c in run)])
        return float(self.table[s[:-2], s[1:-1], s[2:]].sum())

    def random(self, run: str) -> bool:
        score = self.score(run)
        return score >= self.ratio and score >= self.each * len(run)


def transitions(samples: DataFrame) -> DataFrame:
    """(random, a, b, c, n): how often character c follows a and b in samples (text, random), by its number in the alphabet; 0 before the first."""
    chars = F.split(F.concat(F.lit("\n\n"), F.col("text")), "")
    at = F.posexplode(F.transform(F.slice(chars, F.lit(3), F.size(chars)), lambda c, i: F.concat(F.get(chars, i), F.get(chars, i + 1), c)))
    rows = samples.select("random", at.alias("i", "t")).groupBy("random", "t").agg(F.count("*").alias("n"))
    number = lambda i: F.instr(F.lit(ALPHABET), F.substring("t", i, 1))
    return rows.select("random", number(1).alias("a"), number(2).alias("b"), number(3).alias("c"), "n")


def estimates(n: np.ndarray) -> np.ndarray:
    """Probabilities of characters given the two before, from counts n[a, b, c]: each context leans on the next shorter one by BACK."""
    p = np.full(SIZE - 1, 1 / (SIZE - 1))
    for axes in ((0, 1), (0,), ()):
        c = n.sum(axis=axes)[..., 1:]
        p = (c + BACK * p) / (c.sum(axis=-1, keepdims=True) + BACK)
    return p


def train(samples: DataFrame, ratio: float = 16.0, each: float = 1.5) -> Models:
    """Models from labelled samples (text, random), of ALPHABET's characters. What is collected has a row for three characters at most."""
    n = np.zeros((2, SIZE, SIZE, SIZE))
    for random, a, b, c, k in transitions(samples).collect():
        n[int(random), a, b, c] += k
    table = np.zeros((SIZE, SIZE, SIZE))
    table[:, :, 1:] = np.log(estimates(n[1])) - np.log(estimates(n[0]))
    return Models(table, ratio, each)


def drawn(spark: SparkSession, number: int, seed: int = 0) -> DataFrame:
    """(text): random strings of LEAST to LEAST + 40 characters, of hex digits, base 64 and its URL form, letters and digits, capitals and digits."""
    raw = F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512))
    # digests of digests, since a capital or a digit is one character in two
    wide = F.translate(F.base64(F.concat(raw, F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), "id", F.lit("more")), 512)))), "\r\n", "")
    kinds = [F.hex(raw), F.lower(F.hex(raw)), F.translate(wide, "=", ""), F.translate(F.translate(wide, "=", ""), "+/", "-_"), F.translate(wide, "+/=", ""), F.translate(wide, "+/=abcdefghijklmnopqrstuvwxyz", ""), F.upper(F.translate(wide, "+/=0189", ""))]
    which = F.element_at(F.array(*kinds), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    return spark.range(number).select(F.substring(which, F.lit(1), (LEAST + F.pmod(F.xxhash64("id"), F.lit(41))).cast("int")).alias("text"))


def names(words: DataFrame) -> DataFrame:
    """(text): the words (w, and next and third after it) as they are and joined to names as programs, paths and files have them; numbers and rules."""
    w, x, y = (F.regexp_replace(c, rf"[^{ALPHABET[:62]}]", "") for c in ("w", "next", "third"))
    low, hashed = F.lower, F.pmod(F.xxhash64("w", "next", "third"), F.lit(10**18))
    digits, number = (hashed % 10_000).cast("string"), hashed.cast("string")
    joined = [F.concat(low(w), F.initcap(x), F.initcap(y)), F.concat(F.initcap(w), F.initcap(x), F.initcap(y), F.initcap(w)), *[F.concat_ws(c, low(w), low(x), low(y), digits) for c in "_-"], F.concat_ws("/", w, x, y), F.upper(F.concat_ws("_", w, x, y)), F.concat_ws("=", low(w), x)]
    numbers = [number, F.concat(F.initcap(x), F.initcap(y), digits), F.concat_ws("-", F.lit("20"), digits, digits)]
    rules = [F.repeat(F.substring(number, 1, 1), 20), F.repeat(F.substring(F.lit("-_=+/"), (hashed % 5 + 1).cast("int"), F.lit(1)), 24), F.repeat(F.substring(w, 1, 1), 20), F.substring(F.lit(ALPHABET[:62] * 2), (hashed % 62 + 1).cast("int"), F.lit(24))]
    return words.select(F.explode(F.array(w, F.concat(w, x), *joined, *numbers, *rules)).alias("text")).where("text <> ''")


def common(spark: SparkSession, number: int) -> DataFrame:
    """(w, next, third): words of programs, three by three."""
    some = F.array(*[F.lit(x) for x in PROGRAM_WORDS])
    pick = lambda i: F.element_at(some, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PROGRAM_WORDS))) + 1).cast("int"))
    return spark.range(number).select(pick(0).alias("w"), pick(1).alias("next"), pick(2).alias("third"))


def samples(docs: DataFrame, documents: int = 400, words: int = 8_000, strings: int = 6_000, seed: int = 0) -> DataFrame:
    """(text, random): labelled strings from docs (text). documents, words: of the sample, those of least hash; strings: random ones drawn."""
    some = docs.where("text is not null").select("text").orderBy(F.xxhash64("text", F.lit(seed)), "text").limit(documents)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = compiled()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                spans, w = base_spans(text, rules), text.split()
                rows += [(re.split(rf"[^{ALPHABET}]", text[a:b])[-1], None, None, None) for _, a, b in spans]
                rows += [] if spans else [(None, *x) for x in zip(w, w[1:], w[2:])]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["found", "w", "next", "third"])

    parts = some.mapInArrow(split, "found string, w string, next string, third string")
    own = parts.where("w is not null").select("w", "next", "third").distinct().orderBy(F.xxhash64("w", "next", "third", F.lit(seed))).limit(words)
    random = parts.where("length(found) > 0").select(F.col("found").alias("text")).distinct().union(drawn(docs.sparkSession, strings, seed))
    return names(own.union(common(docs.sparkSession, words))).select("text", F.lit(False).alias("random")).union(random.select("text", F.lit(True).alias("random")))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """docs with spans, for each row: (kind, start, end) in code points, the end exclusive, by start, then kind as in RULES, `model` last.

    docs: text and any other columns; all but text come along in the struct `row`, whatever their names. Null and empty texts
    have no spans. Spans of the models don't overlap those of the rules; they are whole runs of ALPHABET's characters that are left
    between these, LEAST or more. Rows don't touch one another: repeated rows have equal spans, and nothing is shuffled. Memory is that of a chunk
    of rows, or of the longest text.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    docs = docs.select(rest, "text")
    order = {kind: i for i, kind in enumerate([*RULES, "model"])}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, run = compiled(), re.compile(f"[{ALPHABET}]{{{LEAST},}}")
        for batch in batches:
            for part in chunks(batch, "text"):
                text = part.column("text").fill_null("")
                some = np.flatnonzero(np.array(pc.match_substring_regex(text, SIEVE).cast(pa.uint8())))
                spans: list[list[tuple[str, int, int]]] = [[] for _ in range(part.num_rows)]
                for i, t in zip(some.tolist(), text.take(pa.array(some)).to_pylist(), strict=True):
                    own = base_spans(t, rules)
                    at = 0
                    for a, b in [*sorted(x[1:] for x in own), (len(t), len(t))]:
                        if a - at >= LEAST:
                            own += [("model", *m.span()) for m in run.finditer(t, at, a) if models.random(m.group())]
                        at = max(at, b)
                    spans[i] = sorted(own, key=lambda x: (x[1], order[x[0]]))
                yield pa.record_batch({"row": part.column("row"), "spans": pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in own] for own in spans], pa.list_(SPAN))})

    return docs.mapInArrow(find, StructType([StructField("row", docs.schema["row"].dataType), *StructType.fromDDL("spans array<struct<kind: string, start: long, end: long>>").fields]))


def secrets(docs: DataFrame, **sample: int) -> DataFrame:
    """scan() of docs (doc_id, text and any other columns) by models that are trained from samples of docs; sample: see samples()."""
    return scan(docs, train(samples(docs, **sample)))
