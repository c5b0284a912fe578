"""The queries op1 to op13: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.licenses import licenses_by_document
from quarry.llm.lm import lm_scores
from quarry.llm.mixing import mix_sources
from quarry.llm.chat import chat_windows, read_back
from quarry.llm.embedding_dedup import linked_vectors
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.packing import pack_documents
from quarry.llm.periodic import longest, periodic_runs, with_period
from quarry.llm.quality import quality_rules
from quarry.llm.secret_scan import secrets
from quarry.llm.substring_dedup import dedup_substrings
from quarry.llm.suffix_dedup import dedup_suffixes
from quarry.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: a document's words
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def repeats_sql(window: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d WHERE len(ws) >= {window})),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range({window}) AS t(o)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


ORACLES["op1_substring_dedup"] = repeats_sql(20)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents"), passage=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op5_suffix_array_dedup"] = repeats_sql(50)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=2048)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


ORACLES["op2_embedding_near_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach WHERE a = e.vec_id) AS kept
FROM embeddings e"""


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(chat_windows(rows, tokenizer_path("byte_bpe_50k.json")))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"), order=3, least=2, backoff=0.4)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


ORACLES["op9_lm_scoring"] = f"""
WITH word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
              FROM (SELECT doc_id, {WORDS} AS ws FROM documents)),
gram AS (SELECT doc_id, i, w, lag(w) OVER q AS v, lag(w, 2) OVER q AS u FROM word WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM gram GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM gram WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM gram WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
  SELECT g.doc_id,
    CASE WHEN c3.n >= 2 THEN ln(c3.n) - ln(h2.n)
         ELSE (CASE WHEN g.u IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END)
            + CASE WHEN c2.n >= 2 THEN ln(c2.n) - ln(h1.n)
                   ELSE (CASE WHEN g.v IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END)
                      + ln(c1.n) - ln((SELECT count(*) FROM gram)) END END AS s
  FROM gram g JOIN c1 ON g.w = c1.w LEFT JOIN c1 h1 ON g.v = h1.w
  LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN c2 h2 ON g.u = h2.v AND g.v = h2.w
  LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, round(coalesce(s.total, 0), 4) AS log_score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(s) AS total FROM scored GROUP BY doc_id) s ON d.doc_id = s.doc_id"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses_by_document(table(spark, sf_dir, "documents"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return out.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=16)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_period(table(spark, sf_dir, "documents")), least=6, periods=4)
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    out = out.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# Runs of 5 words at i and i + q: all of them next to one another, for one q, are a stretch of period q.
ORACLES["op13_periodic_runs"] = f"""
WITH h AS (SELECT doc_id, {WORDS} AS ws, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
p AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE ws[1:a] || list_transform(range(a, n), lambda i: ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))]) END AS ws FROM p),
gram AS (SELECT doc_id, n, i, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS k FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 6)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island),
run AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM stretch WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
           first({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q) AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
