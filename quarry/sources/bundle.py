"""Bundles: folders of Markdown files with frontmatter, as a table and back.

Files are read with Spark's text source (whole files, so small ones share a task, from any file system Spark knows), and frontmatter is
parsed in batches, one file at a time. Its schema is closed. A file that breaks it is no end of the read: its row keeps the path and the text
and says in `error` which rule it breaks. Writing is a Python data source, as Spark has none that names a file by its row.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quarry.functions.text import reserved
from quarry.sources.tables import TYPES

# The keys of frontmatter, in the order of a file, and the states of a concept.
KEYS = ["schema_version", "id", "type", "title", "status", "description", "aliases", "tags", "source_refs", "supersedes", "created_at", "updated_at", "updated_by"]
LISTS = ["aliases", "tags", "source_refs", "supersedes"]
TIMES = ["created_at", "updated_at"]
NEEDED = ["id", "type", "title", "created_at", "updated_at", "updated_by"]
STATES = ["active", "deprecated", "tombstone"]

LINE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*):(?:[ \t]+(.*))?")
ELEMENT = re.compile(r"""[ \t]*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,'"\s][^,]*?)[ \t]*(?:,|$)""")
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
INSTANT = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d(?:\.\d{1,6})?)\d*[ ]?([Zz]|[+-]\d\d:?\d\d)")
#: What YAML takes as it stands: a text that is no number, date, truth value or null, and holds no sign of its own.
PLAIN = r"\A[\p{L}_/(.][^\x00-\x1f\x7f:#'\"\[\]{},&*!|>%@`]*(?<![\p{Z}\x{85}])\z"
WORDS = ["true", "false", "yes", "no", "on", "off", "null", "y", "n", ".inf", ".nan"]
KINDS = {k: ArrayType(StringType()) for k in LISTS} | {k: LongType() for k in TIMES} | {"schema_version": IntegerType()}
PARSED = StructType([StructField(k, KINDS.get(k, StringType())) for k in ["error", *KEYS, "body"]])


class Broken(ValueError):
    """A rule of the schema that a file breaks."""


def body_text(text: Column) -> Column:
    """A body as a file holds it: line feeds alone, no blanks at the ends of lines, no empty lines around it."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?md)[^\S\n]+$", "")
    return F.regexp_replace(lines, r"\A\n+|\n+\z", "")


def unquoted(raw: str) -> str:
    """A scalar's text: JSON's escapes in double quotes, doubled quotes in single ones, else as it stands without a comment."""
    raw = raw.strip()
    if raw[:1] not in ("'", '"'):
        return re.split(r"[ \t]#|^#", raw, maxsplit=1)[0].rstrip()
    close = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')(?:[ \t]+#.*)?$""", raw)
    if not close:
        raise Broken("quotes")
    if raw[0] == "'":
        return close[1][1:-1].replace("''", "'")
    try:
        return json.loads(close[1], strict=False)
    except ValueError:
        raise Broken("quotes") from None


def flow_list(raw: str) -> list[str]:
    """The elements of [a, b]."""
    inner, at, out = raw[1:-1].strip(), 0, []
    while at < len(inner):
        found = ELEMENT.match(inner, at)
        if not found:
            raise Broken("list")
        out.append(unquoted(found[1]))
        at = found.end()
    return out


def micros(text: str) -> int:
    """Microseconds from 1970 to an instant, which has a zone."""
    found = INSTANT.fullmatch(text)
    try:
        moment = datetime.fromisoformat(f"{found[1]}T{found[2]}{found[3].upper()}") if found else None
    except ValueError:
        moment = None
    if moment is None:
        raise Broken("time")
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def document(text: str | None) -> dict:
    """One file's fields and body, or a dict of its error."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    ends = [i for i, x in enumerate(lines) if i and x.rstrip(" \t") == "---"] if lines[0].rstrip(" \t") == "---" else []
    if not ends:
        return {"error": "no_frontmatter"}
    raw: dict[str, str | list[str]] = {}
    key = None
    try:
        for line in lines[1 : ends[0]]:
            entry, item = LINE.fullmatch(line), re.fullmatch(r"[ \t]*-(?:[ \t]+(.*))?", line)
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if entry:
                key = entry[1]
                if key in raw:
                    raise Broken("repeated_key")
                raw[key] = (entry[2] or "").strip()
            elif item and key and raw[key] in ("", []) or item and key and isinstance(raw[key], list):
                raw[key] = [*raw[key], item[1] or ""]
            else:
                raise Broken("bad_line")
        if raw.keys() - set(KEYS):
            raise Broken("unknown_key")
        out: dict = {"schema_version": "1", "status": "active"} | {k: [] for k in LISTS}
        for k, x in raw.items():
            if k in LISTS:
                if isinstance(x, str) and x and not (x.startswith("[") and x.endswith("]")):
                    raise Broken("list")
                values = flow_list(x) if isinstance(x, str) else [unquoted(y) for y in x]
                out[k] = sorted({y for y in values if y})
            elif isinstance(x, list):
                raise Broken("list")
            elif x not in ("", "null", "~"):
                out[k] = unquoted(x)
        if any(k not in out for k in NEEDED):
            raise Broken("missing_key")
        if out["schema_version"] != "1":
            raise Broken("schema_version")
        if not all(out[k] for k in NEEDED):
            raise Broken("empty")
        if out["type"] not in TYPES:
            raise Broken("type")
        if out["status"] not in STATES:
            raise Broken("status")
        if CONTROL.search(out["title"]) or CONTROL.search(out["updated_by"]):
            raise Broken("control")
        return out | {"schema_version": 1, "body": "\n".join(lines[ends[0] + 1 :])} | {k: micros(out[k]) for k in TIMES}
    except Broken as e:
        return {"error": str(e)}


@F.pandas_udf(PARSED)
def documents(texts: pd.Series) -> pd.DataFrame:
    names = PARSED.names
    found = [document(t) for t in texts]
    return pd.DataFrame({n: pd.array([d.get(n) for d in found], dtype="Int64") if n in TIMES or n == "schema_version" else pd.Series([d.get(n) for d in found], dtype="object") for n in names})


def parsed(files: DataFrame, text: str = "value") -> DataFrame:
    """files (path, <text>) as path, KEYS with their types, body, raw and error; other columns are left out.

    `error` is null for a file that keeps every rule, else one that it breaks, and then KEYS and body are null and `raw` holds the text:
    no_frontmatter, bad_line (a line that is no entry), repeated_key, unknown_key, list, quotes, missing_key (or one without a value), schema_version,
    empty, type, status, control (control characters in title or updated_by), time (no instant with a zone). A null or empty text
    is no_frontmatter. schema_version and status have the defaults 1 and active. Lists are sets in order. Rows that repeat stay.
    """
    rows = files.select("path", F.col(text).alias("raw"), documents(F.col(text)).alias("_d"))
    typed = [F.timestamp_micros(f"_d.{k}").alias(k) if k in TIMES else F.col(f"_d.{k}") for k in KEYS]
    return rows.select("path", *typed, body_text(F.col("_d.body")).alias("body"), F.when(F.col("_d.error").isNotNull(), F.col("raw")).alias("raw"), "_d.error")


def read_bundle(spark: SparkSession, root: str, failfast: bool = False) -> DataFrame:
    """parsed() of all *.md under root but reserved paths; with failfast, a file with an error ends the read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = posixpath.normpath(root.split("://")[-1].removeprefix("file:"))
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^.*?\Q" + base + r"\E(?=/)", "")
    rows = parsed(files.select(path.alias("path"), "value").where(~reserved(F.col("path"))))
    if failfast:
        stop = F.raise_error(F.concat(F.lit("bad frontmatter, "), "error", F.lit(": "), "path")).cast("string")
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), stop))
    return rows


def scalar(x: Column) -> Column:
    """A text as YAML: as it stands where that can be read in one way, else as JSON."""
    quoted = F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1)
    return F.when(x.rlike(PLAIN) & ~F.lower(x).isin(WORDS), x).otherwise(quoted)


def instant(moment: Column) -> Column:
    """A time as UTC seconds, from its distance to 1970, so that no session's time zone and its gaps matter."""
    second = F.unix_seconds(moment)
    day, rest = F.date_from_unix_date(F.floor(second / 86400).cast("int")), F.pmod(second, F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)


def serialised() -> Column:
    """A concept's file: KEYS in their order without those that are null, the body as body_text() and one line feed. Times are UTC seconds."""

    def line(k: str) -> Column:
        if k in LISTS:
            clean = F.array_sort(F.array_distinct(F.filter(k, lambda x: x.isNotNull() & (x != ""))))
            return F.when(F.size(clean) > 0, F.concat(F.lit(f"{k}:\n  - "), F.array_join(F.transform(clean, scalar), "\n  - "))).otherwise(f"{k}: []")
        if k in TIMES:
            return F.concat(F.lit(f"{k}: "), instant(F.col(k)))
        return F.concat(F.lit(f"{k}: "), F.col(k).cast("string") if k == "schema_version" else scalar(F.col(k)))

    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[line(k) for k in KEYS]), F.lit("\n---\n"), body_text(F.coalesce("body", F.lit(""))), F.lit("\n"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    """Each row (path, value) becomes the file root/path, first under another name, so no reader sees half of one and a task that runs twice does no harm."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator[Row]) -> Written:
        import uuid

        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.root)
        n = 0
        for row in rows:
            target = posixpath.normpath(posixpath.join(base, row.path.lstrip("/")))
            if not target.startswith(base.rstrip("/") + "/"):
                raise ValueError(f"path outside the bundle: {row.path}")
            fs.create_dir(posixpath.dirname(target), recursive=True)
            part = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}.part")
            with fs.open_output_stream(part) as f:
                f.write(row.value.encode())
            fs.move(part, target)
            n += 1
        return Written(n)


class BundleFiles(DataSource):
    """Sink for (path, value): one file a row. Mode append alone, which replaces files of the same path."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("bundles are written with mode append")
        return FileWriter(self.options["path"])


def write_bundle(concepts: DataFrame, root: str) -> None:
    """Writes concepts (path, KEYS, body) as files under root, a URI or an absolute path. Nothing is written where one would not be read
    again as it is, or two have one path, or a path is null, reserved or no .md: then a ValueError names how many and one of them."""
    files = concepts.select("path", serialised().alias("value"))
    bad = parsed(files).where("error is not null").select("path", "error")
    path = F.col("path")
    odd = files.where(path.isNull() | reserved(path) | ~path.endswith(".md") | ~path.startswith("/") | path.rlike(r"(^|/)\.\.?(/|$)")).select("path", F.lit("path").alias("error"))
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("repeated_path").alias("error"))
    n, first = bad.union(odd).union(twice).agg(F.count("*"), F.min(F.struct("error", "path"))).first()
    if n:
        raise ValueError(f"{n} concepts can't be written, as {first['path']}: {first['error']}")
    concepts.sparkSession.dataSource.register(BundleFiles)
    files.write.format("bundle").mode("append").save(root if "://" in root else "file://" + root)
