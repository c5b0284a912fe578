"""The test tables as the library's own: concepts, vectors, a link graph, operations, proposals and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import epoch

# Kinds of concepts.
TYPES = ["concept", "instance", "person", "project", "service", "system"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    ident = F.format_string("doc-%08d", "doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        ident.alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), ident, F.lit(".md")).alias("path"),
        F.concat(F.lit("/"), "source", F.lit("/")).alias("namespace"),
        kind.alias("type"),
        F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 80).alias("title"),
        F.when(F.col("toxic") == 1, "tombstone").when(F.col("quality") == 0, "deprecated").otherwise("active").alias("status"),
        F.sort_array(F.array("lang", kind, "source")).alias("tags"),
        F.col("text").alias("body"),
        F.sha2("text", 256).alias("content_hash"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).alias("updated_s"),
        F.when(F.col("doc_id") % 50 == 7, F.array(F.format_string("doc-%08d", F.col("doc_id") - 1))).otherwise(F.array().cast("array<string>")).alias("supersedes"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    status = F.when(F.col("vec_id") % 10 == 0, "stale").when(F.col("vec_id") % 10 == 1, "missing").when(F.col("vec_id") % 10 == 2, "error").otherwise("ready")
    return e.select("vec_id", F.format_string("doc-%08d", "vec_id").alias("id"), "embedding", "label", status.alias("status"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts and nations, all of them. Parts of more than 40 in size lie in an archive, where no link looks for them."""
    node = lambda df, key, letter, space: df.select(F.concat(F.lit(letter), key).alias("id"), F.concat(F.lit("/"), space, F.lit(f"/{letter}"), key, F.lit(".md")).alias("path"), F.concat(F.lit("/"), space, F.lit("/")).alias("namespace"))
    place = F.when(F.col("p_size") > 40, "archive").otherwise("parts")
    nodes = node(table(spark, sf_dir, "supplier"), "s_suppkey", "s", F.lit("suppliers")).union(node(table(spark, sf_dir, "part"), "p_partkey", "p", place))
    return nodes.union(node(table(spark, sf_dir, "nation"), "n_nationkey", "n", F.lit("nations")))  # nothing links to these


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_path): each line's supplier to its part, each part to its least supplier and to the first part of its brand."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    link = lambda letter, key, space, to, other: [F.concat(F.lit(letter), key).alias("source_id"), F.concat(F.lit(f"/{space}/{to}"), other, F.lit(".md")).alias("target_path")]
    out = lines.select(*link("s", "l_suppkey", "parts", "p", "l_partkey"))
    least = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(*link("p", "l_partkey", "suppliers", "s", "s"))
    first = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return out.union(least).union(parts.join(first, "p_brand").select(*link("p", "p_partkey", "parts", "p", "first")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", epoch(F.col("ts")).alias("moment"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = {"signup": "submitted", "click": "approved", "view": "draft", "purchase": "applied", "error": "rejected"}
    status = F.create_map(*[F.lit(x) for kv in state.items() for x in kv])
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("proposal_id"), F.col("user_id").alias("author"), "moment", status[F.col("event_type")].alias("status"), F.concat(F.lit("/k"), F.col("k"), F.lit(".md")).alias("path"), "value")
