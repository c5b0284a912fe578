"""JSON of any shape, as variants: strings under given keys at any depth, and a form in which equal values are equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.tables import cut


def canonical(text: Column) -> Column:
    """JSON with its keys in order and no blanks between; null for null, for what is no JSON and where an object repeats a key.

    A variant keeps an object's keys in order. Characters beyond ASCII stay as they are, decimals lose their last zeros.
    """
    return F.to_json(F.try_parse_json(text))


def json_hash(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def strings_under(rows: DataFrame, ident: str, column: str, keys: list[str], depth: int = 1000) -> DataFrame:
    """(<ident>, found): the different strings that stand under one of `keys` at any depth of each row's JSON, in order.

    Objects and arrays are exploded level by level, each a table of its own, until there is none left; rows of a level are the values that
    stand there. Rows without such a string, whose JSON is null or broken or without <ident> have no row; rows of one ident are one.
    Beyond `depth` levels, which the parser's own bound of nesting comes before, it raises.
    """
    level = rows.select(F.col(ident).alias("_id"), F.try_parse_json(F.col(column)).alias("_v")).where("_id is not null and _v is not null")
    spark, found = rows.sparkSession, []
    for _ in range(depth):
        exploded = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_id", "key", F.col("value").alias("_v"))
        level = cut(exploded, "level")
        if level.isEmpty():
            break
        hits = level.where(F.col("key").isin(keys)).where(F.schema_of_variant("_v") == "STRING")
        found.append(hits.select("_id", F.try_variant_get("_v", "$", "string").alias("s")))
        level = level.select("_id", "_v")
    else:
        raise RuntimeError(f"strings_under: objects left after {depth} levels")
    every = rows.select(F.col(ident).alias("_id"), F.lit("").alias("s")).limit(0)
    for hits in found:
        every = every.union(hits)
    return every.groupBy(F.col("_id").alias(ident)).agg(F.array_sort(F.collect_set("s")).alias("found"))
