"""Order statistics of any table, by groups, without a sort of a group or a buffer of its values.

Values are counted first, so repeats are one row. Then the range that holds a rank is narrowed: approximate quantiles of its values cut it
into bins, whose exact counts tell the bin that the rank is in, which is cut again, until FIT different values are left. Each turn
leaves about one value in CUTS; what a task holds is a sketch, a group's bins, or FIT values of a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.tables import cut

#: Bins of a turn, different values that are ranked at once, and how fine the sketches are.
CUTS, FIT, ACCURACY = 64, 2000, 1000
#: Ranks and groups that are broadcast, at most; more are joined by shuffles.
MOST = 20_000


def selected(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, rank, x): of rows (g, x) the value at place `rank`, from 0, of group g in order, for targets (g, rank).

    Nulls and NaN are left out. Targets beyond a group's rows have no value.
    """
    tally = cut(rows.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))).groupBy("g", "x").agg(F.count("*").alias("c")), "tally")
    targets = targets.distinct()
    some = F.broadcast if targets.count() <= MOST else (lambda df: df)
    live, key = tally.withColumn("t", F.lit(0).cast("long")), ["g", "t"]
    wanted = targets.select("g", F.lit(0).cast("long").alias("t"), "rank", F.col("rank").alias("left"))
    while True:
        sizes = live.groupBy(*key).agg(F.count("*").alias("d"))
        if (sizes.agg(F.max("d")).first()[0] or 0) <= FIT:
            break
        grid = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
        # written, since a sketch hangs on the order in which its parts come, and bins are read twice
        bounds = cut(live.groupBy(*key).agg(F.array_distinct(F.percentile_approx("x", grid, F.lit(ACCURACY))).alias("b")), "bounds")
        # bin 2i + 1 is a bound itself, so that each turn leaves fewer values
        place = 2 * F.size(F.filter("b", lambda b: b < F.col("x"))) + F.array_contains("b", F.col("x")).cast("int")
        binned = live.join(some(bounds), key).select(*key, "x", "c", place.alias("bin"))
        counts = cut(binned.groupBy(*key, "bin").agg(F.sum("c").alias("n")), "bins")
        ends = counts.withColumn("to", F.sum("n").over(Window.partitionBy(*key).orderBy("bin")))  # of 2 * CUTS bins at most
        hit = wanted.join(ends, key).where((F.col("left") < F.col("to")) & (F.col("left") >= F.col("to") - F.col("n")))
        hit = cut(hit.select("g", "t", "bin", "rank", (F.col("left") - F.col("to") + F.col("n")).alias("left")), "hits")
        # each rank goes on by itself
        live = cut(binned.join(some(hit), [*key, "bin"]).select("g", F.col("rank").alias("t"), "x", "c"), "live")
        wanted = hit.select("g", F.col("rank").alias("t"), "rank", "left")
    ends = live.withColumn("to", F.sum("c").over(Window.partitionBy(*key).orderBy("x")))  # of FIT values at most
    return wanted.join(ends, key).where(F.col("to") > F.col("left")).groupBy("g", "rank").agg(F.min("x").alias("x"))


def quantiles(rows: DataFrame, value: str, fractions: list[float], by: str | None = None, nearest: bool = False) -> DataFrame:
    """(g, fraction, x, n): of each group (null of all rows as one) its quantiles and number of values.

    Between two values in order they are linear; with nearest the value at place bround((n - 1) * fraction). Nulls and NaN don't count; a
    group without values isn't there. x is a double, or with nearest of the value's own type.
    """
    group = F.col(by) if by else F.lit(None).cast("string")
    rows = rows.select(F.coalesce(group.cast("string"), F.lit("")).alias("g"), group.isNull().alias("none"), F.col(value).alias("x"))
    rows = rows.select(F.struct("none", "g").alias("g"), "x" if nearest else F.col("x").cast("double").alias("x"))
    n = rows.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))).groupBy("g").agg(F.count("*").alias("n"))
    asked = n.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    at = (F.col("n") - 1) * F.col("fraction")
    low, high = (F.bround(at), F.bround(at)) if nearest else (F.floor(at), F.ceil(at))
    asked = cut(asked.select("g", "n", "fraction", low.cast("long").alias("low"), high.cast("long").alias("high"), (at - F.floor(at)).alias("part")), "ranks")
    found = cut(selected(rows, asked.select("g", F.col("low").alias("rank")).union(asked.select("g", "high"))), "selected")
    out = asked.join(found.select("g", F.col("rank").alias("low"), F.col("x").alias("a")), ["g", "low"])
    out = out.join(found.select("g", F.col("rank").alias("high"), F.col("x").alias("b")), ["g", "high"])
    x = F.col("a") if nearest else F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return out.select(F.when(~F.col("g.none"), F.col("g.g")).alias("g"), "fraction", x.alias("x"), "n")


def median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, mid, n): each group's median, null for none; groups of a null `by` are one."""
    return quantiles(rows, value, [0.5], by).select(F.col("g").alias(by), F.col("x").alias("mid"), "n")


def one(rows: DataFrame, value: str, fraction: float) -> Column:
    """The nearest-rank quantile of all rows as a literal: one number."""
    row = quantiles(rows, value, [fraction], nearest=True).first()
    return F.lit(row.x if row else None)
