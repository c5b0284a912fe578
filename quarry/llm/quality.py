"""Quality rules: robust multivariate outliers by language and source.

Each document's statistics are transformed to be about symmetric. For each (lang, source), the minimum
covariance determinant is sought from four starts that depend on the rows alone: mean and covariance; medians and
absolute deviations; the covariance of hyperbolic tangents; and that of directions. From each, concentration steps take the mean and
covariance of the `support` part of the documents that lie nearest. The start that led to the least determinant, which is the
product of the Cholesky factor's squared pivots, goes on to the end. Its covariance, made consistent with a normal law, gives
a last estimate from all documents within the law's 97.5 % bound, and documents beyond `cutoff` in its squared Mahalanobis
distance are rejected.

A step is one aggregation: sums by group and fine bin of distance, then the bins that hold the nearest part; no
task gathers a group. All steps are DataFrame operations.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import GAP, cut

SYMBOLS = "#*$%&|<>"
#: Of the transformed statistics, the least standard deviations, given the statistics before, that an estimate may have. Where most
#: documents of a group share one value, as most have no symbols, its spread is nought and says nothing.
FLOORS = {"x1": 0.5, "x2": 0.3, "x3": 0.1, "x4": 0.1, "x5": 0.1}
#: Bins a doubling of the squared distance.
BINS = 16
SUPPORT = 0.75
#: Of the normal law's squared distances, the part within the cutoff. Fewer than 1 % of the labelled clean documents of the test
#: tables lie beyond it.
WITHIN = 0.99999
#: Concentration steps of all starts, and of the best.
STEPS = (3, 3)
#: Documents that an estimate needs; smaller groups are estimated together.
LEAST = 50


def chi_squared(x: float, k: int) -> float:
    """The chance that a chi-squared number of k degrees of freedom is at most x."""
    half, s, a = x / 2, 0.0, 1.0 if k % 2 == 0 else 0.5
    while a < k / 2:
        s += math.exp((a if k % 2 else a - 1) * math.log(half) - half - math.lgamma(a + 1 if k % 2 else a)) if half > 0 else 0.0
        a += 1
    if k % 2:
        return math.erf(math.sqrt(half)) - s
    return 1 - s - math.exp((k / 2 - 1) * math.log(half) - half - math.lgamma(k / 2)) if half > 0 else 0.0


def quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, k) < share else (low, mid)
    return low


def consistency(share: float, k: int) -> float:
    """What the covariance of the nearest `share` of a normal law's documents is multiplied with to be the law's."""
    return share / chi_squared(quantile(share, k), k + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("_w", F.filter(F.split(text, GAP), lambda w: w != ""))
    docs = docs.withColumn("_k", F.when(F.size("_w") >= 8, F.transform(F.sequence(F.lit(1), F.size("_w") - 7), lambda i: F.xxhash64(F.slice("_w", i, 8)))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("_l", lines)
    # places of windows that are not the only one of their hash, by sorting (hash, place)
    sorted_ = F.array_sort(F.transform("_k", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_k")) < F.size("_k"), sorted_))
    same = lambda j, k: F.coalesce(F.get("_s", j)["h"] == F.get("_s", k)["h"], F.lit(False))
    places = F.filter(F.transform("_s", lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
    docs = docs.withColumn("_p", F.array_sort(places))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    docs = docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return docs.withColumn("base_failed", failed).drop("_w", "_k", "_l", "_s", "_p")


def transformed() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1).cast("long")).cast("double")
    return {
        "x1": F.log1p("n_words"),
        "x2": F.col("word_chars") / words,
        "x3": F.sqrt(F.col("n_symbols") / words),
        "x4": F.sqrt(F.col("n_dup_lines") / words),
        "x5": F.sqrt(F.col("n_repeat_words") / words),
    }


X = list(FLOORS)
U = [f"u{i}" for i in range(5)]
PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def moments(y: list[Column], tag: str = "") -> list[Column]:
    """Sums, of rows or of sums, for a mean and covariance."""
    return [F.sum(F.lit(1.0)).alias(f"{tag}n"), *[F.sum(c).alias(f"{tag}s{i}") for i, c in enumerate(y)], *[F.sum(y[i] * y[j]).alias(f"{tag}q{i}{j}") for i, j in PAIRS]]


SUMS = ["n", *[f"s{i}" for i in range(5)], *[f"q{i}{j}" for i, j in PAIRS]]


def factored(rows: DataFrame, keys: list[str], mean: list[Column], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """(keys, m0.., c00.., det): means, Cholesky factors with pivots of 1 at least, and the determinants' logarithms."""
    out = rows.select(*keys, *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[cov[i, j].alias(f"v{i}{j}") for i, j in PAIRS])
    for j in range(5):
        for i in range(j, 5):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"c{j}{j}"))
    det = sum((2 * F.log(F.col(f"c{i}{i}")) for i in range(5)), F.lit(0.0))
    return out.select(*keys, *[f"m{i}" for i in range(5)], *[f"c{i}{j}" for i, j in PAIRS], det.alias("det"))


def covariance(tag: str = "", factor: float = 1.0) -> dict[tuple[int, int], Column]:
    n = F.col(f"{tag}n")
    return {(i, j): factor * (F.col(f"{tag}q{i}{j}") / n - F.col(f"{tag}s{i}") / n * F.col(f"{tag}s{j}") / n) for i, j in PAIRS}


def estimate(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    return factored(sums, keys, [F.col(f"s{i}") / F.col("n") for i in range(5)], covariance(factor=factor))


def starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, med0.., u..) scaled rows (row, g, u0..): distances from the group's medians in units of FLOORS; and the starts' estimates by g and r."""
    half = lambda c: F.percentile_approx(c, 0.5, 10000)
    middle = cut(rows.groupBy("g").agg(*[half(x).alias(f"med{i}") for i, x in enumerate(X)]), "middle")
    rows = rows.join(middle, "g").select("row", "g", *[((F.col(x) - F.col(f"med{i}")) / FLOORS[x]).alias(U[i]) for i, x in enumerate(X)])
    spread = cut(rows.groupBy("g").agg(*[F.greatest(F.lit(1.0), 1.4826 * half(F.abs(u))).alias(f"d{i}") for i, u in enumerate(U)]), "spread")
    z = [F.col(u) / F.col(f"d{i}") for i, u in enumerate(U)]
    size = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in z]))
    kinds = {"a": [F.col(u) for u in U], "b": [F.tanh(c) for c in z], "c": [F.when(size > 0, c / size).otherwise(0.0) for c in z]}
    sums = rows.join(spread, "g").groupBy("g").agg(*[m for tag, y in kinds.items() for m in moments(y, tag)])
    sums = cut(sums.join(spread, "g"), "starts")
    zero, one = [F.lit(0.0)] * 5, [F.col(f"d{i}") for i in range(5)]
    back = lambda tag: {(i, j): c * one[i] * one[j] for (i, j), c in covariance(tag).items()}
    made = [
        ([F.col(f"as{i}") / F.col("an") for i in range(5)], covariance("a")),
        (zero, {(i, j): one[i] * one[j] if i == j else F.lit(0.0) for i, j in PAIRS}),
        (zero, back("b")),
        (zero, back("c")),
    ]
    every = [factored(sums.withColumn("r", F.lit(r)), ["g", "r"], mean, cov) for r, (mean, cov) in enumerate(made)]
    return rows, cut(reduce(DataFrame.union, every), "estimate")


def distances(rows: DataFrame, estimates: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by `factor` times the covariance, by forward substitution."""
    out = rows.join(estimates, keys)
    for i in range(5):
        rest = F.col(U[i]) - F.col(f"m{i}") - sum((F.col(f"c{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"z{i}", rest / F.col(f"c{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(5)), F.lit(0.0)) / factor).select(*rows.columns, "d2")


def concentrated(rows: DataFrame, estimates: DataFrame, keys: list[str], support: float) -> DataFrame:
    """The estimates from the rows up to the first bin of d2 with which a group has the support part of its rows."""
    binned = distances(rows, estimates, keys).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS))
    bins = binned.groupBy(*keys, "bin").agg(*moments([F.col(u) for u in U]))
    by = Window.partitionBy(*keys)
    bins = bins.withColumn("before", F.sum("n").over(by.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(by))
    near = bins.where(F.col("before") < F.ceil(F.col("all") * support)).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in SUMS])
    return cut(estimate(near, keys), "estimate")


def robust_distances(rows: DataFrame, support: float = SUPPORT, steps: tuple[int, int] = STEPS) -> DataFrame:
    """(row, d2) of rows (row, g, x1..x5): squared distances by the estimate of each row's group g."""
    scaled, estimates = starts(rows)
    each = scaled.withColumn("r", F.explode(F.array(*[F.lit(r) for r in range(4)])))
    for _ in range(steps[0]):
        estimates = concentrated(each, estimates, ["g", "r"], support)
    best = F.min_by(F.struct(*[c for c in estimates.columns if c != "g"]), F.struct("det", "r"))
    estimates = cut(estimates.groupBy("g").agg(best.alias("b")).select("g", "b.*").drop("r"), "best")
    for _ in range(steps[1]):
        estimates = concentrated(scaled, estimates, ["g"], support)
    within = distances(scaled, estimates, ["g"], consistency(support, 5)).where(F.col("d2") <= quantile(0.975, 5))
    sums = within.groupBy("g").agg(*moments([F.col(u) for u in U]))
    estimates = cut(estimate(sums, ["g"], consistency(0.975, 5)), "estimate")
    return distances(scaled, estimates, ["g"]).select("row", "d2")


def verdicts(docs: DataFrame, support: float = SUPPORT, cutoff: float | None = None, steps: tuple[int, int] = STEPS, least: int = LEAST) -> DataFrame:
    """As quality_rules(), with th, the hash of each row's text."""
    cutoff = quantile(WITHIN, 5) if cutoff is None else cutoff
    stats = base_statistics(docs.select("doc_id", F.hash("text").alias("th"), "lang", "source", "text"))
    stats = cut(stats.drop("text").withColumns({"row": F.monotonically_increasing_id(), **transformed()}), "statistics")
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("g", F.when(F.col("n") >= least, F.xxhash64("lang", "source", F.col("lang").isNull(), F.col("source").isNull())).otherwise(F.lit(0).cast("long")))
    sizes = sizes.withColumn("pooled", F.sum("n").over(Window.partitionBy("g"))).where(F.col("pooled") >= least)
    named = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g")
    rows = cut(good.join(named, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).select("row", "g", *X), "grouped")
    out = stats.join(robust_distances(rows, support, steps), "row", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "th", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")


def quality_rules(docs: DataFrame, support: float = SUPPORT, cutoff: float | None = None, steps: tuple[int, int] = STEPS, least: int = LEAST) -> DataFrame:
    """docs' doc_id, lang, source with the base statistics, base_failed, d2 and kept.

    docs: doc_id, text, lang, source, and any other columns, which are left aside. kept is false if base_failed;
    else if d2 is over the cutoff, by default the quantile WITHIN of the chi-squared law. Estimates are made from documents that
    don't fail the base rules. Groups of fewer than `least` such
    documents are estimated together, and if even these are too few, only base rules hold. A null text is
    empty; a null lang or source is a value like others. Rows come out as often as they go in, with the verdict
    that depends on values alone.
    """
    return verdicts(docs, support, cutoff, steps, least).drop("th")
