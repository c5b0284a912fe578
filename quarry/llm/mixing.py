"""Mixing sources to target weights.

Each source's words, in an order of its documents, are a stream cut into blocks of a fixed length: `block` words,
or fewer for a source that would have less than FINEST blocks. The mix is a row of slots, each for one block, in shards of
about `shard` slots. Every slot of a shard draws its source, so a shard's counts by source are multinomial. The slots
that a source draws are numbered through all shards; what it draws beyond its target is left out, and what it lacks
is a closing shard's, so each source meets its target to within a block. Slot j takes the block that a pseudorandom permutation
of the source's indices gives for j, a new permutation for each round, so no block comes twice in a round and no
source has more than `most` rounds. Blocks and slots meet by source and index.

The permutation is a Feistel network on a grid just larger than the number of blocks, walked until it is inside.

All steps are DataFrame operations. Running sums are made in two levels, within buckets of documents and over
the buckets' sums, so that a large source isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import GAP, cut, partitions

#: Documents of a bucket, about.
ROWS = 5_000
#: Blocks that a source should have at least, if it has as many words.
FINEST = 256
#: Half rounds of the permutation, and steps of its walk; see permuted().
TURNS, WALK = 6, 64


def word_count(text: Column) -> Column:
    """Words of a text: gaps with a word before them, and a last word."""
    padded = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    parts = F.split(padded, GAP)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - 1 - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target): `share` of all sizes by weight, no source above `most` times its size.

    Sources by code point, null last, weigh by turns. Sources in order of most * size / weight reach their
    limit first; the rest share what is left.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weigh = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weigh).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    first = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("k", F.row_number().over(first))
        .withColumn("at", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.struct("k", "rate"))).over(every))
    )
    return rows.select("source", "source_size", F.when(F.col("k") >= F.col("at.k"), F.col("at.rate") * F.col("weight")).otherwise(F.col("limit")).alias("target"))


def counts_by_shard(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(id, k, start, stop): the numbers of a source's slots in each shard. sources: id, slots, blocks."""
    total, number = sources.agg(F.sum("slots"), F.count("*")).first()
    total, number = int(total or 0), int(number)
    shards = max(1, round(total / shard))
    # slots draw a number below the sum of all sources' slots; sources own a range each, found by cells of the whole range
    width = max(1, -(-total // max(1, number)))
    own = sources.where("slots > 0").withColumn("high", F.sum("slots").over(Window.orderBy("id"))).withColumn("low", F.col("high") - F.col("slots"))
    own = own.select("id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    session = sources.sparkSession
    k = session.range(0, shards if total else 0, 1, max(1, min(shards, max(partitions(session), shards // 64)))).withColumnRenamed("id", "k")
    edge = lambda x: F.floor(x * F.lit(total) / F.lit(shards))
    slots = k.select("k", F.explode(F.sequence(edge(F.col("k")), edge(F.col("k") + 1) - 1)).alias("i")).select("k", F.pmod(F.xxhash64(F.lit(seed), "k", "i"), F.lit(total)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width))
    # slots look few and are many, so that they would be broadcast; own has about two rows a source
    drawn = slots.join(F.broadcast(own), "cell").where("low <= u and u < high").groupBy("id", "k").agg(F.count("*").alias("n"))
    closing = sources.where("slots > 0").select("id", F.lit(shards).cast("long").alias("k"), F.col("slots").alias("n"))  # cut to what is left below
    every = drawn.union(closing).withColumn("stop", F.sum("n").over(Window.partitionBy("id").orderBy("k")))
    every = every.join(sources.select("id", "slots"), "id").select("id", "k", (F.col("stop") - F.col("n")).alias("start"), F.least("stop", "slots").alias("stop"))
    return cut(every.where("start < stop"), "counts")


def permuted(x: Column, n: Column, key: list[Column]) -> Column:
    """A pseudorandom one-to-one image of x among 0..n-1, by key.

    The grid has a = ceil(sqrt(n)) columns and b rows, a * b - n < a. From inside, a walk passes each outer place once
    at most, so it ends within a steps; for a > WALK, one of more than WALK steps has a chance below 64 ** -64.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.ceil(n / a).cast("long")

    def stir(y: Column) -> Column:
        left, right = y % a, F.floor(y / a)
        for t in range(TURNS):
            if t % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(t), left, *key), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(t), right, *key), a), a)
        return right * a + left

    once = stir(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda y, _: F.when(y < n, y).otherwise(stir(y)))
    return F.when(once < n, once).otherwise(walk)


def placed_spans(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, block: int, shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, size, source_size, target, ..) of all rows of docs (row, doc_id, source, text), and (row, first, words, times) of what the mix takes."""
    base = cut(docs.select("row", "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    buckets = max(1, base.count() // ROWS)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(buckets)))
    sizes = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = cut(sizes.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]), "buckets")
    sources = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    sources = sources.withColumns({"id": F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")), "block": F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / FINEST))).cast("long")})
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * most)).otherwise(0)
    sources = cut(sources.withColumn("slots", slots.cast("long")), "sources")

    counts = counts_by_shard(sources, shard, seed)
    many = max(partitions(docs.sparkSession), counts.count() // 1000)
    dealt = counts.join(sources.select("id", "blocks"), "id").repartition(many, "id", "k").select("id", "blocks", F.explode(F.sequence("start", F.col("stop") - 1)).alias("j"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    index = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), [F.lit(seed), F.col("id"), turn])
    drawn = dealt.select("id", index.alias("index")).groupBy("id", "index").agg(F.count("*").alias("times"))

    near = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("size").over(near), F.lit(0)))
    known = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(sizes["source"].alias("s"), F.col("bucket").alias("b"), "before", "id", "block", "source_size", "target")
    # documents and spans look small as files: a hint, or they would be broadcast
    placed = placed.join(known.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("a", F.col("before") + F.col("within"))
    placed = cut(placed.select("row", "doc_id", "size", "source_size", "target", "id", "block", "a"), "placed")
    index = F.explode(F.sequence(F.floor(F.col("a") / F.col("block")), F.floor((F.col("a") + F.col("size") - 1) / F.col("block"))))
    # drawn grows with the mix, which an estimate from its few source rows does not show: never broadcast
    used = placed.where("size > 0").select("row", "id", "a", "size", "block", index.alias("index")).join(drawn.hint("merge"), ["id", "index"])
    low = F.greatest("a", F.col("index") * F.col("block"))
    words = F.least(F.col("a") + F.col("size"), (F.col("index") + 1) * F.col("block")) - low
    return placed, used.select("row", (low - F.col("a")).alias("first"), words.alias("words"), "times")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, shard: int = 1 << 16, seed: int = 0) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text, and any other columns, which are left aside. A document's size is its number of
    words, 0 for a null or empty text. Returns doc_id, size, source_size, target (its source's, in words) and
    taken (repeats counted, at most `most` times its size). A null source is a source. Repeated rows are
    documents of their own, in one order or another, which no number of a group of equal rows depends on. Results depend on
    the rows and the seed alone. A source's taken words are its target to within one of its blocks and a last, shorter one. A
    table without words gives taken 0.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    placed, spans = placed_spans(rows, weights, share, most, block, shard, seed)
    sums = spans.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(sums.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, shard: int = 1 << 16, seed: int = 0) -> DataFrame:
    """The documents that the mix takes, with the words that it takes of each as they stand in the text.

    docs has doc_id, source, text, n_chars and any others of any names; they come back, n_chars counted anew. White space
    between and around words that are taken stays as it is; what is taken twice follows after a line feed. Documents of
    which nothing is taken don't come back, so none without words (null or empty text) does.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    docs = cut(docs.select(F.monotonically_increasing_id().alias("row"), rest), "mixed")
    _, spans = placed_spans(docs.select("row", "rest.doc_id", "rest.source", "rest.text"), weights, share, most, block, shard, seed)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("spans"))
    white = r"[\x20\x09-\x0D]"
    words = F.regexp_extract_all("rest.text", F.lit(rf"(?:^{white}+)?[^\x20\x09-\x0D]+{white}*"), F.lit(0))
    some = lambda turn: F.array_join(F.flatten(F.transform(F.filter("spans", lambda s: s["times"] > turn), lambda s: F.slice(F.col("w"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), "")
    out = docs.join(spans.hint("merge"), "row").withColumn("w", words)
    text = F.array_join(F.filter(F.array(*[some(t) for t in range(most)]), lambda x: x != ""), "\n")
    out = out.select("rest", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.schema["rest"].dataType.names])
