"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a shuffled order and laid end to end as one line
of words, cut into blocks of equal length. Slots of the mix are dealt to sources by
golden-ratio points mapped through the cumulative target weights; a source's r-th
slot takes its r-th block, beginning again after the last. A document's words are
taken as often as blocks over them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, free_name, small

#: The weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Golden ratio times 2**31, made odd; points are (i * STEP mod 2**31) / 2**31.
STEP, PERIOD = 1327217885, 2147483648
#: What the shuffled order comes from.
SEED = 20
#: Pieces that a source's shuffled line is sorted in, and cells of the weight table.
LANES, CELLS = 512, 4096
#: Slots of the mix, about, however large the sources are; each source has one more at most.
SLOTS = 1 << 18
#: Slots ranked together.
SLOT_CHUNK = 65536


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, key: str, lane: str, order: list, value: str, name: str, ws: Workspace) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the same key, lanes in order.

    A key's rows are summed per lane, the lanes' sums are summed over the key, and only
    then are rows ordered, within their lane: a key with most of the rows is spread over
    all its lanes.
    """
    sums = df.groupBy(key, lane).agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(lane).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.withColumn("_base", before).drop("_n").withColumnsRenamed({key: "_k", lane: "_l"})
    inner = F.coalesce(F.sum(value).over(W.partitionBy(key, lane).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        df.withColumn("_in", inner)
        .join(bases, F.col(key).eqNullSafe(F.col("_k")) & (F.col(lane) == F.col("_l")))
        .withColumn(name, F.col("_base") + F.col("_in")).drop("_k", "_l", "_base", "_in")
    )


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target, need for each row of ``sizes(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and divide ``share``
    of all sizes; none gets more than ``most`` of its own size, and what it leaves goes to
    the others by weight until none is above. Filled in order of size per weight, that is
    one level: sources below it are full, the rest get level times weight. The table has
    one row per source, and one task orders it.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    full = W.orderBy(F.col("cap") / F.col("weight"), "i")
    total = F.sum(F.col("source_size").cast("double")).over(everything) * share
    filled = F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(full.rowsBetween(W.currentRow, W.unboundedFollowing))
    # the level if every source before this one were full and no other
    ranked = ranked.withColumn("level", (total - filled) / left)
    fits = ranked.withColumn("first", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("first"), F.struct(F.col("cap") / F.col("weight"), "i", "level"))).over(everything)
    out = fits.withColumn("at", level).withColumn(
        "target",
        F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at.level"))),
    )
    return out.select("source", "i", "source_size", "target", F.round("target").cast("long").alias("need"))


def schedule(spark, wanted: DataFrame, block: int, ws: Workspace) -> DataFrame:
    """i (the source), slot, rank: which source each slot of the mix draws from.

    The points run on past the total until every source has its number of slots; slots
    that a filled source would get are passed over.
    """
    turns, rest = F.floor(F.col("need") / F.col("line")), F.col("need") % F.col("line")
    slots = turns * F.ceil(F.col("line") / block) + F.ceil(rest / block)
    wanted = wanted.where("need > 0").withColumn("slots", slots)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("slots").over(everything)
    upto = F.sum("slots").over(W.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    bounds = ws.write(wanted.select("i", "slots", ((upto - F.col("slots")) / total).alias("lo"), (upto / total).alias("hi"), total.alias("total")), "bounds")
    first = bounds.select("total").first()
    if first is None:
        return spark.createDataFrame([], "i long, slot long, rank long, slots long")
    # the discrepancy of n golden-ratio points stays within a few times log n
    n = int(first.total) + 64 + 8 * int(first.total).bit_length()
    cells = bounds.select("i", "slots", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = (F.col("slot") % PERIOD * STEP) % PERIOD / PERIOD
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").where("u >= lo AND u < hi").select("i", "slot", "slots", F.floor(F.col("slot") / SLOT_CHUNK).alias("lane"), F.lit(1).alias("one"))
    ranked = running(dealt, "i", "lane", ["slot"], "one", "rank", ws)
    return ranked.where("rank < slots").select("i", "slot", "rank", "slots")


def shuffled(doc_id: Column, size: Column, seed: int) -> Column:
    """What puts a source's documents in order, within their lane."""
    return F.xxhash64(F.lit(seed), doc_id, size)


def lane_of(mark: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(mark, 40), F.lit(LANES))


def mix(docs: DataFrame, ws: Workspace, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(the mix, per document; the slots).

    The mix has doc_id, source, size, source_size, target, taken, position (of the document's
    first word in its source's line). The slots have slot, i, rank, line_block, words: slot
    order is the order of the mix. Null and empty texts have size 0 and nothing is taken of
    them. Null sources form a source of their own, after all others. Rows that repeat an id
    count as often as they occur. Reruns agree: the order depends on ids, sizes and the seed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = ws.write(rows, "sizes")
    wanted = ws.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    if block is None:
        # equal blocks: as many as there are slots, of 16 words at least; a smaller source is one block
        total = wanted.agg(F.sum("need")).first()[0] or 0
        block = max(16, -(-int(total) // SLOTS))
    lined = rows.join(wanted, rows.source.eqNullSafe(wanted.source)).select("doc_id", rows.source, "size", "i", "source_size", "target")
    lined = lined.withColumn("mark", shuffled(F.col("doc_id"), F.col("size"), seed)).withColumn("lane", lane_of(F.col("mark")))
    lined = ws.write(running(lined, "i", "lane", ["mark", "doc_id", "size"], "size", "position", ws).drop("mark", "lane"), "lined")

    need = wanted.select("i", "need", F.col("source_size").alias("line"))
    slots = schedule(spark, need, block, ws).join(need, "i")
    per = F.ceil(F.col("line") / block)  # blocks in the line; the last may be short
    turn, at = F.floor(F.col("rank") / per), F.col("rank") % per
    width = F.least(F.lit(block), F.col("line") - at * block)
    done = turn * F.col("line") + at * block
    slots = slots.select("i", "slot", "rank", at.alias("line_block"), F.greatest(F.lit(0), F.least(width, F.col("need") - done)).alias("words")).where("words > 0")
    slots = ws.write(slots, "slots")

    # how often each block is taken whole, and the one slot that ends a source's share
    taken = slots.groupBy("i", "line_block").agg(F.collect_list("words").alias("widths"))
    over = lined.where("size > 0").select(
        "doc_id", "size", "i", "position",
        F.explode(F.sequence(F.floor(F.col("position") / block), F.floor((F.col("position") + F.col("size") - 1) / block))).alias("line_block"),
    )
    begin = F.greatest(F.col("position") - F.col("line_block") * block, F.lit(0))
    end = F.col("position") + F.col("size") - F.col("line_block") * block
    within = F.aggregate("widths", F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0).cast("long"), F.least(x, end) - begin))
    got = over.join(taken, ["i", "line_block"]).select("i", "position", within.alias("n")).groupBy("i", "position").agg(F.sum("n").alias("taken"))
    positive = lined.where("size > 0").join(got, ["i", "position"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    nothing = lined.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "position"]
    return positive.select(*cols).unionByName(nothing.select(*cols)), slots


def mixed(docs: DataFrame, ws: Workspace) -> DataFrame:
    return mix(docs, ws)[0].select("doc_id", "size", "source_size", "target", "taken")


def line_place(doc_id: Column, size: Column, seed: int = SEED) -> Column:
    """A row's place in its source's line, as something that can be compared."""
    mark = shuffled(doc_id, size, seed)
    return F.struct(lane_of(mark).alias("lane"), mark.alias("mark"), doc_id.alias("id"), size.alias("size"))


def repeat_documents(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, whole, with all their columns.

    A document is repeated as often as the mix repeats its words, rounded, at least once if
    any are taken. Blocks are taken along a source's line, so along it the repetitions are
    a few stretches of equal numbers. Their bounds, a row for each source, go to the
    documents, which stay where they are. Rows that repeat an id and a size are repeated
    alike, as often as the one of them that is repeated most.
    """
    inner = ws.inner("mix")
    taken = mix(docs, inner)[0].where("taken > 0")
    times = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")
    place = line_place(F.col("doc_id"), F.col("size"))
    stretches = taken.select("source", times.alias("times"), place.alias("place")).groupBy("source", "times").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    bounds = ws.write(stretches.groupBy("source").agg(F.collect_list(F.struct("first", "last", "times")).alias("stretches")), "stretches")
    inner.clear()
    bounds = bounds.withColumnsRenamed({"source": "_source"})
    own = line_place(docs["doc_id"].cast("long"), words(docs["text"]))
    found = docs.select(*[docs[c] for c in docs.columns], own.alias(free_name(docs.columns, "_place")))
    at = found.columns[-1]
    joined = found.join(small(bounds), found["source"].cast("string").eqNullSafe(bounds["_source"]))
    # a text without words may lie within a stretch, but nothing is taken of it
    here = F.filter(bounds["stretches"], lambda s: (found[at]["size"] > 0) & (s["first"] <= found[at]) & (found[at] <= s["last"]))
    times = F.array_max(F.transform(here, lambda s: s["times"]))
    copy = free_name(docs.columns, "_copy")
    made = joined.select(*[found[c] for c in docs.columns], times.alias(copy)).where(F.col(f"`{copy}`") > 0)
    n = made[copy]
    return made.select(*[made[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias(copy)).drop(copy)
