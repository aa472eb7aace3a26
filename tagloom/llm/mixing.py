"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets share a part of all words by the sources' weights. A target stops at `most` times its source's size, and what is over
is shared again by weight; sorted by the share at which they stop, the sources that stop are a prefix, found with running sums.

The schedule has one slot for each block of the targets. Slot j stands at the golden-ratio point frac((j + 1/2) * phi), and
the cumulative target shares say which source's interval the point is in: any run of slots, however short, follows the
weights. Within a source the documents are shuffled by hash and laid end to end, and cut into blocks of equal length; the
source's r-th slot takes its block r modulo the number of blocks, `most` times round at most. What a document gives is the
sum over its blocks of the words it has there times how often the block is taken.

Running sums go in two steps, over ranges and within them: over sources (there may be as many as documents), and over the
documents and slots of a source, which may be most of all. Documents and slots meet their source by join_groups, and points
meet the sources by an equi-join on grid cells, whose number grows with the slots. All this runs in Spark's own functions.
Null texts have size 0, null sources are one source that comes last, and a document of size 0 is never taken. Reruns agree,
since the order in a source is by hash of doc_id, then doc_id, row hash and size. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import hidden, in_chunks, join_groups, named, row_hash, sums_before, written

#: Words of a block, slots of a chunk, and documents of a chunk of a source's shuffled order at about.
BLOCK, SLOTS, CHUNK_ROWS = 128, 1 << 14, 1 << 17
#: Bits of chunk numbers at least; cells of the grid for each source and at least, and slots of a cell at about.
LEAST_BITS, CELLS, LEAST_CELLS, CELL_SLOTS = 10, 8, 1 << 10, 1 << 20
#: Units of a word that targets are rounded to.
UNITS = 1024
#: The golden ratio's fraction, and that of 2**20 times it: slot numbers are multiplied in two parts, to keep all digits.
PHI, PHI_UPPER = 0.6180339887498949, 0.607787409740351
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size (and others) -> the same with target. One row a source; the weights repeat in order of code point, null last."""
    total = float(share * (sizes.agg(F.sum("source_size")).first()[0] or 0))
    order = [F.col("source").asc_nulls_last()]
    out, chunk = in_chunks(sizes, order, "mix-sources")
    place = F.coalesce(F.col("place"), F.lit(0))
    out = sums_before(out, chunk, order, {"place": F.lit(1)}).drop(chunk)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    out = out.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).drop("place")
    out = out.withColumn("ratio", F.col("cap") / F.col("weight"))
    # if all sources of lesser ratio stop, the rate at which this one and the others are served; they are a prefix, which ends
    # where a source can take what it is served
    order = [F.col("ratio"), *order]
    out, chunk = in_chunks(out, order, "mix-ratios")
    every = out.agg(F.sum("weight")).first()[0] or 0.0
    out = sums_before(out, chunk, order, {"caps": F.col("cap"), "weights": F.col("weight")})
    served = (F.lit(total) - F.coalesce("caps", F.lit(0.0))) / (F.lit(every) - F.coalesce("weights", F.lit(0.0)))
    out = out.withColumn("rate", served)
    first = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "rate")))
    found = out.agg(first.alias("f")).select("f.rate").first()
    rate = None if found is None else found["rate"]
    target = F.col("cap") if rate is None else F.least(F.col("cap"), F.lit(rate) * F.col("weight"))
    return out.withColumn("target", target).select(*sizes.columns, "target")


def laid_out(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, source, size (row_hash, others) -> with begin: the words of the source before the document, in shuffled order."""
    rows = docs.count() if rows is None else rows
    bits = max(LEAST_BITS, (max(1, rows) // CHUNK_ROWS).bit_length())
    h, chunk, offset, inner, source, other = hidden(6)
    order = [h, "doc_id", *[c for c in ("row_hash",) if c in docs.columns], "size"]
    d = docs.withColumn(h, F.xxhash64(F.col("doc_id"), F.lit("mix"))).withColumn(chunk, F.shiftright(h, 64 - bits))  # sorted by hash, the chunks are so too
    within = Window.partitionBy("source", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = d.groupBy("source", chunk).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(F.col("source").alias(source), F.col(chunk).alias(other), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias(offset))
    d = d.withColumn(inner, F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col(source)) & (F.col(chunk) == F.col(other)), "inner")
    return d.withColumn("begin", F.col(offset) + F.col(inner)).select(*docs.columns, "begin")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, target -> slot, source: which source each slot of the whole schedule takes a block from."""
    units = F.floor(F.col("target") * UNITS + 0.5).cast("long")  # whole numbers, so that shares meet without a gap
    words, total, n_sources = plan.agg(F.sum("target"), F.sum(units), F.count("*")).first()
    n_slots = int(round((words or 0.0) / block))
    cells = max(LEAST_CELLS, CELLS * n_sources, n_slots // CELL_SLOTS)
    order = [F.col("source").asc_nulls_last()]
    shares, chunk = in_chunks(plan.select("source", units.alias("units")).filter("units > 0"), order, "mix-shares")
    shares = sums_before(shares, chunk, order, {"before": F.col("units")}).withColumn("before", F.coalesce("before", F.lit(0)))
    low, high = F.col("before") / F.lit(total or 1), (F.col("before") + F.col("units")) / F.lit(total or 1)
    shares = shares.select("source", low.alias("low"), high.alias("high"))
    cell = lambda c: F.least(F.lit(cells - 1), F.floor(F.col(c) * cells)).cast("long")
    by_cell = shares.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    turn = F.shiftright("id", 20) * F.lit(PHI_UPPER)
    turn = turn - F.floor(turn) + (F.expr("id & 1048575") + 0.5) * F.lit(PHI)
    slots = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    return slots.join(by_cell, "cell").filter("point >= low AND point < high").select("slot", "source")


def block_takes(slots: DataFrame, plan: DataFrame, block: int = BLOCK, most: float = MOST) -> DataFrame:
    """slot, source -> source, block, takes: how often the schedule takes each block of a source."""
    s = written(slots.withColumn("chunk", F.shiftright("slot", SLOTS.bit_length() - 1)), "mix-slots")
    counts = s.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = s.withColumn("inner", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")), "inner")
    ranked = written(ranked.select("source", (F.col("offset") + F.col("inner")).alias("rank")), "mix-ranks")
    sizes = ranked.groupBy("source").agg(F.count("*").alias("n_slots"))
    blocks = plan.select(F.col("source").alias("_s"), F.ceil(F.col("source_size") / block).alias("n_blocks"))
    blocks = sizes.join(blocks, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    ranked = join_groups(ranked, written(blocks, "mix-blocks"), ["source"], "n_slots").filter(F.col("rank") < F.col("n_blocks") * int(most))
    return ranked.groupBy("source", F.expr("rank % n_blocks").alias("block")).agg(F.count("*").alias("takes"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a document: doc_id, row_hash, source, size, source_size, target (its source's), taken."""
    ids = [named(doc_id).alias("doc_id"), row_hash(docs).alias("row_hash"), named(source).alias("source")]
    sized = written(docs.select(*ids, word_count(named(text)).alias("size")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = written(targets(written(per, "mix-sources"), weights, share, most), "mix-targets")
    placed = written(laid_out(sized.filter("size > 0"), plan.agg(F.sum("n")).first()[0] or 0), "mix-layout")
    takes = block_takes(schedule(plan, block), plan, block, most)
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = placed.select("source", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    pieces = pieces.withColumn("words", words)
    takes = takes.withColumnsRenamed({"source": "_s", "block": "_b"})
    taken = pieces.join(takes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "inner")
    taken = taken.groupBy("source", "begin").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"))
    taken = taken.withColumnsRenamed({"source": "_s", "begin": "_b"})
    names = ["doc_id", "row_hash", "source", "size"]
    full = placed.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("begin") == F.col("_b")), "left").select(*names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = sized.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    out = join_groups(written(full.unionByName(none), "mix-taken"), plan, ["source"], "n")
    return out.select(*names, "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: each row taken / size times, rounded half up; columns as they were.

    Blocks are taken in the order of the layout, so only the documents at a source's last block are taken in part. Of rows
    that are equal throughout, each comes as often as their mean.
    """
    mixed = mix(docs, block=block).filter("size > 0").groupBy("doc_id", "row_hash").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = written(mixed.select("doc_id", "row_hash", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0"), "mix-times")
    mine, id_, hash_, n, copy = hidden(5)
    keyed = docs.withColumn(mine, row_hash(docs))
    ids = times.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_), F.col("times").alias(n))
    out = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(hash_)), "inner")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[named(c) for c in docs.columns])
