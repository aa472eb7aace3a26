"""Profiles, vectors and texts: cosine, neighbours, single-linkage groups, ranked search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import blocks, graph
from tagloom.operators.durable import cut

#: Rows of a block: a group of n rows is read n / SIDE times over.
SIDE = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """A vector of length 1; one of length 0 stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_pairs(vectors: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """group, a, b, cosine: pairs a < b within a group that are at least this similar. It lists all pairs of a group first and is
    for small groups; `nearest` and `links` have the same cosines and don't."""
    v = vectors.select(group, key, normalised(F.col(vector)).alias("v"))
    a, b = v.select(group, F.col(key).alias("a"), F.col("v").alias("va")), v.select(group, F.col(key).alias("b"), F.col("v").alias("vb"))
    p = a.join(b, group).filter("a < b").select(group, "a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("cosine"))
    return p.filter(F.col("cosine") >= least)


def neighbours(pairs: DataFrame, top: int) -> DataFrame:
    """The `top` most similar partners of each key: key, other, cosine, place."""
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), "cosine"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).filter(F.col("place") <= top)


def _blocks(rows: DataFrame, by: list[str], key: str, side: int) -> DataFrame:
    """by, _n, _block, rows: the rows of each `by` dealt into _n blocks by key, each block one list; rows without a key or `by` are in none."""
    r = rows.dropna(subset=[*by, key])
    n = r.groupBy(*by).agg(F.ceil(F.count("*") / side).cast("int").alias("_n"))
    r = r.join(n, by).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    return cut(r.groupBy(*by, "_n", "_block").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in by])).alias("rows")))


def _vector_blocks(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Vectors of a group and of one length; those without a number somewhere have no cosine."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    v = vectors.select(F.col(group).alias("_g"), F.col(key).alias("key"), v.alias("v")).filter("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    return _blocks(v.withColumn("_d", F.size("v")), ["_g", "_d"], "key", SIDE)


def _facing(b: DataFrame, by: list[str], halves: bool):
    """Each block with each of its `by`, itself included, as groups of one or two rows; with halves, each two once."""
    to = lambda least, most: F.explode(F.sequence(least, most))
    last, own, zero = F.col("_n") - 1, F.col("_block"), F.lit(0)
    one = b.select(*by, own.alias("_i"), to(own if halves else zero, last).alias("_j"), "rows", F.lit(True).alias("_left"))
    two = b.select(*by, to(zero, own if halves else last).alias("_i"), own.alias("_j"), "rows", F.lit(False).alias("_left"))
    return one.unionByName(two.filter("_i <> _j")).groupBy(*by, "_i", "_j")


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table | None] | None:
    """The two blocks of a group of `_facing`, the second None where a block faces itself; None if no key fell into one of them."""
    if table["_i"][0] == table["_j"][0]:
        return table, None
    left = table["_left"].to_pylist()
    return (table.slice(left.index(True), 1), table.slice(left.index(False), 1)) if len(left) == 2 else None


def _unpacked(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    rows = pa.concat_arrays([c.flatten() for c in table["rows"].chunks])
    d = table["_d"][0].as_py()
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.field("key"), flat.reshape(len(rows), d)


def nearest(vectors: DataFrame, group: str, key: str, vector: str, top: int) -> DataFrame:
    """key, other, cosine, place: the `top` partners of each key most similar within its group, ties by `other`; `top` is small.

    As `neighbours` of all `cosine_pairs`, by matrix products of blocks: the arithmetic still grows with the square of a group,
    rows do not."""
    kind = vectors.schema[key].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        if (sides := _sides(table)) is None:
            keys, i, j, c = _unpacked(table)[0], [], [], []
            others = keys
        else:
            keys, va = _unpacked(sides[0])
            others, vb = (keys, va) if sides[1] is None else _unpacked(sides[1])
            rank = np.empty(len(others), np.int64)
            rank[pc.sort_indices(others).to_numpy()] = np.arange(len(others))
            codes = keys.dictionary_encode().indices.to_numpy()
            i, j, c = blocks.most_similar(va, vb, rank, top, (codes, codes) if sides[1] is None else None)
        return pa.table({"key": keys.take(pa.array(i, pa.int64())), "other": others.take(pa.array(j, pa.int64())), "millionths": pa.array(c, pa.int64())})

    found = _facing(_vector_blocks(vectors, group, key, vector), ["_g", "_d"], False).applyInArrow(search, f"key {kind}, other {kind}, millionths bigint")
    w = Window.partitionBy("key").orderBy(F.desc("millionths"), "other")
    best = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return best.select("key", "other", F.when(F.col("millionths") == blocks.NAN, float("nan")).otherwise(F.col("millionths") / 1e6).alias("cosine"), "place")


def links(vectors: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """a, b: links that join the same keys as all `cosine_pairs` of at least this cosine, fewer than rows of the facing blocks."""
    kind = vectors.schema[key].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        if (sides := _sides(table)) is None:
            keys, i, j = _unpacked(table)[0], [], []
        elif sides[1] is None:
            keys, va = _unpacked(table)
            i, j = blocks.spanning_links(va, None, least)
        else:
            (keys, va), (more, vb) = _unpacked(sides[0]), _unpacked(sides[1])
            i, j = blocks.spanning_links(va, vb, least)
            keys = pa.concat_arrays([keys, more])
        return pa.table({"a": keys.take(pa.array(i, pa.int64())), "b": keys.take(pa.array(j, pa.int64()))})

    return _facing(_vector_blocks(vectors, group, key, vector), ["_g", "_d"], True).applyInArrow(search, f"a {kind}, b {kind}")


def linkage_groups(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, group (its least member), size: single linkage over the pairs."""
    c = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), keys.select(F.col(keys.columns[0]).alias("node")))
    n = c.groupBy("component").agg(F.count("*").alias("size"))
    return c.join(n, "component").select(F.col("node").alias("key"), F.col("component").alias("group"), "size")


def search(index: DataFrame, terms: list[str], system: str | None = None) -> DataFrame:
    """index (stem, system, summary, words, tags) -> stem, score: for each term 3 if the summary has it, else 2 if it is a
    word, else 1 if a tag has it; 2 more for the system. Only stems that score; a report sorts by falling score, then stem."""
    score = F.lit(0)
    for t in terms:
        low = t.lower()
        score = score + F.when(F.lower("summary").contains(low), 3).when(F.array_contains("words", low), 2).when(F.exists("tags", lambda x: F.lower(x).contains(low)), 1).otherwise(0)
    if system:
        score = score + F.when(F.col("system") == system, 2).otherwise(0)
    # a generator is evaluated once, where a filter would have the score worked out again
    return index.select("stem", F.explode(F.filter(F.array(score), lambda s: s > 0)).alias("score"))


def composition_distance(items: DataFrame, owner: str, pattern: str) -> DataFrame:
    """a, b, distance between owners that share a pattern: 1 - shared / larger of the two multisets.

    Blocks of owners meet, so there is no row for a shared pattern of two owners; the result itself has a row for every two
    owners that share one, which may be all."""
    kind, what = (items.schema[c].dataType.simpleString() for c in (owner, pattern))
    c = items.select(F.col(owner).alias("key"), F.col(pattern).alias("pattern")).filter("key IS NOT NULL").groupBy("key", "pattern").agg(F.count("*").alias("c"))
    n = c.groupBy("key").agg(F.sum("c").alias("n"))
    blocks_of = n.agg(F.greatest(F.ceil(F.count("*") / SIDE), F.lit(1)).cast("int").alias("_n"))
    n = n.crossJoin(F.broadcast(blocks_of)).withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_n")).cast("int"))
    packed = c.filter("pattern IS NOT NULL").join(n, "key").groupBy("_n", "_block").applyInArrow(_packed, f"_n int, _block int, keys array<{kind}>, n array<bigint>, patterns array<{what}>, row array<int>, pattern array<int>, c array<bigint>")
    b = cut(packed.select(F.lit(0).alias("_g"), "_n", "_block", F.struct("keys", "n", "patterns", "row", "pattern", "c").alias("rows")))
    return _facing(b, ["_g"], True).applyInArrow(_distances, f"a {kind}, b {kind}, distance double")


def _packed(table: pa.Table) -> pa.Table:
    """A block's owners with their sizes, patterns, and entries by the places of both, as one row."""
    keys, patterns = (table[c].combine_chunks().dictionary_encode() for c in ("key", "pattern"))
    n = np.zeros(len(keys.dictionary), np.int64)
    n[keys.indices.to_numpy()] = table["n"].to_numpy()
    lists = {"keys": keys.dictionary, "n": pa.array(n), "patterns": patterns.dictionary, "row": keys.indices, "pattern": patterns.indices, "c": table["c"].combine_chunks()}
    one = {k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for k, x in lists.items()}
    return pa.table({"_n": table["_n"].slice(0, 1), "_block": table["_block"].slice(0, 1), **one})


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = _sides(pa.Table.from_batches(list(batches)))
    if sides is None:
        return
    own = sides[1] is None
    one, two = ({f.name: x["rows"].combine_chunks().field(f.name).flatten() for f in x["rows"].type} for x in (sides[0], sides[0] if own else sides[1]))
    codes = pa.concat_arrays([one["patterns"], two["patterns"]]).dictionary_encode()
    code = codes.indices.to_numpy()
    at = lambda x, skip: (x["row"].to_numpy(), code[skip + x["pattern"].to_numpy()], x["c"].to_numpy())
    n, m = one["n"].to_numpy(), two["n"].to_numpy()
    shared = blocks.shared_counts(at(one, 0), at(two, len(one["patterns"])), (len(n), len(m)), len(codes.dictionary), max(n.max(), m.max()))
    keys = pa.concat_arrays([one["keys"], two["keys"]])
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    left, right = rank[: len(n)], rank[len(n) :]
    if own:  # each key is there twice
        right = left
    step = max(1, (blocks.CELLS // 2) // len(m))
    for s in range(0, len(n), step):
        hit = shared[s : s + step] > 0
        if own:
            hit &= left[s : s + step, None] < right
        i, j = np.nonzero(hit)
        i += s
        less = left[i] < right[j]
        a, b = np.where(less, i, len(n) + j), np.where(less, len(n) + j, i)
        yield pa.record_batch({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), "distance": pa.array(blocks.distances(shared[i, j], np.maximum(n[i], m[j])))})


def fingerprint_distance(a: Column, b: Column) -> Column:
    """0 to 1 between two `geometry.fingerprint` structs: half by the ratio of aspects, half by the mean gap of the quantiles."""
    least, most = F.least(a["aspect"], b["aspect"]), F.greatest(a["aspect"], b["aspect"])
    aspect = F.when(least > 0, 1 - least / most).when(most > 0, 1.0).otherwise(0.0)
    gaps = sum((F.abs(a[q] - b[q]) for q in ("q50", "q90")), F.abs(a["q10"] - b["q10"])) / 3
    return F.least(F.lit(1.0), 0.5 * aspect + 0.5 * gaps)


def combined_distance(composition: Column, a: Column, b: Column) -> Column:
    """Composition counts for six tenths, shape for four."""
    return 0.6 * composition + 0.4 * fingerprint_distance(a, b)
