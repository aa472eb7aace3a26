"""SimHash near duplicates: fingerprints, a Gray-order hierarchical index, and connected components of the links.

Fingerprints that differ in at most two of 64 bits agree on at least four of six bit blocks. So each distinct fingerprint is
dealt out under the 15 choices of four blocks, and only those that agree on a choice meet. What is left to compare in such a
bucket has at most 22 free bits, which bounds a bucket to 2**22 fingerprints however the corpus looks; copies of a text
have one fingerprint and don't add to it.

Within a bucket the fingerprints stand in the order of their Gray rank, where neighbours share long bit patterns. Every FAN
neighbours get an upper node that holds the bits all of them share (its mask and pattern), level by level up to one root. A
search starts at the root and adds up differences in the bits that each node newly fixes; a group whose sum is over the
limit is left out whole, and so is a group that is already known to be in the query's component. A bucket yields a star of
links for each component it sees, never all pairs.

Beyond a few bits, chance brings unlike texts together in a large corpus. So links may be held to a second fingerprint, of
longer shingles, that has to agree within bits of its own (`check`); it is looked at where the search has found a pair, and the
search goes on as if other pairs were none. The corpus pipeline links this way.

Components over all buckets come from alternating large-star and small-star steps on the links, in tables in the shared
folder, so that lost executors cost no more than a step. A null text counts as empty (fingerprint 0); null doc_ids
take part, and a component whose doc_ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tagloom.llm.common import has_repeats, join_groups, keep_rows, row_hash, small_batches, written

#: Bits that may differ, words of a shingle, and how many blocks the bits are cut into.
BITS, SHINGLE, BLOCKS = 2, 3, 6
#: Codes of a bucket that blocks are chosen for, as a power of two.
BUCKET = 6
#: Children of a node; pairs of query and node held at a time; rows of whole buckets searched at a time; queries of the first slice.
FAN, FRONTIER, ROWS, FIRST = 8, 1 << 19, 1 << 18, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; 0 if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line, one = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        h = np.array([one(line[a : b - 1], 42) for a, b in zip(ends[low:high], ends[min(low + shingle, len(words)) : high + shingle])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long (its 64 bits, signed)."""

    @arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return run(text)


def gray_rank(code: Column) -> Column:
    """Where a code stands among all Gray codes, as a signed long in the same order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Masks, as signed longs, of all choices of blocks - bits blocks: codes within `bits` bits agree under one at least."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its set) after the sets of a[i] and b[i] are joined."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def blocks_for(n: int, bits: int) -> int:
    """How many blocks to cut the bits into: so many that chance alone would bring few of n codes into a bucket. The links are
    the same for any number."""
    return next(b for b in range(bits + 2, 65) if b == bits + 8 or 64 * (b - bits) / b + BUCKET >= n.bit_length())


class GrayIndex:
    """Hierarchical indexes of many buckets at once. codes: uint64, by bucket and Gray rank; starts: where buckets begin.
    second: another fingerprint of each, that has to agree within second_bits too."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, second: np.ndarray | None = None, second_bits: int = 0):
        self.codes, self.second, self.second_bits = codes, second, second_bits
        n = len(codes)
        bucket = np.zeros(n, np.int64)
        bucket[starts[1:]] = 1
        bucket = bucket.cumsum()
        mask, pattern = np.full(n, ~np.uint64(0)), codes
        #: For each level from the leaves up: mask, pattern, first child (an offset past the last child at the end), last leaf.
        self.levels = [(mask, pattern, np.arange(n + 1), np.arange(n))]
        last = np.arange(n)
        while len(pattern) > len(starts):
            begin = np.searchsorted(bucket, np.arange(len(starts)))
            at = np.flatnonzero((np.arange(len(bucket)) - begin[bucket]) % FAN == 0)
            both, any_ = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(both ^ any_)
            pattern = both & mask
            children = np.append(at, len(bucket))
            last = last[children[1:] - 1]
            bucket = bucket[at]
            self.levels.append((mask, pattern, children, last))
        self.bucket_root = np.searchsorted(bucket, np.arange(len(starts)))
        self.root_of = np.repeat(self.bucket_root, np.diff(np.append(starts, n)))

    def components(self, bits: int = BITS) -> np.ndarray:
        """For each code the least index that links lead to within its bucket."""
        n = len(self.codes)
        label = np.arange(n)
        low, width = 0, FIRST
        while low < n:
            high = min(n, low + width)
            label = self._search(np.arange(low, high), label, bits)
            low, width = high, min(width * 4, FRONTIER)
        return label

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the component of all codes below a node, -1 where they are in several."""
        out = [label]
        for _, _, children, _ in self.levels[1:]:
            least, most = np.minimum.reduceat(out[-1], children[:-1]), np.maximum.reduceat(out[-1], children[:-1])
            out.append(np.where(least == most, least, -1))
        return out

    def _search(self, queries: np.ndarray, label: np.ndarray, bits: int) -> np.ndarray:
        known = self._uniform(label)
        codes, top = self.codes, len(self.levels) - 1
        found_a, found_b, held = [], [], 0
        stack = [(top, queries, self.root_of[queries], np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint64))]
        while stack:
            level, q, node, sum_, seen = stack.pop()
            if len(q) > FRONTIER // FAN and level < top:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], sum_[:half], seen[:half]), (level, q[half:], node[half:], sum_[half:], seen[half:])]
                continue
            mask, pattern, children, last = self.levels[level]
            keep = (last[node] > q) & (known[level][node] != label[q])
            q, node, sum_, seen = q[keep], node[keep], sum_[keep], seen[keep]
            fixed = mask[node]
            sum_ = sum_ + np.bitwise_count((codes[q] ^ pattern[node]) & fixed & ~seen)
            keep = sum_ <= bits
            q, node, sum_, fixed = q[keep], node[keep], sum_[keep], fixed[keep]
            if not len(q):
                continue
            if level == 0:
                if self.second is not None:
                    both = np.bitwise_count(self.second[q] ^ self.second[node]) <= self.second_bits
                    q, node = q[both], node[both]
                found_a.append(q)
                found_b.append(node)
                held += len(q)
                if held >= FRONTIER:
                    label = merge(label, np.concatenate(found_a), np.concatenate(found_b))
                    known, found_a, found_b, held = self._uniform(label), [], [], 0
                continue
            first, n = children[node], children[node + 1] - children[node]
            again = np.repeat(np.arange(len(q)), n)
            child = first[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            stack.append((level - 1, q[again], child, sum_[again], fixed[again]))
        return merge(label, np.concatenate(found_a), np.concatenate(found_b)) if found_a else label


def stars(batches: Iterator[pa.RecordBatch], bits: int = BITS, second_bits: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (choice, key, node, code and, if second_bits are given, second), sorted by choice, key and Gray rank -> links (a, b)
    of nodes, a star for each component of a bucket."""

    def links(choice: np.ndarray, key: np.ndarray, node: np.ndarray, code: np.ndarray, *second: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(code)))
        several = np.repeat(size > 1, size)
        node, code = node[several], code[several]
        size = size[size > 1]
        if len(size):
            other = (second[0][several].view(np.uint64), second_bits) if second else ()
            label = GrayIndex(code.view(np.uint64), np.cumsum(size) - size, *other).components(bits)
            moved = np.flatnonzero(label != np.arange(len(code)))
            if len(moved):
                pairs = np.unique(np.stack([node[moved], node[label[moved]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        waiting.append(tuple(c.to_numpy() for c in batch.columns))
        held += batch.num_rows
        if held >= ROWS:
            rows = [np.concatenate(x) for x in zip(*waiting)]
            end = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            if len(end):
                cut = end[-1] + 1
                yield from links(*[x[:cut] for x in rows])
                rows = [x[cut:] for x in rows]
            waiting, held = [tuple(rows)], len(rows[0])
    if held:
        yield from links(*[np.concatenate(x) for x in zip(*waiting)])


def links(codes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, second_bits: int | None = None) -> DataFrame:
    """Codes (node, code and, if second_bits are given, second) -> links (a, b) of nodes, whose components are those of all pairs
    within `bits` bits (and second_bits)."""
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, bits)])
    names = ["node", "code", *([] if second_bits is None else ["second"])]
    dealt = codes.select(*names, F.posexplode(masks).alias("choice", "mask"))
    dealt = dealt.select("choice", F.col("code").bitwiseAND(F.col("mask")).alias("key"), *names, gray_rank(F.col("code")).alias("rank"))
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key", "rank").select("choice", "key", *names)
    return dealt.mapInArrow(lambda batches: stars(batches, bits, second_bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) -> node, root: each linked node but the least of its component, with that least node."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(edges)) != before:
        before = now
        # large star: each node's greater neighbours go to the least of its neighbourhood
        both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "star")
        near = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "star-least")
        large = join_groups(both.filter("b > a"), near, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large-star")
        # small star: a node and its lesser neighbours go to the least of them
        near = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "star-least")
        small = join_groups(large, near, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(near.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = written(small, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(prints: DataFrame, bits: int = BITS, second_bits: int | None = None) -> DataFrame:
    """Written rows (doc_id, row, code and, if second_bits are given, second) -> a row for each code (and second) with n (its
    rows), component_id, and keep_row, the row of the component that stays."""
    keys = ["code", *([] if second_bits is None else ["second"])]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    codes = prints.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("first"))
    # a code is its own name; with a second it goes by the row that stands for it
    codes = written(codes.withColumn("node", F.col("code") if second_bits is None else F.col("first.row")), "codes")
    roots = components(links(codes, bits, BLOCKS if bits == BITS else blocks_for(codes.count(), bits), second_bits)).withColumnRenamed("node", "linked")
    joined = codes.join(roots, codes["node"] == roots["linked"], "left").select(*keys, "n", "first", F.coalesce("root", "node").alias("root"))
    joined = written(joined, "roots")
    ids = written(joined.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("members")), "components")
    return join_groups(joined, ids, ["root"], "members").select(*keys, "n", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keep_row"))


def prints_of(docs: DataFrame, shingle: int = SHINGLE, second: int | None = None) -> DataFrame:
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), row_hash(docs).alias("row_hash")]
    more = [] if second is None else [fingerprints(F.col("text"), second).alias("second")]
    return written(small_batches(docs).select(*ids, fingerprints(F.col("text"), shingle).alias("code"), *more), "fingerprints")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, check: tuple[int, int] | None = None) -> DataFrame:
    """One row a document: doc_id, row, row_hash, fingerprint (16 hex digits), component_id, kept (one row of a component is).

    check: words of the second fingerprint's shingles, and the bits in which it may differ.
    """
    second, second_bits = check or (None, None)
    prints = prints_of(docs, shingle, second)
    out = join_groups(prints, written(classes(prints, bits, second_bits), "classes"), ["code", *(["second"] if check else [])], "n")
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return out.select("doc_id", "row", "row_hash", digits.alias("fingerprint"), "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_one(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, check: tuple[int, int] | None = None) -> DataFrame:
    """docs with one row of each component; columns as they were."""
    decided = written(near_duplicates(docs, bits, shingle, check), "near-decided")
    return keep_rows(docs, decided.filter("kept"), has_repeats(decided))
