"""Graphs as edge tables (src, dst): closures, paths, components, contraction, root causes.

Traversals are frontier rounds: join the edges, drop what was visited, stop when nothing is new. Each round is written to
shared storage, which cuts the lineage. A bound on rounds raises; it never truncates a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.durable import Rounds, cut

MAX_ROUNDS = 200
#: Edges up to which a graph is not split into components first, and up to which a component goes to a task whole; bits of a
#: task's table of nodes and seeds (96 MB).
WHOLE, TASK_EDGES, TASK_BITS = 500_000, 4_000_000, 3 * 2**28


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """seed, node, depth: all that can be reached from each seed (column seed), itself left out; depth is the least."""
    e = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("seed").distinct().withColumn("node", F.col("seed")))
    rounds = Rounds(frontier)
    for depth in range(1, max_rounds + 2):
        step = frontier.join(e, frontier["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = rounds.add(step.join(rounds.all().select("seed", "node"), ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            return rounds.all().filter("round > 0").select("seed", "node", F.col("round").alias("depth"))
    raise RuntimeError(f"closure not finished after {max_rounds} rounds")


def reach_counts(edges: DataFrame, seeds: DataFrame, among: DataFrame | None = None, words: int = 4, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """seed, n, deepest: how many nodes each seed (column seed) reaches, itself left out, and how far the last is; seeds that
    reach none drop out. With `among` (column node) only those count, and deepest is the last of them; if it has a column
    weight, a node counts so often.

    As `closure`, counted, but no row for each seed and node. A component goes to tasks whole, once for each block of its seeds,
    and is walked there with a bit for each seed of the block. What is beyond `TASK_EDGES` goes by rounds of all tasks.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    s, only = cut(seeds.select("seed").filter("seed IS NOT NULL").distinct()), None
    if among is not None:
        weight = F.sum("weight") if "weight" in among.columns else F.lit(1).cast("long")
        only = cut(among.filter("node IS NOT NULL").groupBy("node").agg(weight.alias("weight")).filter("weight > 0"))
    if e.count() <= WHOLE:
        e, t = e.withColumn("component", F.lit(0)), s.withColumn("component", F.lit(0))
        o, nodes = None if only is None else only.withColumn("component", F.lit(0)), None
    else:
        labels = components(e, e.select(F.col("src").alias("node")).union(e.select("dst")))
        e = cut(e.join(labels.withColumnRenamed("node", "src"), "src").select("src", "dst", "component"))
        t = cut(s.join(labels.withColumnRenamed("node", "seed"), "seed"))
        o, nodes = None if only is None else cut(only.join(labels, "node")), labels.groupBy("component").agg(F.count("*").alias("_nodes"))
    size = e.groupBy("component").agg(F.count("*").alias("_edges")).join(t.groupBy("component").agg(F.count("*").alias("_seeds")), "component")
    size = cut(size.withColumn("_nodes", 2 * F.col("_edges")) if nodes is None else size.join(nodes, "component"))
    found = _reach_in_tasks(e, t, o, size.filter(F.col("_edges") <= TASK_EDGES), max_rounds)
    large = size.filter(F.col("_edges") > TASK_EDGES).select("component")
    if large.isEmpty():
        return found
    rest = lambda df: cut(df.join(large, "component", "left_semi").drop("component"))
    return found.unionByName(_reach_by_rounds(rest(e), rest(t), None if o is None else rest(o), words, max_rounds))


def _reach_in_tasks(e: DataFrame, s: DataFrame, among: DataFrame | None, size: DataFrame, max_rounds: int) -> DataFrame:
    """`reach_counts` of the components in size (component, _edges, _seeds, _nodes); a task holds a component and a block of its seeds.

    Blocks are of 64 seeds or more, an eighth of the component's, as far as the bits of its nodes fit a task.
    """
    fit = F.floor(F.lit(TASK_BITS / 64) / (F.col("_nodes") + 1))
    wide = size.select("component", (64 * F.greatest(F.lit(1), F.least(F.ceil(F.col("_seeds") / 512), fit))).alias("_wide"))
    numbered = cut(_numbered(s, "component", "seed"))
    first = numbered.groupBy("component").agg(F.min("_i").alias("_first"))
    placed = numbered.join(first, "component").join(wide, "component").select("component", "seed", F.floor((F.col("_i") - F.col("_first")) / F.col("_wide")).alias("_block"))
    placed = cut(placed)
    blocks = placed.select("component", "_block").distinct()
    row = lambda kind, src, dst, weight: ("component", "_block", F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), weight.alias("weight"))
    none = F.lit(0).cast("long")
    rows = e.join(blocks, "component").select(*row(0, "src", "dst", none)).unionAll(placed.select(*row(1, "seed", "seed", none)))
    if among is not None:
        rows = rows.unionAll(among.join(blocks, "component").select(*row(2, "node", "node", F.col("weight"))))
    kind = s.schema["seed"].dataType.simpleString()
    return rows.groupBy("component", "_block").applyInPandas(_reach_of_block(among is not None, max_rounds), f"seed {kind}, n long, deepest int")


def _reach_of_block(some: bool, max_rounds: int, rows: int = 1 << 16):
    """Walks a component from a block of seeds, 64 seeds in a word. Kinds of rows: 0 edge, 1 seed, 2 node that counts (if some)."""

    def bits(table: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(table).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        at, names = pd.factorize(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
        src, dst = at[: len(pdf)].astype(np.int32), at[len(pdf) :].astype(np.int32)
        seeds, counted = src[kind == 1], src[kind == 2]
        weight = np.zeros(len(names)) if some else np.ones(len(names))
        weight[counted] = pdf["weight"].to_numpy()[kind == 2]
        tail, head = src[kind == 0], dst[kind == 0]
        order = np.argsort(head, kind="stable")
        tail, head = tail[order], head[order]
        j = np.arange(len(seeds))
        seen = np.zeros((len(names), -(-len(seeds) // 64)), np.uint64)
        seen[seeds, j // 64] = np.uint64(1) << (j % 64).astype(np.uint64)
        new, fresh = seen.copy(), np.zeros_like(seen)
        live = np.zeros(len(names), bool)
        live[seeds] = True
        deepest = np.zeros(len(seeds), np.int32)
        for depth in range(1, max_rounds + 2):
            step = np.flatnonzero(live[tail])
            if not len(step):
                break
            h = head[step]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            cuts = np.unique(np.searchsorted(starts, np.arange(0, len(step), rows), side="left"))
            live[:] = False
            last = np.zeros((1, seen.shape[1]), np.uint64)
            for a, b in zip(cuts, [*cuts[1:], len(starts)]):
                if a == b:
                    continue
                lo, hi = starts[a], starts[b] if b < len(starts) else len(step)
                nodes = h[starts[a:b]]
                got = np.bitwise_or.reduceat(new[tail[step[lo:hi]]], starts[a:b] - lo, axis=0) & ~seen[nodes]
                is_new = got.any(axis=1)
                nodes, got = nodes[is_new], got[is_new]
                seen[nodes] |= got
                fresh[nodes] = got
                live[nodes] = True
                last |= np.bitwise_or.reduce(got[weight[nodes] > 0], axis=0)
            new, fresh = fresh, new  # rows that are not live are not read
            deepest[bits(last)[0, : len(seeds)] > 0] = depth
        else:
            raise RuntimeError(f"reach not finished after {max_rounds} rounds")
        n = -weight[seeds]
        for a in range(0, len(names), 4096):
            n += (weight[a : a + 4096] @ bits(seen[a : a + 4096]).astype(np.float64))[: len(seeds)]
        out = pd.DataFrame({"seed": names[seeds], "n": n.astype(np.int64), "deepest": deepest})
        return out[out["n"] > 0]

    return count


def _reach_by_rounds(e: DataFrame, s: DataFrame, among: DataFrame | None, words: int, max_rounds: int) -> DataFrame:
    """`reach_counts` where a component is beyond a task: seeds have a bit each, 64 in a word and `words` words in a row, and a
    round moves the new bits of a node along its edges. among: node, weight."""
    numbered = cut(_numbered(s, "seed"))
    bit = F.when(F.pmod("_i", F.lit(64)) == 63, F.lit(-(2**63)).cast("long")).otherwise(F.expr("shiftleft(1L, CAST(pmod(_i, 64) AS INT))"))
    word, names = F.pmod(F.floor(F.col("_i") / 64), F.lit(words)), [f"_w{i}" for i in range(words)]
    own = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(names)]
    first = numbered.withColumn("_block", F.floor(F.col("_i") / (64 * words))).groupBy(F.col("seed").alias("node"), "_block").agg(*own)
    rounds = Rounds(first)
    frontier = rounds.all().drop("round")
    for _ in range(max_rounds + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy(F.col("dst").alias("node"), "_block").agg(*[F.bit_or(w).alias(w) for w in names])
        seen = rounds.all().groupBy("node", "_block").agg(*[F.bit_or(w).alias(f"{w}_") for w in names])
        fresh = step.join(seen, ["node", "_block"], "left").select("node", "_block", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"{w}_", F.lit(0).cast("long")))).alias(w) for w in names])
        frontier = rounds.add(fresh.filter(" OR ".join(f"{w} <> 0" for w in names)))
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"reach not finished after {max_rounds} rounds")
    new = rounds.all().filter("round > 0").withColumn("weight", F.lit(1).cast("long"))
    if among is not None:
        new = new.drop("weight").join(among, "node")
    counts = new.select("_block", "round", "weight", *names).mapInPandas(_bit_counts(names), "_i long, round int, n long").groupBy("_i").agg(F.sum("n").alias("n"), F.max("round").alias("deepest"))
    return counts.join(numbered, "_i").select("seed", "n", "deepest")


def mutual_groups(edges: DataFrame, sources: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, group: nodes of one group reach each other, and group is the source (column node) among them that names it. Not all
    that reach each other need share a group: this makes a graph smaller before something exact is asked of it.

    Sources spread their names forwards, the greater over the lesser; what leads back to a source through nodes of its name is its
    group. Each walk ends where a round reaches under a hundredth of what was reached, since a group stays right without its rest.
    """
    rounds = Rounds(sources.select("node", F.col("node").alias("group")).filter("node IS NOT NULL").distinct())
    frontier = rounds.all().drop("round")
    for _ in range(max_rounds):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("group").alias("group"))
        had = rounds.all().groupBy("node").agg(F.max("group").alias("_had"))
        frontier = rounds.add(step.join(had, "node", "left").filter("_had IS NULL OR group > _had"))
        if frontier.count() * 100 <= rounds.all().count():
            break
    named = cut(rounds.all().groupBy("node").agg(F.max("group").alias("group")))
    inner = edges.join(named.select(F.col("node").alias("src"), "group"), "src").join(named.select(F.col("node").alias("dst"), "group"), ["dst", "group"])
    inner = cut(inner.select("src", "dst"))
    rounds = Rounds(named.filter("node = group"))
    frontier = rounds.all().drop("round")
    for _ in range(max_rounds):
        step = frontier.join(inner, frontier["node"] == inner["dst"]).select(F.col("src").alias("node"), "group").distinct()
        frontier = rounds.add(step.join(rounds.all().select("node"), "node", "left_anti"))
        if frontier.count() * 100 <= rounds.all().count():
            break
    return rounds.all().drop("round")


def _renamed(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """df with the group in place of a node in a column; nodes without a group stay."""
    g = groups.select(F.col("node").alias("_node"), F.col("group").alias("_group"))
    return df.join(g, df[column] == g["_node"], "left").withColumn(column, F.coalesce("_group", column)).drop("_node", "_group")


def reach_sizes(edges: DataFrame, seeds: DataFrame, among: DataFrame, few: int = 256, degree: int = 6, small: int = WHOLE) -> DataFrame:
    """seed, n: how many of `among` (column node) each seed (column seed) reaches, itself left out; seeds that reach none drop
    out. As `reach_counts` without deepest, for graphs whose nodes mostly reach each other.

    Groups of nodes that reach each other become one node, as long as that takes away half of the edges and more than `small`
    edges and `few` seeds are left. A dense graph is grouped by some `degree` edges a node first; every edge that groups do not hold stays in.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    s = cut(seeds.select("seed").filter("seed IS NOT NULL").distinct().withColumn("node", F.col("seed")))
    size = cut(among.select("node").filter("node IS NOT NULL").distinct().withColumn("own", F.col("node")))
    n = e.count()
    while n > small and s.select("node").distinct().count() > few:
        nodes = e.agg(F.approx_count_distinct("src")).first()[0]
        part = cut(e.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(n)) < degree * nodes)) if n > 2 * degree * nodes else e
        groups = cut(mutual_groups(part, s.select("node")))
        e = cut(_renamed(_renamed(e, "src", groups), "dst", groups).filter("src <> dst").distinct())
        s, size = cut(_renamed(s, "node", groups)), cut(_renamed(size, "node", groups))
        before, n = n, e.count()
        if 2 * n > before:
            break
    weight = cut(size.groupBy("node").agg(F.count("*").alias("weight")))
    far = reach_counts(e, s.select(F.col("node").alias("seed")), weight).select(F.col("seed").alias("node"), "n")
    own = size.select(F.col("own").alias("seed"), F.lit(1).alias("self"))
    out = s.join(far, "node", "left").join(weight, "node", "left").join(own, "seed", "left")
    out = out.select("seed", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(0)) - F.coalesce("self", F.lit(0))).alias("n"))
    return out.filter("n > 0")


def _numbered(seeds: DataFrame, *by: str) -> DataFrame:
    """seeds with _i: numbers from 0 without gaps in the order of `by`, so that neighbours share words; no partition holds all."""
    p = cut(seeds.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    place = p.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    n = p.groupBy("_p").agg(F.count("*").alias("n"))
    # one row for each partition
    start = n.withColumn("_s", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return place.join(start.select("_p", "_s"), "_p").select(*seeds.columns, (F.col("_s") + F.col("_r") - 1).alias("_i"))


def _bit_counts(names: list[str]):
    """Counts the set bits of each seed and round over a partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for (block, depth), part in pdf.groupby(["_block", "round"]):
                bits = np.ascontiguousarray(part[names].to_numpy(np.int64)).astype("<i8", copy=False).view(np.uint8)
                n = part["weight"].to_numpy(np.int64) @ np.unpackbits(bits, axis=1, bitorder="little")
                total[block, depth] = total.get((block, depth), 0) + n
        for (block, depth), n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"_i": at + block * 64 * len(names), "round": np.int32(depth), "n": n[at]})

    return count


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(reverse(edges), seeds)


def components(edges: DataFrame, vertices: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, component: the least node that links lead to. Least labels spread along edges, then jump to their own labels."""
    e = cut(undirected(edges))
    labels = cut(vertices.select("node").distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = e.join(labels, e["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("least"))
        spread = labels.join(near, labels["node"] == near["src"], "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        up = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = cut(spread.join(up, spread["next"] == up["_n"], "left").select("node", "component", F.coalesce("_c", "next").alias("next")))
        done = jumped.filter("component <> next").isEmpty()
        labels = jumped.select("node", F.col("next").alias("component"))
        if done:
            return labels
    raise RuntimeError(f"components not finished after {max_rounds} rounds")


def isolates(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.join(undirected(edges).select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """src, dst, hops, path for pairs (src, dst) that a path joins; of equally short paths the least, node by node."""
    e = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    goals = cut(pairs.select("src", "dst").distinct())
    frontier = cut(goals.select("src").distinct().select("src", F.col("src").alias("node"), F.array("src").alias("path")))
    visited, open_, out = frontier.select("src", "node"), goals, None
    for hops in range(max_rounds):
        hit = open_.join(frontier, (open_["src"] == frontier["src"]) & (open_["dst"] == frontier["node"])).select(open_["src"], "dst", F.lit(hops).alias("hops"), "path")
        out = hit if out is None else out.unionByName(hit)
        open_ = cut(open_.join(frontier.select("src", F.col("node").alias("dst")), ["src", "dst"], "left_anti"))
        alive = frontier.join(open_.select("src").distinct(), "src", "left_semi")
        step = alive.join(e, alive["node"] == e["a"]).groupBy("src", "b").agg(F.min("path").alias("p"))
        step = step.join(visited.withColumnRenamed("node", "b"), ["src", "b"], "left_anti")
        frontier = cut(step.select("src", F.col("b").alias("node"), F.concat("p", F.array("b")).alias("path")))
        if frontier.isEmpty():
            return out
        visited = cut(visited.unionByName(frontier.select("src", "node")))
    raise RuntimeError(f"paths not finished after {max_rounds} rounds")


def contract(edges: DataFrame, tagged: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Edges between tagged nodes (column node) along walks whose inner nodes are not tagged; no edges to itself."""
    e = cut(edges.select("src", "dst").distinct())
    marks = cut(tagged.select("node").distinct())
    frontier = cut(marks.select(F.col("node").alias("seed"), "node"))
    visited, found = frontier, None
    for _ in range(max_rounds):
        step = frontier.join(e, frontier["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        new = cut(step.join(visited, ["seed", "node"], "left_anti"))
        if new.isEmpty():
            return (found if found is not None else new).select(F.col("seed").alias("src"), F.col("node").alias("dst"))
        arrived = new.join(marks, "node", "left_semi").select("seed", "node")
        found = arrived if found is None else found.unionByName(arrived)
        visited = cut(visited.unionByName(new))
        frontier = new.join(marks, "node", "left_anti").select("seed", "node")
    raise RuntimeError(f"contraction not finished after {max_rounds} rounds")


def nearest_anchor(edges: DataFrame, anchors: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, anchor, depth: each node goes to the anchor it meets first, of several to the least; anchors are not claimed."""
    e = cut(undirected(edges))
    starts = cut(anchors.select("node").distinct())
    claimed = cut(starts.select("node", F.col("node").alias("anchor"), F.lit(0).alias("depth")))
    frontier = claimed
    for depth in range(1, max_rounds):
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy("dst").agg(F.min("anchor").alias("anchor"))
        frontier = cut(step.select(F.col("dst").alias("node"), "anchor", F.lit(depth).alias("depth")).join(claimed, "node", "left_anti"))
        if frontier.isEmpty():
            return claimed.filter("depth > 0")
        claimed = cut(claimed.unionByName(frontier))
    raise RuntimeError(f"partition not finished after {max_rounds} rounds")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other, side: the successors and predecessors of nodes (column node)."""
    e = edges.select("src", "dst").distinct()
    down = nodes.join(e, nodes["node"] == e["src"]).select("node", F.col("dst").alias("other"), F.lit("successor").alias("side"))
    up = nodes.join(e, nodes["node"] == e["dst"]).select("node", F.col("src").alias("other"), F.lit("predecessor").alias("side"))
    return down.unionByName(up)


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree over distinct edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def loop_edges(objects: DataFrame, loop: str, rank: str, key: str) -> DataFrame:
    """Consecutive members of a loop, by rank and then key."""
    w = Window.partitionBy(loop).orderBy(rank, key)
    return objects.select(loop, F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).filter("dst IS NOT NULL")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    e = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return e.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def root_causes(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Active alarms (column node) -> node, is_root, root, explains: roots have no active ancestor; others go to the first root
    by (most explained, node). On a set where all stand in cycles every alarm is its own root."""
    a = cut(active.select("node").distinct())
    reach = closure(within(edges, a), a.select(F.col("node").alias("seed"))).select("seed", "node").filter("seed <> node")
    reach = cut(reach)
    roots = a.join(reach.select("node").distinct(), "node", "left_anti")
    n = reach.groupBy("seed").agg(F.count("*").alias("explains"))
    ranked = roots.join(n, roots["node"] == n["seed"], "left").select("node", F.coalesce("explains", F.lit(0)).alias("explains"))
    ranked = cut(ranked)
    best = reach.join(ranked.select(F.col("node").alias("seed"), "explains"), "seed").groupBy("node").agg(F.min(F.struct(-F.col("explains"), "seed")).alias("b"))
    out = a.join(ranked, "node", "left").join(best, "node", "left")
    is_root = F.col("explains").isNotNull() | F.col("b").isNull()
    return out.select("node", is_root.alias("is_root"), F.when(is_root, F.col("node")).otherwise(F.col("b.seed")).alias("root"), F.coalesce("explains", F.lit(0)).alias("explains"))


def candidate_brief(edges: DataFrame, active: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Active alarms (node, t) -> candidates in order: node, explains, members, t, detached.

    The active subgraph is condensed into strongly connected components (mutual reachability); a component that no other
    one reaches is a candidate, shown by the member that explains most active alarms in the whole graph (ties: the least).
    An alarm that rang before all its active ancestors is a candidate too. Columns: explains = active alarms reached.
    """
    a = cut(active.select("node", "t").groupBy("node").agg(F.min("t").alias("t")))
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    inner = cut(closure(within(edges, a), a.select(F.col("node").alias("seed"))).select("seed", "node").filter("seed <> node"))
    full = reach_sizes(edges, a.select(F.col("node").alias("seed")), a).select(F.col("seed").alias("node"), F.col("n").alias("explains"))
    explains = cut(a.join(full, "node", "left").select("node", "t", F.coalesce("explains", F.lit(0)).alias("explains")))
    back = inner.select(F.col("node").alias("seed"), F.col("seed").alias("node"))
    mutual = inner.intersect(back).groupBy(F.col("seed")).agg(F.min("node").alias("other")).withColumnRenamed("seed", "node")
    group = explains.join(mutual, "node", "left")
    group = cut(group.select("node", F.least("node", F.coalesce("other", "node")).alias("scc")))
    g1, g2 = group.select(F.col("node").alias("seed"), F.col("scc").alias("from")), group.select("node", F.col("scc").alias("to"))
    entered = inner.join(g1, "seed").join(g2, "node").filter("`from` <> `to`").select(F.col("to").alias("scc")).distinct()
    sources = cut(group.join(entered, "scc", "left_anti").join(explains, "node"))
    rep = sources.groupBy("scc").agg(F.min(F.struct((-F.col("explains")).alias("less"), "node")).alias("r"), F.count("*").alias("members"), F.min("t").alias("t"))
    first = rep.select(F.col("r.node").alias("node"), (-F.col("r.less")).alias("explains"), "members", "t", F.lit(False).alias("detached"))
    early = inner.join(explains.select(F.col("node").alias("seed"), F.col("t").alias("at")), "seed").groupBy("node").agg(F.min("at").alias("earliest"))
    rest = explains.join(sources.select("node"), "node", "left_anti").join(early, "node").filter(F.col("t") + tolerance < F.col("earliest"))
    second = rest.select("node", "explains", F.lit(1).cast("long").alias("members"), "t", F.lit(True).alias("detached"))
    return first.unionByName(second).orderBy(F.desc("explains"), F.asc_nulls_last("t"), "node")


def failure_impact(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """node, affected: what a removed node cuts off, all the pieces next to it but the largest. Component by component in a
    linear-time pass for cut vertices; a component must fit one task's memory."""
    comp = components(edges, vertices)
    e = undirected(edges)
    rows = e.join(comp.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")
    kind = vertices.schema["node"].dataType.simpleString()

    def impacts(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for s, d in zip(pdf["src"], pdf["dst"]):
            if s != d:
                near.setdefault(s, []).append(d)
        low, size, seen, cut_off = {}, {}, {}, {}
        root = min(near)
        stack = [(root, None, iter(sorted(near[root])))]
        seen[root] = low[root] = 0
        size[root], cut_off[root] = 1, []
        while stack:
            v, up, it = stack[-1]
            w = next(it, None)
            if w is None:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[v])
                    size[up] += size[v]
                    if low[v] >= seen[up]:
                        cut_off[up].append(size[v])
                continue
            if w not in seen:
                seen[w] = low[w] = len(seen)
                size[w], cut_off[w] = 1, []
                stack.append((w, v, iter(sorted(near[w]))))
            elif w != up:
                low[v] = min(low[v], seen[w])
        n = len(near)
        out = []
        for v in near:
            pieces = list(cut_off[v])
            rest = n - 1 - sum(pieces)
            if rest:
                pieces.append(rest)
            out.append((v, sum(pieces) - max(pieces, default=0)))
        return pd.DataFrame(out, columns=["node", "affected"])

    linked = rows.groupBy("component").applyInPandas(impacts, f"node {kind}, affected long")
    return linked.unionByName(isolates(edges, vertices).select("node", F.lit(0).cast("long").alias("affected")))
