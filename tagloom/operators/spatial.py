"""Boxes and points on drawings: nearest in a window or radius, counts, anti joins, greedy matching and suppression.

Range searches meet on tiles with a rim (a cogroup), never on a cross product of a drawing; `planar` searches within a tile
without listing all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import planar


def _tiles(left: DataFrame, right: DataFrame, by: list[str], reach: tuple[float, float], search, schema: str) -> DataFrame:
    """search(left, right) as Arrow tables for each tile of a `by`, four reaches wide: a left row (lx, ly) is in one tile, a right
    row (rx, ry) in all that its reach touches. Rows without a place or with a null in `by` are in none."""
    size = [4.0 * r or 1.0 for r in reach]

    def placed(df: DataFrame, x: str, y: str) -> DataFrame:
        d = df.withColumn(x, F.col(x).cast("double")).withColumn(y, F.col(y).cast("double")).dropna(subset=[*by, x, y])
        return d.filter((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))

    def around(c: str, r: float, wide: float) -> Column:
        pad = r * 1.000001 + F.abs(c) * 1e-12
        return F.sequence(F.floor((F.col(c) - pad) / wide), F.floor((F.col(c) + pad) / wide))

    a = placed(left, "lx", "ly").withColumn("_tx", F.floor(F.col("lx") / size[0])).withColumn("_ty", F.floor(F.col("ly") / size[1]))
    b = placed(right, "rx", "ry").withColumn("_tx", F.explode(around("rx", reach[0], size[0]))).withColumn("_ty", F.explode(around("ry", reach[1], size[1])))
    keys = [*by, "_tx", "_ty"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(search, schema)


def _xy(table: pa.Table, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table[c].to_numpy() for c in (x, y))


def _rank(table: pa.Table, other: str) -> np.ndarray:
    order = pc.sort_indices(table[other]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def nearest_in_window(left: DataFrame, right: DataFrame, by: list[str], key: str, other: str, reach: tuple[float, float]) -> DataFrame:
    """For each left key the right row nearest in y within the window, ties by `other`; left rows without one drop out."""

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        best, dy = planar.nearest_in_window(*_xy(a, "lx", "ly"), *_xy(b, "rx", "ry"), _rank(b, other), reach)
        hit = np.flatnonzero(best >= 0)
        t = a.select([*by, key]).take(hit)
        return t.append_column(other, b[other].take(best[hit])).append_column("dy", pa.array(dy[hit]))

    p = _tiles(left.select(*by, key, "lx", "ly"), right.select(*by, other, "rx", "ry"), by, reach, search, f"{_types(left, [*by, key])}, {_types(right, [other])}, dy double")
    return p.groupBy(*by, key).agg(F.min(F.struct("dy", other)).alias("m")).select(*by, key, f"m.{other}", "m.dy")


def nearest_in_radius(left: DataFrame, right: DataFrame, by: list[str], key: str, other: str, radius: float) -> DataFrame:
    """Each left row with the nearest right row no further than radius, or null."""

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        lx, ly = _xy(a, "lx", "ly")
        rx, ry = _xy(b, "rx", "ry")
        best = planar.nearest_in_radius(lx, ly, rx, ry, _rank(b, other), radius)
        hit = np.flatnonzero(best >= 0)
        j = best[hit]
        d2 = (lx[hit] - rx[j]) * (lx[hit] - rx[j]) + (ly[hit] - ry[j]) * (ly[hit] - ry[j])
        return a.select([*by, key]).take(hit).append_column("d2", pa.array(d2)).append_column(other, b[other].take(j))

    p = _tiles(left.select(*by, key, "lx", "ly"), right.select(*by, other, "rx", "ry"), by, (radius, radius), search, f"{_types(left, [*by, key])}, d2 double, {_types(right, [other])}")
    best = p.groupBy(*by, key).agg(F.min(F.struct("d2", other)).alias("m"))
    return left.select(*by, key).join(best, [*by, key], "left").select(*by, key, F.col(f"m.{other}").alias(other))


def radius_count(points: DataFrame, by: list[str], key: str, x: str, y: str, radius: float) -> DataFrame:
    """How many other points lie within the radius of each."""
    a = points.select(*by, key, F.col(x).alias("lx"), F.col(y).alias("ly"))
    b = points.select(*by, F.col(key).alias("_other"), F.col(x).alias("rx"), F.col(y).alias("ry")).dropna(subset=["_other"])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        left, right = _xy(a, "lx", "ly"), _xy(b, "rx", "ry")
        codes = pa.chunked_array([*a[key].chunks, *b["_other"].chunks], a.schema.field(key).type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = planar.count_in_radius(*left, *right, radius) - planar.count_same(*left, codes[: len(a)], *right, codes[len(a) :], radius)
        return a.select([*by, key]).append_column("n", pa.array(n))

    p = _tiles(a.dropna(subset=[key]), b, by, (radius, radius), search, f"{_types(a, [*by, key])}, n long")
    n = p.groupBy(*by, key).agg(F.sum("n").alias("n"))
    return a.select(*by, key).join(n, [*by, key], "left").select(*by, key, F.coalesce("n", F.lit(0)).alias("n"))


def without_near(left: DataFrame, right: DataFrame, by: list[str], key: str, radius: float) -> DataFrame:
    """Left rows with no right row within the radius."""
    return nearest_in_radius(left, right.withColumn("_hit", F.lit(1)), by, key, "_hit", radius).filter("_hit IS NULL").select(*by, key)


def greedy_match(truth: DataFrame, found: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Truth points (by, t, tx, ty) in order of t each take the nearest free detection (by, f, fx, fy), of equally near ones the
    least f; order decides, so a group is one task's work: by, t, f (null if none is left in reach, or the point has no place).
    Detections without a place are never taken. Within a group only cells a radius wide around a point are searched."""
    schema = ", ".join(f"{c} {truth.schema[c].dataType.simpleString()}" for c in by) + f", t {truth.schema['t'].dataType.simpleString()}, f {found.schema['f'].dataType.simpleString()}"
    wide = max(float(radius), 1e-9)

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free: dict[tuple, dict[int, tuple]] = {}
        for i, (f, x, y) in enumerate(zip(b["f"], b["fx"], b["fy"])):
            if x == x and y == y:
                free.setdefault((math.floor(x / wide), math.floor(y / wide)), {})[i] = (f, x, y)
        out = []
        for t, x, y in sorted(zip(a["t"], a["tx"], a["ty"])):
            best = None
            if x == x and y == y:
                col, row = math.floor(x / wide), math.floor(y / wide)
                cells = [(c, r) for c in (col - 1, col, col + 1) for r in (row - 1, row, row + 1)]
                near = (((fx - x) ** 2 + (fy - y) ** 2, f, i, cell) for cell in cells for i, (f, fx, fy) in free.get(cell, {}).items())
                best = min((n for n in near if n[0] <= radius * radius), default=None)
            out.append((*key, t, free[best[3]].pop(best[2])[0] if best else None))
        return pd.DataFrame(out, columns=[*by, "t", "f"])

    return truth.groupBy(*by).cogroup(found.groupBy(*by)).applyInPandas(match, schema)


def suppress(boxes: DataFrame, by: list[str], overlap: float = 0.35) -> DataFrame:
    """Boxes (by, id, conf, x0, y0, x1, y1) that stay: by falling confidence, each drops those that share over `overlap` of the
    smaller area with it. Sequential within a group."""
    cols = [*by, "id", "conf", "x0", "y0", "x1", "y1"]
    schema = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in cols)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "id"], ascending=[False, True])
        kept: list[tuple] = []
        for r in pdf.itertuples(index=False):
            area = (r.x1 - r.x0) * (r.y1 - r.y0)
            clash = False
            for k in kept:
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                least = min(area, (k.x1 - k.x0) * (k.y1 - k.y0))
                if w > 0 and h > 0 and least > 0 and w * h / least > overlap:
                    clash = True
                    break
            if not clash:
                kept.append(r)
        return pd.DataFrame(kept, columns=list(pdf.columns))[cols]

    return boxes.select(*cols).groupBy(*by).applyInPandas(keep, schema)


def pack(rows: DataFrame, by: str, order: str, size: str, cap: float) -> DataFrame:
    """rows with pack: filled in order until the next would pass the cap; a sum that starts anew, so a group is sequential."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", pack long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        held, n, out = 0.0, 0, []
        for s in pdf[size]:
            if held and held + s > cap:
                held, n = 0.0, n + 1
            held += s
            out.append(n)
        return pdf.assign(pack=out)

    return rows.groupBy(by).applyInPandas(fill, schema)
