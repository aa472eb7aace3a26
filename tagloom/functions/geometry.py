"""Column functions over curves: array<array<struct<x:double,y:double>>>, a list of point lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent(curves: Column) -> Column:
    """struct(w, h) of the box around all points; 0 where there are none."""
    points = F.flatten(curves)
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    span = lambda v: F.coalesce(F.array_max(v) - F.array_min(v), F.lit(0.0))
    return F.struct(span(x).alias("w"), span(y).alias("h"))


def segment_lengths(curves: Column) -> Column:
    def of(points: Column) -> Column:
        pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
        return pairs

    return F.flatten(F.transform(curves, of))


def fingerprint(curves: Column) -> Column:
    """struct(aspect, q10, q50, q90): width by height, and sorted segment lengths by the longest at 10, 50 and 90 %."""
    box, lengths = extent(curves), F.array_sort(segment_lengths(curves))
    n, longest = F.size(lengths), F.array_max(lengths)

    def at(share: float) -> Column:
        i = F.least(F.floor(n * share), n - 1).cast("int")
        return F.when((n > 0) & (longest > 0), F.bround(F.get(lengths, i) / longest, 3)).otherwise(0.0)

    aspect = F.when(box["h"] > 0, F.bround(box["w"] / box["h"], 3)).otherwise(0.0)
    return F.struct(aspect.alias("aspect"), at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"))


def signature(curves: Column, quantum: float = 0.5) -> Column:
    """A text that curves share which agree when moved to the origin and rounded to the quantum."""
    points = F.flatten(curves)
    x0, y0 = F.array_min(F.transform(points, lambda p: p["x"])), F.array_min(F.transform(points, lambda p: p["y"]))
    one = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(",", F.bround((p["x"] - x0) / quantum).cast("int").cast("string"), F.bround((p["y"] - y0) / quantum).cast("int").cast("string"))), " ")
    return F.array_join(F.array_sort(F.transform(curves, one)), ";")
