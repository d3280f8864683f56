"""Convex outlines of groups of points in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex outline of (x, y) rows, counter-clockwise from the leftmost (of these the lowest) one; points on an edge are none."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(p: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in p:
            while len(out) > 1:
                u, v = out[-1] - out[-2], q - out[-1]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def outlines(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, place, x, y): the corners of each group's convex outline, counter-clockwise from the leftmost one, places counting from 1.

    Every task sends on the corners of its own points only, some dozens a group, as no other point can be one of the whole. Rows with a null group or
    with a coordinate that is null or not finite are left out; repeated points count once; a group of one or two points has these as its outline.
    """
    good = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("g is not null and x is not null and y is not null")
    kind = good.schema["g"].dataType.simpleString()

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, np.ndarray] = {}
        for b in batches:
            b = b[np.isfinite(b["x"]) & np.isfinite(b["y"])]
            for g, part in b.groupby("g"):
                mine = part[["x", "y"]].to_numpy()
                kept[g] = corners(np.vstack([kept[g], mine]) if g in kept else mine)
        for g, c in kept.items():
            yield pd.DataFrame({"g": [g] * len(c), "x": c[:, 0], "y": c[:, 1]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        c = corners(part[["x", "y"]].to_numpy())
        return pd.DataFrame({"g": [part["g"].iloc[0]] * len(c), "place": range(1, len(c) + 1), "x": c[:, 0], "y": c[:, 1]})

    near = good.mapInPandas(own, f"g {kind}, x double, y double")
    return near.groupBy("g").applyInPandas(whole, f"g {kind}, place int, x double, y double").withColumnRenamed("g", group)
