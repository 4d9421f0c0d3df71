"""Geometries within areas, both in columns: a join by grid cells, then the exact test on the pairs that are left."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import _within, parse_polygon, shape


def _level(size: float) -> int:
    """The power of two that a box of this size is measured by."""
    return int(np.ceil(np.log2(size))) if size > 0 else -1000


def _box_of(text: str | None, wkt: bool):
    if not isinstance(text, str):
        return None
    try:
        if wkt:
            parts = parse_polygon(text)
        else:
            s = shape(json.loads(text))
            parts = [*s.points, *s.lines, *(r for p in s.polygons for r in p)]
        points = np.vstack(parts)
        return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())
    except (ValueError, KeyError, TypeError, IndexError):
        return None


_BOX = "struct<x0:double,y0:double,x1:double,y1:double,level:int>"


def _boxes(wkt: bool):
    @F.pandas_udf(_BOX)
    def boxes(texts: pd.Series) -> pd.DataFrame:
        got = [_box_of(t, wkt) for t in texts]
        out = pd.DataFrame([b if b else (np.nan,) * 4 for b in got], columns=["x0", "y0", "x1", "y1"])
        out["level"] = [_level(max(b[2] - b[0], b[3] - b[1])) if b else None for b in got]
        out["level"] = out["level"].astype("Int32")
        return out

    return boxes


@F.pandas_udf(T.BooleanType())
def _holds(geometries: pd.Series, areas: pd.Series) -> pd.Series:
    kept: dict[str, tuple] = {}
    out = []
    for g, wkt in zip(geometries, areas):
        if wkt not in kept:
            if len(kept) > 10_000:
                kept.clear()
            rings = parse_polygon(wkt)
            box = np.vstack(rings)
            kept[wkt] = rings, box.min(axis=0), box.max(axis=0)
        try:
            out.append(_within(json.loads(g), *kept[wkt]))
        except (ValueError, KeyError, TypeError, IndexError):
            out.append(False)
    return pd.Series(out, dtype=bool)


def spatial_join(geometries: DataFrame, geometry: str, areas: DataFrame, area: str) -> DataFrame:
    """Rows of ``geometries`` (GeoJSON column) with the rows of ``areas`` (WKT polygon column) that they are within.

    An area is put into the at most four cells that its box touches in a grid as coarse as the box; a geometry into the
    one cell of its box's lower corner in each of the grids that areas have (a few dozen, whatever the number of areas).
    Cells are joined by equality, boxes compared natively, and only what is left is tested exactly.
    Nulls and what isn't a geometry join nothing. Columns must differ.
    """
    spread = areas.withColumn("__a", _boxes(True)(F.col(f"`{area}`"))).where("__a.level is not null")
    size = F.pow(F.lit(2.0), F.col("__a.level"))
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("bigint"), F.floor(F.col(hi) / size).cast("bigint"))
    spread = spread.withColumn("__i", F.explode(cells("__a.x0", "__a.x1"))).withColumn("__j", F.explode(cells("__a.y0", "__a.y1"))).withColumn("__l", F.col("__a.level"))
    levels = [r[0] for r in spread.select("__l").distinct().collect()]  # powers of two in use: some dozens at most
    if not levels:
        return geometries.join(areas.where(F.lit(False)), F.lit(True))
    own = geometries.withColumn("__g", _boxes(False)(F.col(f"`{geometry}`"))).where("__g.level is not null").withColumn("__l", F.explode(F.array(*map(F.lit, levels))))
    size = F.pow(F.lit(2.0), F.col("__l"))
    own = own.withColumn("__i", F.floor(F.col("__g.x0") / size).cast("bigint")).withColumn("__j", F.floor(F.col("__g.y0") / size).cast("bigint"))
    near = own.join(spread, ["__l", "__i", "__j"]).where("__g.x0 >= __a.x0 and __g.y0 >= __a.y0 and __g.x1 <= __a.x1 and __g.y1 <= __a.y1")
    return near.where(_holds(F.col(f"`{geometry}`"), F.col(f"`{area}`"))).drop("__a", "__g", "__i", "__j", "__l")
