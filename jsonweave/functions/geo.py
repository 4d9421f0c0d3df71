"""Geometries as GeoJSON text: type tests (native), WKT both ways, and ``within`` as Arrow batch functions.

``within`` polygons (a WKT constant, POLYGON or MULTIPOLYGON): no part of the geometry is outside, and its
interior meets theirs. So a point or a line on the boundary is not within; a polygon is within an equal one; one
drawn around a hole is not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nesting of coordinates by type of geometry.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
_NAMES = {k.upper(): k for k in (*DEPTH, "GeometryCollection")}


class WktError(ValueError):
    pass


def parse_wkt(text: str) -> dict:
    """WKT of any type -> a GeoJSON geometry. EMPTY gives no coordinates; Z and M values are kept as they stand."""
    tokens = re.findall(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]|\S", text.strip().strip("\"'"))
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or want not in (None, tokens[at]):
            raise WktError(f"{want or 'more'} is expected in {text!r}")
        at += 1
        return tokens[at - 1]

    def several(one: Callable):
        take("(")
        out = [one()]
        while at < len(tokens) and tokens[at] == ",":
            take(",")
            out.append(one())
        take(")")
        return out

    def point():
        out = []
        try:
            while at < len(tokens) and tokens[at] not in ("(", ")", ","):
                out.append(float(take()))
        except ValueError:
            raise WktError(f"a number is expected in {text!r}") from None
        if len(out) < 2:
            raise WktError(f"two numbers are expected in {text!r}")
        return out

    def bracketed_point():
        if at < len(tokens) and tokens[at] == "(":
            return several(point)[0]
        return point()

    def geometry() -> dict:
        kind = _NAMES.get(take().upper())
        if kind is None:
            raise WktError(f"not a WKT geometry: {text!r}")
        if at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
            take()
        if at < len(tokens) and tokens[at].upper() == "EMPTY":
            take()
            return {"type": kind, "geometries" if kind == "GeometryCollection" else "coordinates": []}
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": several(geometry)}
        line, area = lambda: several(point), lambda: several(lambda: several(point))
        read = {"Point": lambda: several(point)[0], "MultiPoint": lambda: several(bracketed_point), "LineString": line, "MultiLineString": area, "Polygon": area, "MultiPolygon": lambda: several(area)}
        return {"type": kind, "coordinates": read[kind]()}

    out = geometry()
    if at != len(tokens):
        raise WktError(f"{tokens[at]!r} isn't expected in {text!r}")
    return out


def _number(x: float, digits: int | None) -> str:
    x = round(float(x), digits) if digits is not None else float(x)
    return repr(int(x)) if x == int(x) else repr(x)


def write_wkt(geometry: dict, digits: int | None = None) -> str:
    """A GeoJSON geometry -> WKT."""
    kind = geometry["type"]
    if kind == "GeometryCollection":
        inner = ", ".join(write_wkt(g, digits) for g in geometry["geometries"])
        return f"{kind.upper()} ({inner})" if inner else f"{kind.upper()} EMPTY"
    c = geometry["coordinates"]
    if not c:
        return f"{kind.upper()} EMPTY"

    def write(x, depth: int) -> str:
        return " ".join(_number(v, digits) for v in x) if depth == 0 else "(" + ", ".join(write(y, depth - 1) for y in x) + ")"

    if kind in ("Point", "MultiPoint"):
        points = [c] if kind == "Point" else c
        inner = ", ".join(f"({write(p, 0)})" for p in points)
        return f"{kind.upper()} " + (inner if kind == "Point" else f"({inner})")
    return f"{kind.upper()} " + write(c, DEPTH[kind])


def write_geojson(geometry: dict, digits: int = 7) -> str:
    """GeoJSON text with rounded coordinates."""

    def fixed(x):
        return [fixed(y) for y in x] if isinstance(x, list) else json.loads(_number(x, digits))

    if geometry["type"] == "GeometryCollection":
        return json.dumps({"type": geometry["type"], "geometries": [json.loads(write_geojson(g, digits)) for g in geometry["geometries"]]})
    return json.dumps({"type": geometry["type"], "coordinates": fixed(geometry["coordinates"])})


def _rings(polygon: list) -> list[np.ndarray]:
    """A polygon's rings, each closed."""
    out = []
    for ring in polygon:
        points = np.array([p[:2] for p in ring], float)
        out.append(points if (points[0] == points[-1]).all() else np.vstack([points, points[:1]]))
    return out


def parse_polygon(wkt: str) -> list[np.ndarray]:
    """All rings of a POLYGON or MULTIPOLYGON, each closed; a place is inside if an odd number of them surround it."""
    g = parse_wkt(wkt)
    if g["type"] not in ("Polygon", "MultiPolygon") or not g["coordinates"]:
        raise WktError(f"not a WKT polygon: {wkt!r}")
    return [r for p in (g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]) for r in _rings(p)]


def locate(points: np.ndarray, rings: list[np.ndarray], slack: float = 0.0) -> np.ndarray:
    """1 inside, 0 on the boundary (or as near as ``slack``), -1 outside, for each point."""
    x, y = points[:, 0:1], points[:, 1:2]
    inside = np.zeros(len(points), bool)
    edge = np.zeros(len(points), bool)
    for ring in rings:
        ax, ay, bx, by = _edges([ring]).T
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        between = (np.minimum(ax, bx) - slack <= x) & (x <= np.maximum(ax, bx) + slack) & (np.minimum(ay, by) - slack <= y) & (y <= np.maximum(ay, by) + slack)
        edge |= ((np.abs(turn) <= slack * np.hypot(bx - ax, by - ay)) & between).any(axis=1)
        crosses = ((ay > y) != (by > y)) & np.where(by > ay, turn > 0, turn < 0)
        inside ^= (crosses.sum(axis=1) % 2).astype(bool)
    return np.where(edge, 0, np.where(inside, 1, -1))


@dataclass(frozen=True)
class Shape:
    """Parts of a geometry: points, lines, and polygons as their rings."""

    points: list[np.ndarray]
    lines: list[np.ndarray]
    polygons: list[list[np.ndarray]]


def shape(geometry: dict) -> Shape:
    out = Shape([], [], [])
    kind = geometry["type"]
    if kind == "GeometryCollection":
        for g in geometry["geometries"]:
            own = shape(g)
            for mine, more in zip((out.points, out.lines, out.polygons), (own.points, own.lines, own.polygons)):
                mine += more
        return out
    c, single = geometry["coordinates"], not kind.startswith("Multi")
    for part in [c] if single else c:
        if not part:
            continue
        if kind.endswith("Point"):
            out.points.append(np.array([part[:2]], float))
        elif kind.endswith("LineString"):
            out.lines.append(np.array([p[:2] for p in part], float))
        else:
            out.polygons.append(_rings(part))
    return out


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    return np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])


def _midpoints(runs: list[np.ndarray], edges: np.ndarray) -> np.ndarray:
    """A place in every stretch of ``runs`` between all its crossings with ``edges``."""
    out = []
    a, e = edges[:, :2], edges[:, 2:] - edges[:, :2]
    for p, q in ((p, q) for run in runs for p, q in zip(run[:-1], run[1:])):
        d, w = q - p, a - p
        det = d[0] * e[:, 1] - d[1] * e[:, 0]
        cross = det != 0
        t = (w[cross, 0] * e[cross, 1] - w[cross, 1] * e[cross, 0]) / det[cross]
        u = (w[cross, 0] * d[1] - w[cross, 1] * d[0]) / det[cross]
        cuts = [t[(0 <= t) & (t <= 1) & (0 <= u) & (u <= 1)], [0.0, 1.0]]
        if (flat := ~cross).any() and (size := float(d @ d)):  # edges along the same line cut where they end
            for end in (edges[flat, :2], edges[flat, 2:]):
                s = ((end - p) @ d) / size
                cuts.append(s[(0 < s) & (s < 1) & (np.abs((end[:, 0] - p[0]) * d[1] - (end[:, 1] - p[1]) * d[0]) <= 1e-12 * size)])
        at = np.unique(np.concatenate(cuts))
        out.append(p + ((at[:-1] + at[1:]) / 2)[:, None] * d)
    return np.vstack(out) if out else np.zeros((0, 2))


def _inner_point(rings: list[np.ndarray]) -> np.ndarray | None:
    """A place in the interior of a polygon, on the level line that crosses it widest."""
    levels = np.unique(np.concatenate([r[:, 1] for r in rings]))
    edges, best = _edges(rings), None
    for y in (levels[:-1] + levels[1:]) / 2:
        x0, y0, x1, y1 = edges.T
        hit = (y0 > y) != (y1 > y)
        x = np.sort(x0[hit] + (y - y0[hit]) / (y1[hit] - y0[hit]) * (x1[hit] - x0[hit]))
        if len(x) > 1:
            gaps = x[1::2] - x[::2][: len(x) // 2]
            k = int(gaps.argmax())
            if gaps[k] > 0 and (best is None or gaps[k] > best[0]):
                best = gaps[k], np.array([x[2 * k] + gaps[k] / 2, y])
    return None if best is None else best[1]


def _within(geometry: dict, rings: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> bool:
    s = shape(geometry)
    runs = [*s.lines, *(r for p in s.polygons for r in p)]
    every = [*s.points, *runs]
    if not every or any((p < low).any() or (p > high).any() for p in every):
        return False
    corners = locate(np.vstack(every), rings)
    if (corners < 0).any():
        return False
    slack = 1e-12 * float(np.abs(np.concatenate([low, high])).max())  # places between crossings are rounded
    middles = locate(_midpoints(runs, _edges(rings)), rings, slack) if runs else np.zeros(0, int)
    if (middles < 0).any():
        return False
    interior = bool((corners > 0).any() or (middles > 0).any())
    for polygon in s.polygons:
        inner = _inner_point(polygon)
        if inner is not None and locate(inner[None], rings)[0] <= 0:
            return False
        interior |= inner is not None
        # where the boundary runs through the polygon's interior, there is outside on its other side
        if (locate(_midpoints(rings, _edges(polygon)), polygon, slack) > 0).any():
            return False
    return interior


def geometry_type(geometry: Column) -> Column:
    return F.lower(F.get_json_object(geometry.cast("string"), "$.type"))


def _converted(geometry: Column, convert: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else convert(t)
            except (ValueError, KeyError, TypeError, IndexError):
                return None

        return texts.map(one, na_action=None).astype(object)

    return each(geometry.cast("string"))


def geojson_to_wkt(geometry: Column, digits: int | None = None) -> Column:
    """WKT of GeoJSON texts; null of what isn't a geometry."""
    return _converted(geometry, lambda t: write_wkt(json.loads(t), digits))


def wkt_to_geojson(wkt: Column, digits: int = 7) -> Column:
    """GeoJSON of WKT texts; null of what isn't WKT."""
    return _converted(wkt, lambda t: write_geojson(parse_wkt(t), digits))


def geometry_within(geometry: Column, wkt: str) -> Column:
    rings = parse_polygon(wkt)
    box = np.vstack(rings)
    low, high = box.min(axis=0), box.max(axis=0)

    @F.pandas_udf("boolean")
    def within(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        points, at = [], []
        for i, t in enumerate(texts):
            try:
                g = json.loads(t) if t else None
                if g and g["type"] == "Point":
                    points.append([float(x) for x in g["coordinates"][:2]])
                    at.append(i)
                elif g:
                    out[i] = _within(g, rings, low, high)
            except (ValueError, KeyError, TypeError, IndexError):
                continue
        if points:
            p = np.array([x if len(x) == 2 else [np.inf, np.inf] for x in points], float)
            near = ((p >= low) & (p <= high)).all(axis=1)
            found = np.zeros(len(p), bool)
            found[near] = locate(p[near], rings) > 0 if near.any() else False
            out[at] = found
        return pd.Series(out)

    return within(geometry.cast("string"))
