import json

import numpy as np
import pytest

from jsonweave.functions import geo
from jsonweave.functions.geo import locate, parse_polygon
from jsonweave.plans.lattice import merge, to_spark, type_of


def _within(geometry, rings):
    box = np.vstack(rings)
    return geo._within(geometry, rings, box.min(axis=0), box.max(axis=0))


BOX = parse_polygon("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")


def test_merge_is_a_lattice():
    values = [None, "", 1, -1, 2.5, True, "x", [], [1], [None], ["a"], {"a": 1}, {"a": "x", "b": []}, [{"a": 1}, 3], [[1], 2]]
    types = [type_of(v) for v in values]
    for a in types:
        for b in types:
            assert merge(a, b) == merge(b, a)
            for c in types:
                assert merge(merge(a, b), c) == merge(a, merge(b, c))


def test_precedence():
    assert merge(type_of(1), type_of(1.5)) == "double" and merge("long", "bool") == "str"
    assert merge(type_of({"a": 1}), type_of("x")) == type_of({"a": 1}) == merge(type_of([1]), type_of({"a": 1}))
    assert merge(type_of([1]), type_of("x")) == {"arr": "long"}
    assert type_of({"geometry": {"type": "Point", "coordinates": [1, 2]}}) == {"obj": {"geometry": "geo"}}
    assert to_spark(type_of({"z": None, "e": [], "a": -1})).simpleString() == "struct<a:bigint,z:string>"


def test_points():
    p = np.array([[3, 3], [0, 2], [1.5, 1.5], [5, 5], [4, 4], [1, 1.5]])
    assert locate(p, BOX).tolist() == [1, 0, -1, -1, 0, 0]


def test_lines_and_polygons():
    line = lambda *p: {"type": "LineString", "coordinates": p}
    assert _within(line([3, 3], [3, 1]), BOX) and _within(line([0, 0], [0.5, 3]), BOX)
    assert not _within(line([0, 0], [4, 0]), BOX)  # only on the boundary
    assert not _within(line([0.5, 1.5], [3, 1.5]), BOX)  # through the hole
    assert not _within(line([3, 3], [5, 3]), BOX)
    assert _within({"type": "Polygon", "coordinates": [[[2.5, 2.5], [3, 2.5], [3, 3], [2.5, 2.5]]]}, BOX)


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [[*map(list, r), list(r[0])] for r in rings]}


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_areas():
    hole = square(1, 1, 1)
    outer = square(0, 0, 4)
    assert _within(polygon(outer, hole), BOX)  # equal
    assert _within(polygon(outer[2:] + outer[:2], hole[::-1]), BOX)  # equal, drawn otherwise
    assert not _within(polygon(outer), BOX)  # equal but for the hole
    assert not _within(polygon(square(0.5, 0.5, 2.5)), BOX)  # drawn around the hole
    assert _within(polygon(square(0.5, 0.5, 2.5), square(0.75, 0.75, 1.5)), BOX)  # so is its own hole
    assert not _within(polygon(hole), BOX)  # fills the hole
    assert not _within(polygon(square(3, 3, 2)), BOX) and not _within(polygon(square(1.2, 1.2, 0.5)), BOX)
    assert _within(polygon(square(2, 2, 2)), BOX)  # touches the hole at a corner
    assert not _within({"type": "MultiPolygon", "coordinates": [polygon(square(3, 3, 1))["coordinates"], polygon(square(1, 1, 1))["coordinates"]]}, BOX)


def test_multipolygons():
    four = "MULTIPOLYGON (((0 0, 3 0, 3 1, 0 1, 0 0)), ((0 2, 3 2, 3 3, 0 3, 0 2)), ((5 5, 6 5, 6 6, 5 6, 5 5), (5.2 5.2, 5.4 5.2, 5.4 5.4, 5.2 5.2)))"
    rings = parse_polygon(four)
    assert _within(polygon(square(0, 0, 1)), rings) and _within(polygon(square(1, 2, 1)), rings)
    assert not _within(polygon(square(0, 0, 3)), rings)  # over the gap
    assert not _within(polygon(square(5, 5, 1)), rings)
    assert _within({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0.5, 0.5]}, {"type": "LineString", "coordinates": [[1, 2.5], [2, 2.5]]}]}, rings)
    assert not _within({"type": "MultiPoint", "coordinates": [[0.5, 0.5], [0.5, 1.5]]}, rings)


def test_polygons_against_random_places():
    """A star is within another exactly if no place of it is outside (all drawn about one centre)."""
    r, seen = np.random.default_rng(2), set()
    angle = np.sort(r.random(9)) * 2 * np.pi
    way = np.stack([np.cos(angle), np.sin(angle)], 1)
    for _ in range(60):
        a, b = (way * r.uniform(0.5, 2, (9, 1)) for _ in range(2))
        if r.random() < 0.4:
            a = b * r.choice([0.3, 0.999, 1.0, 1.001])
        ours = _within(polygon(a.tolist()), parse_polygon("POLYGON ((" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in [*b, b[0]]) + "))"))
        p = r.uniform(-2, 2, (4000, 2))
        ring = lambda c: [np.vstack([c, c[:1]])]
        out = ((locate(p, ring(a)) > 0) & (locate(p, ring(b)) < 0)).any()
        grown = bool((np.linalg.norm(a, axis=1) > np.linalg.norm(b, axis=1) * (1 + 1e-9)).any())
        assert ours == (not grown) and not (ours and out)
        seen.add(ours)
    assert seen == {True, False}


@pytest.mark.parametrize("wkt", ["POINT (1 2.5)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT EMPTY"])
def test_wkt_both_ways(spark, wkt):
    g = geo.parse_wkt(wkt)
    assert geo.write_wkt(g) == wkt and geo.parse_wkt(wkt.lower().replace(", ", ",")) == g
    df = spark.createDataFrame([(json.dumps(g), wkt), ("{", "POINT ("), (None, None)], "g string, w string")
    got = df.select(geo.geojson_to_wkt(df.g).alias("w"), geo.wkt_to_geojson(df.w).alias("g")).collect()
    assert got[0]["w"] == wkt and json.loads(got[0]["g"]) == g and [tuple(x) for x in got[1:]] == [(None, None)] * 2


def test_wkt_errors_and_digits():
    for bad in ("CIRCLE (1 2)", "POINT (1)", "POINT (1 2", "POINT (1 2) x", "POLYGON ((0 0, a b))"):
        with pytest.raises(geo.WktError):
            geo.parse_wkt(bad)
    assert geo.write_geojson({"type": "Point", "coordinates": [1 / 3, 2.0]}) == '{"type": "Point", "coordinates": [0.3333333, 2]}'
    with pytest.raises(geo.WktError):
        parse_polygon("POINT (1 2)")
