"""Spatial predicates on hand-made cases, centroid, reprojection."""

import math


from wattlane.functions.geometry import centroid, lonlat_to_tm
from wattlane.operators.spatial import join_within


def _sq(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


def test_within_cases(spark):
    polys = spark.createDataFrame([
        ("U", [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (25.0, 10.0), (25.0, 4.0), (15.0, 4.0), (15.0, 10.0),
               (0.0, 10.0)], []),
        ("H", _sq(40, 0, 80, 10), [_sq(50, 3, 70, 7)]),
        ("O", _sq(70, 0, 100, 10), []),
    ], "postalcode string, exterior array<struct<x:double,y:double>>, "
       "holes array<array<struct<x:double,y:double>>>")
    b = spark.createDataFrame([
        ("inside", _sq(1, 1, 3, 3)),
        ("straddle", _sq(38, 1, 42, 3)),          # crosses U|H border
        ("notch", _sq(16, 5, 24, 8)),             # in U's bounding box, outside U
        ("spans_notch", _sq(10, 6, 30, 8)),       # vertices inside U, edges cross the notch
        ("in_hole", _sq(55, 4, 60, 6)),
        ("around_hole", _sq(45, 1, 75, 9)),       # contains H's hole -> not within H
        ("touch", _sq(0, 0, 2, 2)),               # shares U's corner: within
        ("overlap", _sq(72, 1, 78, 3)),           # in H and in O
    ], "cadastralref string, geometry array<struct<x:double,y:double>>")
    want = {"inside": {"U"}, "straddle": {None}, "notch": {None}, "spans_notch": {None},
                   "in_hole": {None}, "around_hole": {None}, "touch": {"U"}, "overlap": {"H", "O"}}
    for limit in (1 << 20, 0):                    # edges packed per cell, and by polygon id
        got = {}
        for r in join_within(b, polys, cell=7.0, broadcast_bytes=limit).collect():
            got.setdefault(r.cadastralref, set()).add(r.postalcode)
        assert got == want


def test_centroid_with_hole(spark):
    df = spark.createDataFrame([(_sq(0, 0, 10, 10), [_sq(0, 0, 5, 5)])],
                               "e array<struct<x:double,y:double>>, h array<array<struct<x:double,y:double>>>")
    c = df.select(centroid("e", "h").alias("c")).first().c
    # area 75; centroid = (100*(5,5) - 25*(2.5,2.5)) / 75
    assert math.isclose(c.x, (500 - 62.5) / 75) and math.isclose(c.y, (500 - 62.5) / 75)


def test_reprojection_known_points(spark):
    pts = spark.createDataFrame([(3.0, 0.0), (3.0, 45.0), (2.0, 41.0), (4.0, 41.0)], "lon double, lat double")
    r = pts.select(lonlat_to_tm("lon", "lat", digits=None).alias("p")).collect()
    assert abs(r[0].p.x - 500000.0) < 1e-6 and abs(r[0].p.y) < 1e-6
    # meridian arc to 45 degrees on GRS80 is 4984944.378 m; UTM scale 0.9996
    assert abs(r[1].p.y - 0.9996 * 4984944.378) < 0.01
    assert abs((r[2].p.x - 500000.0) + (r[3].p.x - 500000.0)) < 1e-6      # symmetric about lon0
    assert abs(r[2].p.y - r[3].p.y) < 1e-6


def test_polygon_from_wkt(spark):
    from wattlane.functions.geometry import polygon_from_wkt
    df = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 2))",),
                                ("polygon((1 1,2 1,2 2,1 1))",)], "w string")
    r = df.select(polygon_from_wkt("w").alias("p")).collect()
    assert [(v.x, v.y) for v in r[0].p.exterior] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert len(r[0].p.holes) == 1 and (r[0].p.holes[0][1].x, r[0].p.holes[0][1].y) == (4, 2)
    assert len(r[1].p.exterior) == 4 and r[1].p.holes == []


def test_polygons_reprojected_before_join(spark):
    from wattlane.operators.spatial import to_cadaster_crs
    # a lon/lat square around Lleida and a 20 m building near its centre, given in UTM 31N
    polys = spark.createDataFrame(
        [("25001", [(0.55, 41.58), (0.70, 41.58), (0.70, 41.66), (0.55, 41.66)], [])],
        "postalcode string, exterior array<struct<x:double,y:double>>, "
        "holes array<array<struct<x:double,y:double>>>")
    utm = to_cadaster_crs(polys, 4326)
    centre = spark.createDataFrame([(0.62, 41.62)], "lon double, lat double").select(
        lonlat_to_tm("lon", "lat").alias("p")).first().p
    b = spark.createDataFrame([("b1", _sq(centre.x - 10, centre.y - 10, centre.x + 10, centre.y + 10))],
                              "cadastralref string, geometry array<struct<x:double,y:double>>")
    got = join_within(b, utm, cell=1000.0).collect()
    assert [(r.cadastralref, r.postalcode) for r in got] == [("b1", "25001")]
    assert 290000 < centre.x < 310000 and 4600000 < centre.y < 4620000   # Lleida in UTM 31N


def test_whole_building_counts(spark):
    """Every patch must lie within; a hole of the polygon may lie in the building's courtyard."""
    ring = "array<struct<x:double,y:double>>"
    polys = spark.createDataFrame([("H", _sq(0, 0, 100, 100), [_sq(45, 45, 55, 55)])],
                                  f"postalcode string, exterior {ring}, holes array<{ring}>")
    b = spark.createDataFrame([
        ("both_in", [(_sq(1, 1, 5, 5), []), (_sq(80, 80, 90, 90), [])]),
        ("one_out", [(_sq(1, 1, 5, 5), []), (_sq(95, 95, 105, 99), [])]),
        ("court", [(_sq(30, 30, 70, 70), [_sq(40, 40, 60, 60)])]),
        ("small_court", [(_sq(30, 30, 70, 70), [_sq(48, 48, 52, 52)])]),
        ("no_court", [(_sq(30, 30, 70, 70), [])]),
    ], f"id string, parts array<struct<exterior:{ring},holes:array<{ring}>>>")
    for limit in (1 << 20, 0):
        got = {r.id: r.postalcode for r in join_within(b, polys, cell=50.0, parts="parts", broadcast_bytes=limit).collect()}
        assert got == {"both_in": "H", "one_out": None, "court": "H", "small_court": None, "no_court": None}


def _covered_inputs(spark):
    """A polygon with a hole, one a thousand times smaller in area inside it, a triangle, one without extent; boxes all over."""
    import random
    rng = random.Random(3)
    ring = "array<struct<x:double,y:double>>"
    polys = spark.createDataFrame([
        ("big", _sq(0, 0, 3200, 3200), [_sq(1000, 1000, 1100, 1200)]), ("small", _sq(500, 500, 600, 600), []),
        ("triangle", [(-700.0, -300.0), (900.0, 100.0), (200.0, 2500.0)], []), ("point", _sq(5, 5, 5, 5), []), ("none", None, None),
    ], f"postalcode string, exterior {ring}, holes array<{ring}>")
    boxes = []
    for i in range(400):
        x, y, w = rng.uniform(-800, 3300), rng.uniform(-400, 3300), rng.choice([2.0, 30.0, 300.0])
        if i % 4 == 0:
            x, y = rng.uniform(480, 610), rng.uniform(480, 610)
        if i % 10 == 0:                                  # on cell borders, touching the large square's side
            x, y = 0.0, float(64 * (i // 10))
        boxes.append((i, _sq(x, y, x + w, y + w)))
    b = spark.createDataFrame([*boxes, (400, None), (401, [])], f"id int, geometry {ring}")
    return b, polys


def test_cells_of_any_size_give_the_same_rows(spark):
    from pyspark.sql import functions as F

    from wattlane.functions.geometry import within
    b, polys = _covered_inputs(spark)
    pairs = b.where("size(geometry) > 0").crossJoin(polys.where("exterior is not null")).where(within("geometry", "exterior", "holes"))
    inside = pairs.select("id", "postalcode").collect()
    want = sorted([(r.id, r.postalcode) for r in inside] + [(i, "") for i in range(402) if i not in {r.id for r in inside}])
    assert len({r.postalcode for r in inside}) == 3 and len(inside) > 150
    for cell, levels, limit in ((None, 4, 1 << 26), (None, 0, 1 << 26), (None, 6, 0), (500.0, 4, 1 << 26), (0.3, 4, 0), (1e6, 4, 1 << 26)):
        got = join_within(b, polys, cell=cell, levels=levels, broadcast_bytes=limit)
        assert got.columns == ["id", "geometry", "postalcode"]
        assert sorted((r.id, r.postalcode or "") for r in got.collect()) == want, (cell, levels, limit)
    assert join_within(b, polys.limit(0)).where(F.col("postalcode").isNull()).count() == 402
    assert join_within(b.limit(0), polys).count() == 0


def test_covering_follows_the_polygon(spark):
    """Cells do not overlap, hold the polygon, are as many for polygons of any area, and spare most exact tests."""
    from wattlane.operators.spatial import covering, polygon_edges
    _, polys = _covered_inputs(spark)
    for levels in (0, 2, 4):
        cells = covering(polygon_edges(polys), levels).collect()
        area = {}
        for c in cells:
            area.setdefault(c._key, [0.0, 0.0, 0])
            area[c._key][0] += c._size ** 2
            area[c._key][1] += c._size ** 2 * c._inside
            area[c._key][2] += 1
        for k, a in (("big", 3200 ** 2 - 100 * 200), ("small", 100 ** 2)):
            assert area[k][1] <= a <= area[k][0]
        assert len({(c._key, c._size, c._cx, c._cy) for c in cells}) == len(cells)
    assert area["big"][1] > 0.7 * 3200 ** 2 and area["small"][1] > 0.5 * 100 ** 2
    assert max(area[k][2] for k in ("big", "small")) < 3 * min(area[k][2] for k in ("big", "small"))
    assert "none" not in area and area["point"][2] >= 1
