"""Planar geometry as column expressions over rings (F11, F12, J1 predicates).

A ring is ``array<struct<x: double, y: double>>``; the closing vertex may be
repeated or not.  A polygon is an exterior ring plus an array of hole rings.
Everything here is a Catalyst expression (higher-order functions), so it runs
in the JVM next to the join that feeds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def open_ring(ring: str | Column) -> Column:
    """Drop the closing vertex when it repeats the first one."""
    r = _c(ring)
    closed = (F.size(r) > 1) & (r[0]["x"] == F.element_at(r, -1)["x"]) & (r[0]["y"] == F.element_at(r, -1)["y"])
    return F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)


def edges(ring: str | Column) -> Column:
    """``array<struct<ax, ay, bx, by>>``: the ring's edges, closing edge included."""
    r = open_ring(ring)
    nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.zip_with(r, nxt, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                                                    b["x"].alias("bx"), b["y"].alias("by")))


def _on_edge(px: Column, py: Column, e: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
    return ((cross == 0)
            & (px >= F.least(e["ax"], e["bx"])) & (px <= F.greatest(e["ax"], e["bx"]))
            & (py >= F.least(e["ay"], e["by"])) & (py <= F.greatest(e["ay"], e["by"])))


def _ray_hit(px: Column, py: Column, e: Column) -> Column:
    straddles = (e["ay"] > py) != (e["by"] > py)
    x_at = F.try_divide((e["bx"] - e["ax"]) * (py - e["ay"]), e["by"] - e["ay"]) + e["ax"]
    return straddles & (px < x_at)


def on_boundary(px: Column, py: Column, ring_edges: Column) -> Column:
    return F.exists(ring_edges, lambda e: _on_edge(px, py, e))


def strictly_inside(px: Column, py: Column, ring_edges: Column) -> Column:
    hits = F.size(F.filter(ring_edges, lambda e: _ray_hit(px, py, e)))
    return ~on_boundary(px, py, ring_edges) & (F.pmod(hits, F.lit(2)) == 1)


def inside_or_on(px: Column, py: Column, ring_edges: Column) -> Column:
    hits = F.size(F.filter(ring_edges, lambda e: _ray_hit(px, py, e)))
    return on_boundary(px, py, ring_edges) | (F.pmod(hits, F.lit(2)) == 1)


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _proper_cross(e: Column, f: Column) -> Column:
    d1 = _orient(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d2 = _orient(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    d3 = _orient(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d4 = _orient(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def any_proper_crossing(edges_a: Column, edges_b: Column) -> Column:
    return F.exists(edges_a, lambda e: F.exists(edges_b, lambda f: _proper_cross(e, f)))


def _probe_points(ring_edges: Column) -> Column:
    """Vertices and edge midpoints of a ring (``array<struct<x, y>>``)."""
    verts = F.transform(ring_edges, lambda e: F.struct(e["ax"].alias("x"), e["ay"].alias("y")))
    mids = F.transform(ring_edges, lambda e: F.struct(((e["ax"] + e["bx"]) / 2).alias("x"),
                                                       ((e["ay"] + e["by"]) / 2).alias("y")))
    return F.concat(verts, mids)


def within_prepared(inner_edges: Column, ext_edges: Column, hole_edges: Column | None = None,
                    court_edges: Column | None = None) -> Column:
    """:func:`within` on precomputed edge arrays (``hole_edges``: one edge array per hole).

    Probe points (vertices and edge midpoints) make collinear contacts safe: a
    building filling a notch of a concave polygon has an edge midpoint outside
    it, and a hole sharing an edge with a building has a vertex or midpoint
    strictly inside the building.  ``court_edges`` are the interior rings of the
    building itself: a hole may lie in such a courtyard.  Conditions are ordered
    cheapest first; ``AND`` stops at the first false.
    """
    courts = F.array().cast("array<array<struct<ax:double,ay:double,bx:double,by:double>>>") if court_edges is None else court_edges

    def in_building(v: Column) -> Column:
        return strictly_inside(v["x"], v["y"], inner_edges) & ~F.exists(
            courts, lambda c: inside_or_on(v["x"], v["y"], c))
    probes = _probe_points(inner_edges)
    cond = (F.forall(probes, lambda v: inside_or_on(v["x"], v["y"], ext_edges))
            & ~any_proper_crossing(inner_edges, ext_edges))
    if hole_edges is not None:
        hole_ok = F.forall(hole_edges, lambda he: (
            ~F.exists(probes, lambda v: strictly_inside(v["x"], v["y"], he))
            & ~any_proper_crossing(inner_edges, he)
            & ~F.exists(courts, lambda c: any_proper_crossing(c, he))
            & ~F.exists(_probe_points(he), in_building)))
        cond = cond & F.coalesce(hole_ok, F.lit(True))
    return cond


def hole_edge_arrays(holes: str | Column) -> Column:
    return F.transform(_c(holes), lambda hr: edges(hr))


def within(inner: str | Column, exterior: str | Column, holes: str | Column | None = None) -> Column:
    """True when polygon ``inner`` lies within (exterior minus holes); touching the boundary counts as within.

    Every vertex of ``inner`` is inside or on the exterior and not strictly
    inside a hole, no edge of ``inner`` properly crosses an edge of the
    exterior or of a hole, and no hole lies inside ``inner``.
    """
    return within_prepared(edges(inner), edges(exterior),
                           hole_edge_arrays(holes) if holes is not None else None)


def bbox_contains(outer: Column, inner: Column) -> Column:
    """Bounding box ``outer`` contains bounding box ``inner`` (both from :func:`bbox`)."""
    return ((outer["xmin"] <= inner["xmin"]) & (outer["ymin"] <= inner["ymin"])
            & (outer["xmax"] >= inner["xmax"]) & (outer["ymax"] >= inner["ymax"]))


def signed_area(ring: str | Column) -> Column:
    """Shoelace area (positive for counter-clockwise rings)."""
    cross = F.aggregate(edges(ring), F.lit(0.0),
                        lambda acc, e: acc + (e["ax"] * e["by"] - e["bx"] * e["ay"]))
    return cross / F.lit(2.0)


def _moment(ring: Column, axis: str) -> Column:
    a, b = ("ax", "bx") if axis == "x" else ("ay", "by")
    return F.aggregate(edges(ring), F.lit(0.0),
                       lambda acc, e: acc + (e[a] + e[b]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))


def centroid(exterior: str | Column, holes: str | Column | None = None) -> Column:
    """area centroid ``struct<x, y>`` of a polygon, holes subtracted."""
    ext = _c(exterior)
    sign = F.signum(signed_area(ext))
    area = F.abs(signed_area(ext))
    mx = _moment(ext, "x") * sign
    my = _moment(ext, "y") * sign
    if holes is not None:
        h = _c(holes)
        h_area = F.aggregate(h, F.lit(0.0), lambda acc, r: acc + F.abs(signed_area(r)))
        h_mx = F.aggregate(h, F.lit(0.0), lambda acc, r: acc + _moment(r, "x") * F.signum(signed_area(r)))
        h_my = F.aggregate(h, F.lit(0.0), lambda acc, r: acc + _moment(r, "y") * F.signum(signed_area(r)))
        area = area - F.coalesce(h_area, F.lit(0.0))
        mx = mx - F.coalesce(h_mx, F.lit(0.0))
        my = my - F.coalesce(h_my, F.lit(0.0))
    return F.struct((mx / (F.lit(6.0) * area)).alias("x"), (my / (F.lit(6.0) * area)).alias("y"))


def bbox(ring: str | Column) -> Column:
    r = _c(ring)
    xs = F.transform(r, lambda v: v["x"])
    ys = F.transform(r, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


# ---------------------------------------------------------------- F12 reprojection

# GRS80 ellipsoid and UTM zone 31 North (ETRS89 / EPSG:25831).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM_K0 = 0.9996
UTM31_LON0 = 3.0
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 0.0


def _kruger_coefficients(f: float):
    n = f / (2 - f)
    big_a = 1 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140,
             49561 * n ** 4 / 161280)
    return n, big_a, alpha


def lonlat_to_tm(lon: str | Column, lat: str | Column, lon0: float = UTM31_LON0, k0: float = UTM_K0,
                 a: float = GRS80_A, f: float = GRS80_F, false_e: float = UTM_FALSE_EASTING,
                 false_n: float = UTM_FALSE_NORTHING, digits: int | None = 3) -> Column:
    """geographic degrees -> transverse Mercator metres (Krueger series, 4th order).

    Defaults give ETRS89 / UTM 31N, the CRS of the cadaster files.  The series
    is accurate to well under a millimetre inside a zone, so results are
    rounded to ``digits`` decimals (mm); finer digits only carry the
    platform's trigonometry noise.
    """
    n, big_a, alpha = _kruger_coefficients(f)
    lam = F.radians(_c(lon) - F.lit(lon0))
    phi = F.radians(_c(lat))
    k = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(k) * F.atanh(F.lit(k) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east = eta
    north = xi
    for j, aj in enumerate(alpha, start=1):
        east = east + F.lit(aj) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(aj) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = k0 * a * big_a
    x = F.lit(false_e) + F.lit(scale) * east
    y = F.lit(false_n) + F.lit(scale) * north
    if digits is not None:
        from wattlane.functions.numeric import round_half_even
        x, y = round_half_even(x, digits), round_half_even(y, digits)
    return F.struct(x.alias("x"), y.alias("y"))


def reproject_ring(ring: str | Column, source_srid: int, **kw) -> Column:
    """Ring in ``source_srid`` (4326 lon/lat or 25831 already projected) to EPSG:25831."""
    if source_srid == 25831:
        return _c(ring)
    if source_srid != 4326:
        raise ValueError(f"unsupported source SRID {source_srid}")
    return F.transform(_c(ring), lambda v: lonlat_to_tm(v["x"], v["y"], **kw))


# ---------------------------------------------------------------- S5 polygon text

def polygon_from_wkt(wkt: str | Column) -> Column:
    """``POLYGON ((x y, ...), (x y, ...))`` -> ``struct<exterior, holes>`` (first ring exterior).

    Postal polygons arriving as WKT text (e.g. exported from a GeoPackage)
    become rings with column functions only.
    """
    body = F.regexp_replace(F.trim(_c(wkt)), r"^(?i)POLYGON\s*\(\s*\(|\)\s*\)\s*$", "")
    rings = F.split(body, r"\)\s*,\s*\(")

    def ring(txt):
        pts = F.split(F.trim(txt), r"\s*,\s*")
        return F.transform(pts, lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"),
            F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
    return F.struct(ring(rings[0]).alias("exterior"),
                    F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring).alias("holes"))
