"""Spatial left join: buildings within postal-code polygons.

Every polygon is covered by the cells of a quadtree: squares of 2^k sides,
starting at the polygon's own extent and halved ``levels`` times where an edge
of the polygon touches them.  So a small polygon gets small cells and a large one large
cells, about equally many, and no cell size has to be guessed.  A cell that no edge touches
is wholly inside the polygon, or it is left out.

A building is looked up under the cells of its first vertex, one per cell size
in use - a building within a polygon has every vertex inside it, so that vertex
is enough.  A building whose box lies in an inside cell is within the polygon
without any further test; the others pass a bounding-box test and the exact
``within`` test.  A building without a match keeps one row with a NULL postal
code, a building inside two overlapping polygons gets two rows -
``sjoin(how='left', predicate='within')``.

Edges stay one row per polygon and meet undecided buildings only.  Two plans, chosen
by measured bytes, with the same result:

* the cells (ids and boxes, no edges) are broadcast, one table per cell size, if
  they are within ``broadcast_bytes``: decided buildings are not shuffled, the
  others are joined with the edges by polygon id;
* otherwise buildings and cells meet in an equi-join on (size, cell), which
  adaptive execution splits where a cell is dense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.functions import geometry as G
from wattlane.session import cut_lineage

#: Bytes of an edge, and of a row's other values, as estimated for a broadcast.
EDGE_BYTES, ROW_BYTES = 32, 100
BROADCAST_BYTES = 64 << 20
LEVELS = 4


def polygon_edges(polygons: DataFrame, key: str = "postalcode", exterior: str = "exterior", holes: str = "holes") -> DataFrame:
    """One row per polygon: id, key, edges of the exterior and of every hole, box and bytes."""
    p = polygons.select(F.monotonically_increasing_id().alias("_pid"), F.col(key).alias("_key"),
                        G.edges(exterior).alias("_ee"), G.hole_edge_arrays(holes).alias("_he"), G.bbox(exterior).alias("_bb"))
    n = F.size("_ee") + F.coalesce(F.aggregate("_he", F.lit(0), lambda acc, h: acc + F.size(h)), F.lit(0))
    return p.withColumn("_bytes", F.lit(ROW_BYTES) + F.lit(EDGE_BYTES) * n)


def _touches(e: Column, x: Column, y: Column, size: Column) -> Column:
    """Edge ``e`` meets the closed square at (x, y): boxes overlap and the corners are not all beyond one side of the
    edge's line.  A margin far above rounding makes it err towards touching."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    sides = [dx * (y + j * size - e["ay"]) - dy * (x + i * size - e["ax"]) for i in (0, 1) for j in (0, 1)]
    margin = (F.abs(dx) + F.abs(dy)) * (size + F.abs(x - e["ax"]) + F.abs(y - e["ay"])) * F.lit(1e-12)
    return ((F.least(e["ax"], e["bx"]) <= x + size) & (F.greatest(e["ax"], e["bx"]) >= x)
            & (F.least(e["ay"], e["by"]) <= y + size) & (F.greatest(e["ay"], e["by"]) >= y)
            & (F.least(*sides) <= margin) & (F.greatest(*sides) >= -margin))


def covering(polys: DataFrame, levels: int = LEVELS, cell: float | None = None) -> DataFrame:
    """(_pid, _key, _bb, _size, _cx, _cy, _inside): quadtree cells over every polygon of :func:`polygon_edges`.

    Cells of a polygon do not overlap and hold all of it, boundary included.  ``cell``: no cell is halved to less than it.
    """
    box = F.col("_bb")
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    span = lambda a: F.explode(F.sequence(F.floor(box[f"{a}min"] / F.col("_size")).cast("long"),      # noqa: E731
                                          F.floor(box[f"{a}max"] / F.col("_size")).cast("long")))
    c = (polys.where(extent.isNotNull()).select(
            "_pid", "_bb", F.concat("_ee", F.coalesce(F.flatten("_he"), F.array().cast(polys.schema["_ee"].dataType))).alias("_edges"),
            F.when(extent > 0, F.pow(F.lit(2.0), F.ceil(F.log2(extent)))).otherwise(F.lit(1.0)).alias("_size"))
         .withColumn("_cx", span("x")).withColumn("_cy", span("y")).drop("_bb"))
    size, cx, cy = F.col("_size"), F.col("_cx"), F.col("_cy")
    for level in range(levels + 1):
        c = c.withColumn("_edges", F.filter("_edges", lambda e: _touches(e, cx * size, cy * size, size)))
        if level == levels:
            break
        half = size / 2
        stop = (F.size("_edges") == 0) | (half < F.lit(cell) if cell else F.lit(False))
        part = lambda s, x, y: F.struct(s.alias("s"), x.alias("x"), y.alias("y"))                      # noqa: E731
        parts = F.when(stop, F.array(part(size, cx, cy))).otherwise(
            F.array(*[part(half, cx * 2 + i, cy * 2 + j) for i in (0, 1) for j in (0, 1)]))
        c = c.select("_pid", "_edges", F.explode(parts).alias("_c")).select(
            "_pid", "_edges", F.col("_c.s").alias("_size"), F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy"))
    c = c.select("_pid", "_size", "_cx", "_cy", (F.size("_edges") == 0).alias("_free"))
    mx, my = (cx + 0.5) * size, (cy + 0.5) * size
    middle_in = G.inside_or_on(mx, my, F.col("_ee")) & ~F.exists(
        F.coalesce(F.col("_he"), F.array().cast(polys.schema["_he"].dataType)), lambda h: G.inside_or_on(mx, my, h))
    return (c.join(polys.select("_pid", "_key", "_bb", "_ee", "_he"), "_pid").where(~F.col("_free") | middle_in)
            .select("_pid", "_key", "_bb", "_size", "_cx", "_cy", F.col("_free").alias("_inside")))


def _hit(box: Column, poly: Column, parts: Column) -> Column:
    """The building (box, parts with prepared edges) lies within the polygon (struct of bb, ee, he)."""
    return G.bbox_contains(poly["bb"], box) & F.forall(
        parts, lambda p: G.within_prepared(p["ee"], poly["ee"], poly["he"], p["ce"]))


def _in_cell(box: Column, size: Column, cx: Column, cy: Column) -> Column:
    return ((box["xmin"] >= cx * size) & (box["xmax"] <= (cx + 1) * size)
            & (box["ymin"] >= cy * size) & (box["ymax"] <= (cy + 1) * size))


def join_within(buildings: DataFrame, polygons: DataFrame, cell: float | None = None,
                ring: str = "geometry", key: str = "postalcode", exterior: str = "exterior",
                holes: str = "holes", parts: str | None = None, broadcast_bytes: int = BROADCAST_BYTES,
                levels: int = LEVELS) -> DataFrame:
    """``buildings`` + ``key`` of every polygon the building lies within (left join).

    ``parts``: column with all patches of a building (exterior and holes each),
    which must all lie within; without it the one ring ``ring`` counts.
    ``levels`` and ``cell`` (see :func:`covering`) change work only, not rows.
    """
    polys = cut_lineage(polygon_edges(polygons, key, exterior, holes))
    cells = cut_lineage(covering(polys, levels, cell))
    row = F.lit(ROW_BYTES) + F.coalesce(F.octet_length(F.col("_key").cast("string")), F.lit(0))
    sizes = cells.groupBy("_size").agg(F.sum(row).alias("bytes")).collect()      # at most one row per power of two
    cell_bytes = sum(r.bytes for r in sizes)
    edge_bytes = polys.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    small = lambda df, bytes_: F.broadcast(df) if bytes_ <= broadcast_bytes else df

    whole = F.struct(F.col(ring).alias("exterior"), F.array().cast(f"array<{G.RING_TYPE}>").alias("holes"))
    listed_parts = F.col(parts) if parts else F.array(whole)
    first = F.get(F.get(listed_parts, F.lit(0))["exterior"], F.lit(0))
    box = G.bbox(F.flatten(F.transform(listed_parts, lambda p: p["exterior"])))
    b = cut_lineage(buildings.withColumn("_rid", F.monotonically_increasing_id()))
    at = lambda v, s: F.floor(first[v] / s).cast("long")                             # noqa: E731
    sure = _in_cell(F.col("_ib"), F.col("_size"), F.col("_cx"), F.col("_cy"))

    def exact(undecided: DataFrame) -> DataFrame:
        """(_rid, key) of (_rid, _ib, geometry, _pid) rows that pass the exact test."""
        prepared = undecided.withColumn("_parts", F.transform(listed_parts, lambda p: F.struct(
            G.edges(p["exterior"]).alias("ee"), G.hole_edge_arrays(p["holes"]).alias("ce"))))
        poly = F.struct(F.col("_bb").alias("bb"), F.col("_ee").alias("ee"), F.col("_he").alias("he"))
        return (prepared.join(small(polys.select("_pid", "_key", "_bb", "_ee", "_he"), edge_bytes), "_pid")
                .where(_hit(F.col("_ib"), poly, F.col("_parts"))).select("_rid", F.col("_key").alias(key)))

    geometry = parts or ring
    if cell_bytes > broadcast_bytes:
        spots = F.explode(F.array(*[F.struct(F.lit(r._size).alias("_size"), at("x", F.lit(r._size)).alias("_cx"),
                                             at("y", F.lit(r._size)).alias("_cy")) for r in sizes])).alias("_spot")
        met = (b.select("_rid", geometry, box.alias("_ib"), spots).select("_rid", geometry, "_ib", "_spot.*")
               .join(cells, ["_size", "_cx", "_cy"]).where(G.bbox_contains(F.col("_bb"), F.col("_ib"))))
        met = cut_lineage(met.select("_rid", geometry, "_ib", "_pid", "_key", (F.col("_inside") & sure).alias("_sure")))
        found = met.where("_sure").select("_rid", F.col("_key").alias(key)).unionByName(exact(met.where("not _sure").drop("_sure", "_key")))
        return b.join(found, "_rid", "left").drop("_rid")

    near = b.withColumn("_ib", box)
    for i, r in enumerate(sizes):
        of_size = cells.where(F.col("_size") == F.lit(r._size)).groupBy("_cx", "_cy").agg(F.collect_list(F.struct(
            F.col("_pid").alias("pid"), F.col("_key").alias("key"), F.col("_bb").alias("bb"), F.col("_inside").alias("inside"))).alias(f"_c{i}"))
        spotted = near.withColumns({"_cx": at("x", F.lit(r._size)), "_cy": at("y", F.lit(r._size)), "_size": F.lit(r._size)})
        met = spotted.join(F.broadcast(of_size), ["_cx", "_cy"], "left")
        kept = F.filter(f"_c{i}", lambda c: G.bbox_contains(c["bb"], F.col("_ib")))
        near = met.withColumn(f"_c{i}", F.transform(kept, lambda c: F.struct(
            c["pid"].alias("pid"), c["key"].alias("key"), (c["inside"] & sure).alias("sure")))).drop("_cx", "_cy", "_size")
    arrays = [f"_c{i}" for i in range(len(sizes))]
    nothing = F.array().cast(f"array<struct<pid:bigint,key:{polys.schema['_key'].dataType.simpleString()},sure:boolean>>")
    near = near.withColumn("_cands", reduce(F.concat, [F.coalesce(F.col(a), nothing) for a in arrays], nothing)).drop(*arrays)
    decided = F.forall("_cands", lambda c: c["sure"])
    done = near.where(decided).withColumn(key, F.explode_outer(F.transform("_cands", lambda c: c["key"])))
    rest = cut_lineage(near.where(~decided))
    each = rest.select("_rid", geometry, "_ib", F.explode("_cands").alias("_c"))
    found = each.where("_c.sure").select("_rid", F.col("_c.key").alias(key)).unionByName(
        exact(each.where("not _c.sure").select("_rid", geometry, "_ib", F.col("_c.pid").alias("_pid"))))
    internal = ["_rid", "_ib", "_cands"]
    return done.drop(*internal).unionByName(rest.join(found, "_rid", "left").drop(*internal))


def to_cadaster_crs(polygons: DataFrame, source_srid: int, exterior: str = "exterior",
                    holes: str = "holes") -> DataFrame:
    """F12 before J1: postal polygons into the buildings' CRS (ETRS89 / UTM 31N).

    ``source_srid`` is 4326 (lon/lat degrees) or 25831 (already projected, no-op).
    """
    if source_srid == 25831:
        return polygons
    return polygons.withColumns({
        exterior: G.reproject_ring(exterior, source_srid),
        holes: F.transform(F.col(holes), lambda h: G.reproject_ring(h, source_srid)),
    })
