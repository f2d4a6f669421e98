"""Building features from GML (cadastral INSPIRE layout) with Spark's XML source.

The element layout is declared, so files are read once, without inference;
namespace prefixes, which differ between files, are ignored below the feature
element.  A building's geometry is a surface of one or more patches, each with
an exterior ring and any number of interior rings (courtyards); all of them
are kept.  Several files (one per municipality) are read as one multi-path
scan - the bag union of U1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element paths of the cadastral layout (local names).
_TEXT = "struct<_VALUE:string>"
_RING = f"struct<LinearRing:struct<posList:{_TEXT}>>"
_PATCH = f"struct<exterior:{_RING},interior:array<{_RING}>>"
_SURFACE = f"struct<patches:struct<PolygonPatch:array<{_PATCH}>>>"
GML_SCHEMA = (
    "reference string, currentUse string, conditionOfConstruction string, numberOfDwellings string, "
    f"numberOfBuildingUnits string, officialArea struct<OfficialArea:struct<value:{_TEXT}>>, "
    f"geometry struct<BuildingGeometry:array<struct<geometry:struct<Surface:{_SURFACE},"
    f"MultiSurface:struct<surfaceMember:array<struct<Surface:{_SURFACE}>>>>>>>")
RING_TYPE = "array<struct<x:double,y:double>>"
PARTS_TYPE = f"array<struct<exterior:{RING_TYPE},holes:array<{RING_TYPE}>>>"


def poslist_to_ring(text: Column) -> Column:
    """'x1 y1 x2 y2 ...' -> array<struct<x, y>>; null for a text that is empty, odd or not numeric."""
    nums = F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("double"))
    whole = (F.size(nums) % 2 == 0) & ~F.exists(nums, lambda v: v.isNull())
    idx = F.sequence(F.lit(0), F.greatest((F.size(nums) / 2).cast("int") - 1, F.lit(0)))
    return F.when(whole, F.transform(idx, lambda i: F.struct(F.get(nums, i * 2).alias("x"), F.get(nums, i * 2 + 1).alias("y"))))


def _ring(r: Column) -> Column:
    return poslist_to_ring(r["LinearRing"]["posList"]["_VALUE"])


def _parts() -> Column:
    """All patches of all surfaces of all building geometries, in document order."""
    none = F.array().cast(f"array<{_SURFACE}>")

    def surfaces(g: Column) -> Column:
        one = F.when(g["geometry"]["Surface"].isNotNull(), F.array(g["geometry"]["Surface"])).otherwise(none)
        many = F.transform(g["geometry"]["MultiSurface"]["surfaceMember"], lambda m: m["Surface"])
        return F.concat(one, F.coalesce(many, none))
    found = F.flatten(F.transform(F.col("geometry.BuildingGeometry"), surfaces))
    patches = F.flatten(F.filter(F.transform(found, lambda s: s["patches"]["PolygonPatch"]), lambda p: p.isNotNull()))
    return F.transform(patches, lambda p: F.struct(
        _ring(p["exterior"]).alias("exterior"),
        F.coalesce(F.transform(p["interior"], _ring), F.array().cast(f"array<{RING_TYPE}>")).alias("holes")))


def read_gml_buildings(spark: SparkSession, paths: str | Sequence[str],
                       row_tag: str = "bu-ext2d:Building") -> DataFrame:
    """Buildings with GML field names, ``parts`` (every patch with its rings), ``geometry``, ``geometry_error`` and ``source_file``.

    ``geometry`` is the exterior ring of the first patch.  A building with a ring
    whose coordinates are missing, empty, odd in number or not numeric keeps its
    other fields; its ``parts`` and ``geometry`` are null and ``geometry_error``
    says which kind of ring it is.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = (spark.read.format("xml").schema(GML_SCHEMA).option("rowTag", row_tag.rsplit(":", 1)[-1]).option("attributePrefix", "_")
           .option("valueTag", "_VALUE").option("ignoreNamespace", "true").load(paths))
    number = lambda c: c.try_cast("int")
    rows = raw.select(
        "reference", "currentUse", "conditionOfConstruction",
        number(F.col("numberOfDwellings")).alias("numberOfDwellings"),
        number(F.col("numberOfBuildingUnits")).alias("numberOfBuildingUnits"),
        number(F.col("officialArea.OfficialArea.value._VALUE")).alias("value"),
        _parts().alias("parts"), F.input_file_name().alias("source_file"))
    error = (F.when(F.exists("parts", lambda p: p["exterior"].isNull()), "exterior ring without coordinates")
             .when(F.exists("parts", lambda p: F.exists(p["holes"], lambda h: h.isNull())), "interior ring without coordinates"))
    rows = rows.withColumn("geometry_error", error).withColumn("parts", F.when(F.col("geometry_error").isNull(), F.col("parts")))
    fields = [c for c in rows.columns if c not in ("geometry_error", "source_file")]
    return rows.withColumn("geometry", F.get("parts", 0)["exterior"]).select(*fields, "geometry", "geometry_error", "source_file")


def ring_to_poslist(ring: Column) -> Column:
    """array<struct<x, y>> -> 'x1 y1 x2 y2 ...'."""
    return F.concat_ws(" ", F.flatten(F.transform(ring, lambda p: F.array(p["x"].cast("string"),
                                                                         p["y"].cast("string")))))


def write_gml_buildings(buildings: DataFrame, path: str, row_tag: str = "Building",
                        root_tag: str = "FeatureCollection") -> None:
    """Buildings (GML field names + ``parts``, or one ``geometry`` ring) as GML features, element
    paths as in the cadastral layout.  Spark's XML writer cannot emit
    namespace prefixes, so elements carry local names; the reader matches
    local names either way."""
    def nest(col: Column, *names: str) -> Column:
        """``col`` inside elements ``names`` (innermost first)."""
        for n in names:
            col = F.struct(col).alias(n)
        return col

    def ring(r: Column, name: str) -> Column:
        return nest(ring_to_poslist(r).alias("posList"), "LinearRing", name)
    parts = F.col("parts") if "parts" in buildings.columns else F.array(F.struct(
        F.col("geometry").alias("exterior"), F.array().cast(f"array<{RING_TYPE}>").alias("holes")))
    patches = F.transform(parts, lambda p: F.struct(
        ring(p["exterior"], "exterior"),
        F.transform(p["holes"], lambda h: ring(h, "interior")["LinearRing"]).alias("_h")))
    patches = F.transform(patches, lambda p: F.struct(
        p["exterior"].alias("exterior"), F.transform(p["_h"], lambda r: F.struct(r.alias("LinearRing"))).alias("interior")))
    surface = nest(patches.alias("PolygonPatch"), "patches", "Surface", "geometry", "BuildingGeometry", "geometry")
    feats = buildings.select(
        *[F.col(c) for c in ("conditionOfConstruction", "currentUse", "reference", "numberOfDwellings")
          if c in buildings.columns],
        nest(F.col("value").alias("value"), "OfficialArea", "officialArea"),
        surface)
    (feats.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag)
     .mode("overwrite").save(path))
