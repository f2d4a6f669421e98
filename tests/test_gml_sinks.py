"""GML building reader and CSV round trip."""

import os
import tempfile

from wattlane.sources.gml import read_gml_buildings

GML = """<?xml version="1.0" encoding="UTF-8"?>
<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:bu-ext2d="urn:x-bu-ext2d"
   xmlns:bu-core2d="urn:x-bu-core2d">
 <gml:featureMember>
  <bu-ext2d:Building gml:id="B1">
   <bu-core2d:conditionOfConstruction>functional</bu-core2d:conditionOfConstruction>
   <bu-core2d:currentUse>1_residential</bu-core2d:currentUse>
   <bu-core2d:reference>REF0001</bu-core2d:reference>
   <bu-ext2d:numberOfDwellings>12</bu-ext2d:numberOfDwellings>
   <bu-ext2d:officialArea><bu-ext2d:OfficialArea>
     <bu-ext2d:value uom="m2">850</bu-ext2d:value></bu-ext2d:OfficialArea></bu-ext2d:officialArea>
   <bu-core2d:geometry><bu-core2d:BuildingGeometry><bu-core2d:geometry>
     <gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior><gml:LinearRing>
       <gml:posList srsDimension="2">300000.0 4600000.0 300010.0 4600000.0 300010.0 4600010.0 300000.0 4600000.0</gml:posList>
     </gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></gml:Surface>
   </bu-core2d:geometry></bu-core2d:BuildingGeometry></bu-core2d:geometry>
  </bu-ext2d:Building>
 </gml:featureMember>
 <gml:featureMember>
  <bu-ext2d:Building gml:id="B2">
   <bu-core2d:conditionOfConstruction>ruin</bu-core2d:conditionOfConstruction>
   <bu-core2d:currentUse>2_agriculture</bu-core2d:currentUse>
   <bu-core2d:reference>REF0002</bu-core2d:reference>
   <bu-ext2d:numberOfDwellings>0</bu-ext2d:numberOfDwellings>
   <bu-ext2d:officialArea><bu-ext2d:OfficialArea>
     <bu-ext2d:value uom="m2">40</bu-ext2d:value></bu-ext2d:OfficialArea></bu-ext2d:officialArea>
   <bu-core2d:geometry><bu-core2d:BuildingGeometry><bu-core2d:geometry>
     <gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior><gml:LinearRing>
       <gml:posList srsDimension="2">1 2 3 4 5 6 1 2</gml:posList>
     </gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></gml:Surface>
   </bu-core2d:geometry></bu-core2d:BuildingGeometry></bu-core2d:geometry>
  </bu-ext2d:Building>
 </gml:featureMember>
</gml:FeatureCollection>
"""


def test_read_gml(spark):
    d = tempfile.mkdtemp(prefix="wattlane-gml-")
    paths = []
    for i in range(2):
        p = os.path.join(d, f"town{i}.gml")
        with open(p, "w") as f:
            f.write(GML)
        paths.append(p)
    df = read_gml_buildings(spark, paths)
    rows = sorted(df.collect(), key=lambda r: (r.reference, r.source_file))
    assert len(rows) == 4                                  # two files appended
    r = rows[0]
    assert (r.reference, r.currentUse, r.conditionOfConstruction) == ("REF0001", "1_residential", "functional")
    assert r.numberOfDwellings == 12 and r.value == 850
    assert [(p.x, p.y) for p in r.geometry][:2] == [(300000.0, 4600000.0), (300010.0, 4600000.0)]
    assert len(r.geometry) == 4


def test_load_curve_outputs_round_trip(spark):
    from wattlane.plans.catalogue import cleaned_meter
    from wattlane.plans.load_curves import identify_load_curves, write_outputs

    from .conftest import SF001
    res = identify_load_curves(cleaned_meter(spark, SF001), "z_norm_scaling", 3, do_silhouette=True)
    paths = write_outputs(res, tempfile.mkdtemp(prefix="wattlane-out-"))
    assert set(paths) >= {"labels", "merges", "top_merges", "daily_curves", "centroids_wide", "silhouette"}
    assert spark.read.parquet(paths["labels"]).count() == res.labels.count()
    sil = spark.read.parquet(paths["silhouette"]).toPandas()
    assert sorted(sil.k) == list(range(2, 10)) and sil.silhouette_sqeuclidean.between(-1, 1).all()
    assert spark.read.parquet(paths["top_merges"]).count() == 2


TWO = """<c:FeatureCollection xmlns:c="urn:c" xmlns:g="urn:g"><c:Building g:id="x"><c:reference>R</c:reference>
<c:geometry><c:BuildingGeometry><c:geometry><g:Surface><g:patches>
<g:PolygonPatch><g:exterior><g:LinearRing><g:posList>0 0 10 0 10 10 0 10 0 0</g:posList></g:LinearRing></g:exterior>
<g:interior><g:LinearRing><g:posList>4 4 6 4 6 6 4 4</g:posList></g:LinearRing></g:interior>
<g:interior><g:LinearRing><g:posList count="4">7 7 8 7 8 8 7 7</g:posList></g:LinearRing></g:interior></g:PolygonPatch>
<g:PolygonPatch><g:exterior><g:LinearRing><g:posList>20 0 30 0 30 10 20 0</g:posList></g:LinearRing></g:exterior></g:PolygonPatch>
</g:patches></g:Surface></c:geometry></c:BuildingGeometry></c:geometry></c:Building>
<c:Building g:id="y"><c:reference>S</c:reference></c:Building></c:FeatureCollection>"""


def test_every_patch_and_ring_is_read(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wattlane-gml-"), "t.gml")
    with open(path, "w") as f:
        f.write(TWO)
    r, s = sorted(read_gml_buildings(spark, path, row_tag="c:Building").collect(), key=lambda b: b.reference)
    assert [len(p.exterior) for p in r.parts] == [5, 4] and [len(p.holes) for p in r.parts] == [2, 0]
    assert [(v.x, v.y) for v in r.parts[0].holes[1]] == [(7, 7), (8, 7), (8, 8), (7, 7)]
    assert r.geometry == r.parts[0].exterior and r.value is None
    assert not s.parts and s.geometry is None


def test_malformed_rings_are_marked(spark, tmp_path):
    """Empty, odd and non-numeric coordinates: a null geometry with a reason, the other fields as they are."""
    def building(name, outer, inner=None):
        ring = lambda text: f"<gml:LinearRing><gml:posList>{text}</gml:posList></gml:LinearRing>"
        hole = f"<gml:interior>{ring(inner)}</gml:interior>" if inner is not None else ""
        return (f"<bu-ext2d:Building><bu-ext2d:reference>{name}</bu-ext2d:reference><bu-ext2d:geometry><bu-core2d:BuildingGeometry><bu-core2d:geometry>"
                f"<gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior>{ring(outer)}</gml:exterior>{hole}</gml:PolygonPatch></gml:patches></gml:Surface>"
                "</bu-core2d:geometry></bu-core2d:BuildingGeometry></bu-ext2d:geometry></bu-ext2d:Building>")
    good = "0 0 4 0 4 4 0 0"
    rows = [building("good", good), building("empty", ""), building("odd", "0 0 4 0 4"), building("text", "0 0 4 x 4 4 0 0"),
            building("hole", good, "1 1 2"), building("court", good, "1 1 2 1 2 2 1 1")]
    space = " ".join(f'xmlns:{p}="urn:{p}"' for p in ("bu-ext2d", "bu-core2d", "gml"))
    (tmp_path / "b.gml").write_text(f"<root {space}>{''.join(rows)}</root>")
    got = {r.reference: r for r in read_gml_buildings(spark, str(tmp_path / "b.gml")).collect()}
    assert {k: r.geometry_error for k, r in got.items()} == {
        "good": None, "court": None, "empty": "exterior ring without coordinates", "odd": "exterior ring without coordinates",
        "text": "exterior ring without coordinates", "hole": "interior ring without coordinates"}
    assert len(got["good"].geometry) == 4 and len(got["court"].parts[0].holes[0]) == 4
    assert all(got[k].geometry is None and got[k].parts is None for k in ("empty", "odd", "text", "hole"))
