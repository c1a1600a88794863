import json

import pytest
from pyspark.sql import functions as F

from trailspark import document_queries
from trailspark.operators import export, inventory
from trailspark.operators.lineage import cut
from trailspark.sources import elements, store


def test_raw_elements_become_typed_tables(spark, tmp_path):
    at = lambda y, x: {"lat": y, "lon": x}
    rows = [
        {"type": "relation", "id": 5301, "tags": {"route": "hiking", "name": "Fern Valley"}, "members": [{"type": "way", "ref": 7, "role": "main", "geometry": [at(50.0, 15.0), at(50.0, 15.01)]}, {"type": "node", "ref": 77, "role": "guidepost"}]},
        {"type": "relation", "id": 43, "tags": {"route": "hiking", "ref": "R1"}, "members": [{"type": "node", "ref": 1, "role": ""}]},
        {"type": "relation", "id": 44, "tags": {"route": "foot", "ref": "R2"}, "members": [{"type": "way", "ref": 8, "role": "", "geometry": [at(50.1, 15.0), at(50.1, 15.01), at(50.1, 15.02)]}]},
        {"type": "way", "id": 7, "tags": {"surface": "gravel"}},
        {"type": "node", "id": 2, "tags": {"amenity": "parking", "name": "P"}, "lat": 50.0, "lon": 15.0},
        {"type": "way", "id": 3, "tags": {"amenity": "parking"}, "center": at(50.01, 15.02)},
        {"type": "way", "id": 4, "tags": {"aerialway": "chair_lift", "name": "Summit line"}, "geometry": [at(50.0, 15.0), at(50.005, 15.0), at(50.01, 15.0)]},
        {"type": "way", "id": 5, "tags": {"aerialway": "drag_lift"}, "geometry": [at(50.0, 15.0), at(50.01, 15.0)]},
        {"type": "way", "id": 6, "tags": {"via_ferrata_scale": "0"}, "geometry": [at(50.0, 15.0), at(50.01, 15.0)]},
        {"type": "node", "id": 9, "tags": {"natural": "tree", "name": ""}, "lat": 50.0, "lon": 15.0},
        {"type": "node", "id": 10, "tags": {"natural": "tree"}, "lat": 50.0, "lon": 15.0},
        {"type": "node", "id": 2, "tags": {"amenity": "parking", "name": "again"}, "lat": 51.0, "lon": 15.0},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(r | {"area_id": 1, "pos": k}) for k, r in enumerate(rows)))
    parts = elements.split(elements.read(spark, str(tmp_path)))
    assert {(r.id, r["class"]) for r in parts.collect()} == {(5301, "route"), (43, "route"), (44, "route"), (7, "way_tags"), (2, "parking"), (3, "parking"), (4, "lift"), (6, "ferrata_way"), (9, "poi")}
    found = {(r["class"], r.feature_id, r.station_idx, r.lat, r.lon, r.name) for r in elements.features(parts).collect()}
    assert found == {("parking", 2, 0, 50.0, 15.0, "P"), ("parking", 3, 0, 50.01, 15.02, None), ("lift", 4, 0, 50.0, 15.0, "Summit line"), ("lift", 4, 1, 50.01, 15.0, "Summit line"), ("poi", 9, 0, 50.0, 15.0, None)}
    routes, ways, vertices = elements.routes(parts)
    assert {(r.route_id, r.name, r.ref, r.unnamed, r.is_ferrata) for r in routes.collect()} == {(5301, "Fern Valley", None, False, False), (44, "R2", "R2", False, False)}
    assert {(r.route_id, r.way_idx, r.way_id): r.tags for r in ways.collect()} == {(5301, 0, 7): {"surface": "gravel"}, (44, 0, 8): {}}
    assert vertices.groupBy("route_id").count().orderBy("route_id").collect() == [(44, 3), (5301, 2)]


def plain(e: dict) -> tuple:
    """An element as rows give it."""
    points = lambda g: None if g is None else [(p["lat"], p["lon"]) for p in g]
    members = e.get("members")
    return (e["type"], e["id"], e.get("tags"), e.get("lat"), points(e.get("geometry")), members and [(m["type"], m["ref"], points(m.get("geometry"))) for m in members])


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1, "lines"])
def test_documents_are_read_in_order_whatever_their_size_and_layout(spark, tmp_path, split, indent):
    """Brackets, quotes and breaks in strings, other objects around, pieces over several blocks, a document cut short."""
    at = lambda y, x: {"lat": y, "lon": x}
    def some(area):
        return [
            {"type": "node", "id": area * 100 + 1, "tags": {"name": 'a "b" {c]\\', "note": "x\ny"}, "lat": 50.5, "lon": 15.0}, {"type": "way", "id": area * 100 + 2, "tags": {}, "geometry": [at(50.0 + k, 15.0) for k in range(30)]},
            {"type": "relation", "id": area * 100 + 3, "tags": {"k": "]}"}, "members": [{"type": "way", "ref": 2, "role": "", "geometry": [at(50.0, 15.0), at(50.25, 15.0)]}, {"type": "node", "ref": 9, "role": "x"}]}, {"type": "way", "id": area * 100 + 4},
        ]
    for area in (1, 2):
        doc = {"version": 0.6, "meta": {"by": "{[", "more": {"deep": [{"x": 1}]}}, "elements": some(area)}
        if indent == "lines":
            text = '{"version": 0.6, "elements": [\n' + ",\n".join(json.dumps(e) for e in some(area)) + "\n]}"
        else:
            text = json.dumps(doc, indent=indent)
        (tmp_path / f"{area}.json").write_text(text)
    (tmp_path / "3.json").write_text('{"elements": [\n' + json.dumps(some(3)[0]) + ",\n" + json.dumps(some(3)[1])[:-9])
    (tmp_path / "4.json").write_text('{"elements": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = elements.read_documents(spark, str(tmp_path)).orderBy("area_id", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [(r.area_id, *plain(r.asDict(recursive=True))) for r in rows] == [(a, *plain(e)) for a, es in ((1, some(1)), (2, some(2)), (3, some(3)[:1])) for e in es]


def test_an_element_in_one_line_is_found_by_its_end():
    line = '{"a": "}", "b": [{"c": 1}]}, {"d"'
    assert line[: elements.end_of(line, 0)] == '{"a": "}", "b": [{"c": 1}]}' and elements.end_of(line, line.index('{"d"')) == 0 and elements.end_of("{" * 9, 0) == 0
    assert elements.end_of('{"a":' + "[" * 100_000 + "]" * 100_000 + "}", 0) == 0  # too deep for the decoder: read sign by sign


def test_classes_of_documents_are_counted_without_a_table_of_whole_elements(spark, monkeypatch):
    written = []
    monkeypatch.setattr(document_queries, "cut", lambda df: written.append(df.columns) or cut(df))
    rows = document_queries.element_documents(spark, "/root/testdata/sf0.001").collect()
    assert not any("members" in columns for columns in written) and {r["class"] for r in rows} == {"route", "way_tags", "ferrata_way", "poi", "parking", "transit", "lift"}


def test_areas_are_stored_apart_and_older_stores_read_with_nulls(spark, tmp_path):
    path = str(tmp_path / "store")
    areas = lambda *ids: spark.createDataFrame([(i, True) for i in ids], "area_id int, transit_recorded boolean")
    store.save({"areas": areas(1, 2)}, path)
    store.save({"areas": areas(2).withColumn("transit_recorded", F.lit(False))}, path)
    got = {r.area_id: (r.transit_recorded, r.poi_kinds) for r in store.load(spark, path, "areas", store.SCHEMAS["areas"]).collect()}
    assert got == {1: (True, None), 2: (False, None)}
    assert {r.area_id for r in store.sizes(spark, path).where("bytes > 0").collect()} == {1, 2}


def test_points_without_a_name_go_by_their_kind(spark):
    points = spark.createDataFrame([("ruins", None, 50.0, 15.0), ("peak", "A & B", 50.0, 15.0)], "kind string, name string, lat double, lon double")
    gpx = [r.value for r in export.gpx_waypoints(points).collect()]
    assert "<name>ruin</name>" in gpx[0] and "<name>A &amp; B</name><desc>peak</desc><type>peak</type>" in gpx[1]
    feature = json.loads(export.point_features(points).first().value)
    assert feature["geometry"] == {"type": "Point", "coordinates": [15.0, 50.0]} and feature["properties"] == {"kind": "ruins", "label": "ruin", "name": None}
    labels = spark.range(1).select(*(inventory.compose_label(F.lit(a), F.lit(b), F.lit(c)).alias(k) for k, (a, b, c) in {"x": ("A", "B", False), "y": ("A", "A", False), "z": ("A", None, True)}.items())).first()
    assert tuple(labels) == ("A → B", "near A", "loop near A")


def test_stored_areas_have_few_files(spark, tmp_path):
    """Finding F16: an area's rows are dealt out before they are written, so that not every task writes a file of every area."""
    rows = spark.range(4000).repartition(16).select((F.col("id") % 5).cast("int").alias("area_id"), F.col("id").alias("lat_key"), F.col("id").alias("lon_key"), F.lit(1.0).alias("elev"))
    store.save({"elevation_samples": rows}, str(tmp_path / "s"))
    files = list((tmp_path / "s" / "elevation_samples").glob("area_id=*/*.parquet"))
    assert len(files) == 5
    back = store.load(spark, str(tmp_path / "s"), "elevation_samples", store.SCHEMAS["elevation_samples"])
    assert back.count() == 4000 and back.select("area_id").distinct().count() == 5
