"""Raw map elements to typed tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import lift_kind, poi_kind, relation_is_ferrata, tag, transit_kind, way_is_ferrata
from ..operators.lineage import cut

POINT = "struct<lat double, lon double>"
#: One element; area_id and pos (its place in the input) come with it.
ELEMENT = f"area_id int, pos long, type string, id long, tags map<string,string>, lat double, lon double, center {POINT}, geometry array<{POINT}>, members array<struct<type string, ref long, role string, geometry array<{POINT}>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Elements from JSON lines, with the declared schema."""
    return spark.read.schema(ELEMENT).json(path)


def place() -> Column:
    """Own coordinates, else the centre, else the first vertex."""
    own = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    return F.coalesce(own, F.col("center"), F.get("geometry", F.lit(0)))


def split(elements: DataFrame) -> DataFrame:
    """Elements once each (the first of a type and id in an area), with class and kind. The first class that fits counts: way_tags (a way
    that has tags alone), route, ferrata_way, parking, lift, transit, poi."""
    first = Window.partitionBy("area_id", "type", "id", F.col("geometry").isNull() & F.col("center").isNull() & F.col("lat").isNull()).orderBy("pos")
    rows = elements.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    bare = (F.col("type") == "way") & F.col("geometry").isNull() & F.col("center").isNull() & F.col("lat").isNull()
    is_route = (F.col("type") == "relation") & F.coalesce(tag(tags, "route").isin("hiking", "foot", "via_ferrata"), F.lit(False))
    known = {
        "way_tags": bare, "route": is_route, "ferrata_way": (F.col("type") == "way") & way_is_ferrata(tags), "parking": F.coalesce(tag(tags, "amenity") == "parking", F.lit(False)),
        "lift": lift_kind(tags).isNotNull(), "transit": transit_kind(tags).isNotNull(), "poi": poi_kind(tags).isNotNull(),
    }
    name = F.coalesce(*(F.when(fits, F.lit(k)) for k, fits in known.items()))
    kind = F.when(name == "lift", lift_kind(tags)).when(name == "transit", transit_kind(tags)).when(name == "poi", poi_kind(tags))
    return rows.withColumn("tags", tags).withColumn("class", name).withColumn("kind", kind).withColumn("name", F.nullif(tag(tags, "name"), F.lit(""))).where(F.col("class").isNotNull())


def features(parts: DataFrame) -> DataFrame:
    """area_id, class, kind, name, feature_id, station_idx, lat, lon. A lift has both ends as stations, one if it is a ring."""
    tips = F.array_distinct(F.array_compact(F.array(F.get("geometry", F.lit(0)), F.element_at("geometry", -1))))
    at = F.when((F.col("class") == "lift") & (F.size("geometry") > 0), tips).otherwise(F.array(place()))
    rows = parts.where(F.col("class").isin("parking", "lift", "transit", "poi")).select("area_id", "class", "kind", "name", F.col("id").alias("feature_id"), F.posexplode(at).alias("station_idx", "p"))
    return rows.where(F.col("p").isNotNull()).select("area_id", "class", "kind", "name", "feature_id", "station_idx", "p.lat", "p.lon")


def routes(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """routes (area_id, route_id, seq, name, ref, unnamed, tags, is_ferrata), their ways (with tags where they were fetched) and vertices.
    Relations without a way that has geometry are left out."""
    relations = parts.where("class = 'route'")
    members = relations.select("area_id", F.col("id").alias("route_id"), F.posexplode("members").alias("place", "m")).where((F.col("m.type") == "way") & (F.size("m.geometry") > 0))
    members = members.withColumn("way_idx", F.row_number().over(Window.partitionBy("area_id", "route_id").orderBy("place")) - 1)
    known = parts.where("class = 'way_tags'").select("area_id", F.col("id").alias("way_id"), F.col("tags").alias("tags"))
    ways = members.select("area_id", "route_id", "way_idx", F.col("m.ref").alias("way_id")).join(known, ["area_id", "way_id"], "left").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    vertices = members.select("area_id", "route_id", "way_idx", F.posexplode("m.geometry").alias("vtx_idx", "p")).select("area_id", "route_id", "way_idx", "vtx_idx", "p.lat", "p.lon")
    ref = F.nullif(tag(F.col("tags"), "ref"), F.lit(""))
    table = relations.select("area_id", F.col("id").alias("route_id"), F.col("pos").alias("seq"), *display_name(F.col("name"), ref, F.col("id")), ref.alias("ref"), "tags", relation_is_ferrata(F.col("tags")).alias("is_ferrata"))
    return table.join(members.select("area_id", "route_id").distinct(), ["area_id", "route_id"], "left_semi"), ways, vertices


def display_name(name: Column, ref: Column, route_id: Column) -> tuple[Column, Column]:
    """Name, else reference, else route/<id>; and whether it has neither."""
    return F.coalesce(name, ref, F.concat(F.lit("route/"), route_id)).alias("name"), (name.isNull() & ref.isNull()).alias("unnamed")


#: An element's text, without what read adds to it.
TEXT = ELEMENT.removeprefix("area_id int, pos long, ")
#: Strings and brackets of JSON.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')
DECODER = json.JSONDecoder()
#: Strings of JSON as the JVM's patterns say it, without a way back: strings of any length take no stack.
STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'


def end_of(line: str, start: int) -> int:
    """Where the JSON value that begins at start ends; 0 if the line does not hold all of it."""
    try:
        return DECODER.raw_decode(line, start)[1]
    except (ValueError, RecursionError):
        return 0


def read_documents(spark: SparkSession, path: str, area: str = r"([0-9]+)\.[a-z]+$") -> DataFrame:
    """Elements of documents {..., "elements": [...]}, with pos in the order of the document. area: a pattern whose first group is the area in a
    file's name.

    A line break never stands inside a JSON string, so documents are read as lines, block by block, whatever their size. What a block opens
    and closes is counted first, without Python; from that each block knows how deep it begins. Where an element begins and its line holds
    all of it, a JSON decoder finds its end; other lines are read sign by sign. Elements that go over the end of a block are put
    together from their pieces. A document in one line is read by one task; one that is cut short gives its whole elements."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("path", "start", "value")), strict=True)

    # a row a block: as many as the scan has splits, which the driver lists anyway
    bare = F.regexp_replace("value", STRING, "")
    opened = F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))
    each = lines.groupBy("path", "start").agg(F.sum(opened).alias("opened"))
    before = Window.partitionBy("path").orderBy("start")
    known = each.select("path", "start", (F.sum("opened").over(before) - F.col("opened")).alias("depth"), (F.row_number().over(before) - 1).alias("block"))
    at = {(r.path, r.start): (r.depth, r.block) for r in known.collect()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Elements and pieces of them: begins and ends say whether a piece has the element's own first and last sign."""
        for key, rows in groupby(blocks(batches), lambda x: x[:2]):
            depth, block = at[key]
            out, piece, begins, n = [], [] if depth > 2 else None, False, 0
            for _, _, line in rows:
                first = seen = 0
                while m := TOKEN.search(line, seen):
                    seen = m.end()
                    if m[0] in "{[":
                        if m[0] == "{" and depth == 2:
                            if end := end_of(line, m.start()):
                                out.append((line[m.start() : end], True, True, (block << 40) + n))
                                piece, n, seen = None, n + 1, end
                                continue
                            piece, begins, first = [], True, m.start()
                        depth += 1
                    elif m[0] in "}]":
                        depth -= 1
                        if depth == 2 and m[0] == "}" and piece is not None:
                            piece.append(line[first : m.end()])
                            out.append(("\n".join(piece), begins, True, (block << 40) + n))
                            piece, n = None, n + 1
                if piece is not None:
                    piece.append(line[first:])
                if len(out) > 1000:
                    yield batch(key[0], out)
                    out.clear()
            if piece:
                out.append(("\n".join(piece), begins, False, (block << 40) + n))
            yield batch(key[0], out)

    def batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
        text, begins, ends, pos = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_pydict({"path": pa.array([name] * len(rows), pa.string()), "text": pa.array(text, pa.string()), "begins": pa.array(begins, pa.bool_()), "ends": pa.array(ends, pa.bool_()), "pos": pa.array(pos, pa.int64())})

    found = cut(lines.mapInArrow(cut_out, "path string, text string, begins boolean, ends boolean, pos long"))
    pieces = found.where("not (begins and ends)")  # two a block at most
    whose = F.last(F.when(F.col("begins"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("path").orderBy("pos", F.desc("begins")))
    joined = pieces.withColumn("own", whose).groupBy("path", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("ends").alias("whole"))
    every = found.where("begins and ends").select("path", "pos", "text").unionByName(joined.where("whole").select("path", F.col("own").alias("pos"), "text"))
    rows = every.select(F.regexp_extract("path", area, 1).cast("int").alias("area_id"), "pos", F.from_json("text", TEXT).alias("e")).select("area_id", "pos", "e.*")
    return rows.where("type is not null and id is not null")
