"""Readers and writers: GeoJSON, tagged ways, WKB, metadata, idempotent replacement by source."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..functions import vocab as V


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, valid): every feature of FeatureCollections; a feature without line geometry is not valid, never fatal."""
    text = spark.read.text(path, wholetext=True)
    return parse_features(text.select(F.explode(F.from_json("value", "struct<features:array<string>>")["features"]).alias("json")))


def parse_features(features: DataFrame) -> DataFrame:
    """(properties, kind, parts, valid) of JSON features (json). Extra properties are kept as they come."""
    f = features.select(F.from_json("json", "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>").alias("f"))
    kind = F.col("f.geometry.type")
    line = F.from_json("f.geometry.coordinates", "array<array<double>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(kind == "LineString", F.array(line)).when(kind == "MultiLineString", multi)
    # only longitude and latitude are read, so heights drop out
    flat = F.transform(parts, lambda part: F.transform(part, lambda p: F.struct(F.floor(p[0] * 1e7 + 0.5).cast("long").alias("lng_e7"), F.floor(p[1] * 1e7 + 0.5).cast("long").alias("lat_e7"))))
    valid = F.coalesce((F.col("f.type") == "Feature") & F.col("f.properties").isNotNull() & (F.size(flat) > 0), F.lit(False))
    return f.select("f.properties", kind.alias("kind"), flat.alias("parts"), valid.alias("valid"))


def to_records(valid: DataFrame) -> DataFrame:
    """Path records of official features."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    width = tags.clean(p("Width")).try_cast("double")
    return valid.select(
        tags.clean(p("OsmID")).try_cast("long").alias("osm_id"), p("InfraType").alias("infra_type"), tags.infra_category(p("InfraType")).alias("category"), tags.clean(p("Name")).alias("name"),
        F.lower(tags.clean(p("HwyType"))).alias("highway"), F.when(width > 0, width).alias("width_m"), tags.hazards(tags.clean(p("Hazards"))).alias("hazards"), tags.direction(p("DirRelToWay")).alias("direction"), "parts",
    )


def wkb_lines(df: DataFrame, column: str = "wkb") -> DataFrame:
    """Adds coordinates (degrees) of WKB LineStrings of either byte order; any other geometry is an error."""
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "coordinates array<struct<lng:double,lat:double>>"])

    def decode(blob: bytes) -> list[dict]:
        order = "<" if blob[0] == 1 else ">"
        kind, n = struct.unpack_from(f"{order}II", blob, 1)
        if kind != 2:
            raise ValueError(f"WKB type {kind} isn't a LineString")
        xy = np.frombuffer(blob, f"{order}f8", 2 * n, 9).reshape(n, 2)
        return [{"lng": float(x), "lat": float(y)} for x, y in xy]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(coordinates=[decode(bytes(b)) for b in pdf[column]])

    return df.mapInPandas(run, out)


def write_by_source(rows: DataFrame, path: str) -> None:
    """Replace what the table holds of the rows' sources, and leave the others: partitions by source, overwritten one by one."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def replaced(kept: DataFrame, new: DataFrame) -> DataFrame:
    """The table after its rows of the new rows' sources have been replaced."""
    return kept.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def enriched(paths: DataFrame, ways: DataFrame) -> DataFrame:
    """Official paths take surface and smoothness from the way they follow, nulls included; unmatched rows stay."""
    w = ways.select(F.col("way_id").alias("osm_id"), F.col("surface").alias("way_surface"), F.col("smoothness").alias("way_smoothness"), F.lit(True).alias("matched"))
    hit = F.col("matched") & (F.col("source") == V.OFFICIAL)
    pick = lambda c: F.when(hit, F.col(f"way_{c}")).otherwise(F.col(c))
    return paths.join(w, "osm_id", "left").withColumns({"surface": pick("surface"), "smoothness": pick("smoothness")}).drop("way_surface", "way_smoothness", "matched")


def uncovered(ways: DataFrame, coverage: DataFrame, share: float = 0.9) -> DataFrame:
    """Ways (way_id, length_m) that no covered length (osm_id, covered_m) covers by the share."""
    return ways.join(coverage, (F.col("way_id") == F.col("osm_id")) & (F.col("covered_m") >= share * F.col("length_m")), "left_anti")


def provenance(rows: DataFrame, source: str | Column, name: str) -> DataFrame:
    s = F.lit(source) if isinstance(source, str) else source
    return rows.agg(s.alias("source"), F.lit(name).alias("dataset"), F.count("*").alias("feature_count"))


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations not yet applied, in order of their names."""
    return files.join(applied, "name", "left_anti").orderBy("name")


def read_metadata(path: str) -> dict | None:
    """A sidecar file's record; None when it is absent or not JSON."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def write_metadata(path: str, record: dict) -> None:
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(record, indent=2))
    part.replace(target)


def encode_wkb(coords: list[tuple[float, float]], little: bool = True) -> bytes:
    order = "<" if little else ">"
    return struct.pack(f"{order}BII", int(little), 2, len(coords)) + np.array(coords, f"{order}f8").tobytes()


def with_wkb(lines: DataFrame) -> DataFrame:
    """(id, wkb) of fixed-point lines; even ids little endian, odd ones big."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "wkb": [encode_wkb([(p["lng_e7"] / 1e7, p["lat_e7"] / 1e7) for p in c], i % 2 == 0) for i, c in zip(pdf["id"], pdf["coordinates"], strict=True)]})

    return lines.select("id", "coordinates").mapInPandas(run, "id long, wkb binary")
