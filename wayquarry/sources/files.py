"""Tables, delimited text, GeoJSON, JSON of several shapes, and files by name."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geojson


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to a few tasks for each core, before work that is much for its bytes: Spark splits files by size, and a small file is one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Delimited text with a header; quotes are doubled within quotes, and a quoted value may span lines."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Raw rows with tabs between values, as strings; NULL is null."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("sep", "\t").option("nullValue", "NULL").option("quote", "").schema(schema).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


FEATURE = "id string, geometry string, properties map<string, string>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature of the GeoJSON collections at path: path, id, geometry (GeoJSON text), properties. Other files give none."""
    found = geojson.texts(spark, path)
    return found.select("path", F.from_json("feature", FEATURE).alias("f")).select("path", "f.*")


def records(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of JSON texts: an array, {records: [...]}, or GeoJSON features with their properties."""
    rows = f"array<struct<{schema}>>"
    plain, wrapped = F.from_json(column, rows), F.from_json(column, f"records {rows}")["records"]
    shaped = F.from_json(column, f"features array<struct<properties: struct<{schema}>>>")["features"]
    own = F.when(F.trim(column).startswith("["), F.coalesce(plain, F.array())).otherwise(F.coalesce(wrapped, F.transform(shaped, lambda f: f["properties"])))
    return texts.select(F.explode(own).alias("r")).select("r.*")


def property_of(properties: Column, names: Sequence[str]) -> Column:
    """The first filled one of several property names, in any case."""
    lower = F.map_from_entries(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(*[F.nullif(F.trim(lower[n.lower()]), F.lit("")) for n in names])


# What features call their properties.
NODE_NAMES = {"external_id": ["id", "objectid", "knoop_id"], "number": ["number", "nr", "knoopnr"], "name": ["name", "naam", "label"]}
CONNECTION_NAMES = {"external_id": ["id", "objectid"], "from_key": ["from", "startnr", "van"], "to_key": ["to", "eindnr", "naar"], "distance": ["distance", "afstand", "length"]}


def named(found: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Features with columns by the first property name that is filled."""
    columns = {out: property_of(F.col("properties"), of) for out, of in names.items()}
    columns["external_id"] = F.coalesce(columns["external_id"], F.col("id")) if "external_id" in columns else F.col("id")
    return found.withColumns(columns)


def latest_files(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name) with the path of the file of that name, in any case; of several the first by path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    there = listing.groupBy(name.alias("_name")).agg(F.min("path").alias("path"))
    return wanted.join(there, F.lower(F.element_at(F.split("name", "/"), -1)) == there["_name"], "left").drop("_name")


def postcode_points(spark: SparkSession, path: str) -> DataFrame:
    """postcode, lat and lng from a script that lists them as '1234': [51.1, 4.2]."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"""(['"]\d{4}['"]\s*:\s*\[\s*-?[\d.]+\s*,\s*-?[\d.]+\s*\])"""), F.lit(1))).alias("x"))
    part = lambda k: F.regexp_extract("x", r"(\d{4})\D*:\s*\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)", k)
    return found.select(part(1).alias("postcode"), part(2).cast("double").alias("lat"), part(3).cast("double").alias("lng"))
