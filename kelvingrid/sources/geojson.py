"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelvingrid.functions.scalars import iso_time

_FEATURES = (
    "struct<features: array<struct<geometry: struct<type: string, coordinates: string>>>>"
)
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def outer_rings(documents: DataFrame, text: str = "text") -> DataFrame:
    """(ring_id, ring) of all Polygon / MultiPolygon features; unreadable text gives no rows.

    ``ring_id`` numbers the rings of one document and carries its ``doc_id``.
    """
    doc = F.from_json(text, _FEATURES)
    geometry = documents.select("doc_id", F.posexplode(doc["features"]).alias("f", "feature")).select(
        "doc_id", "f", F.col("feature.geometry.type").alias("kind"), F.col("feature.geometry.coordinates").alias("c")
    )
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", _POLYGON))).when(
        F.col("kind") == "MultiPolygon", F.from_json("c", _MULTI)
    )
    return (
        geometry.select("doc_id", "f", F.posexplode(polygons).alias("p", "polygon"))
        .filter(F.size("polygon") > 0)
        .select(F.concat_ws("/", "doc_id", "f", "p").alias("ring_id"), F.col("polygon")[0].alias("ring"))
    )


def forecast_features(forecast: DataFrame) -> DataFrame:
    """One Feature text per pixel with its forecasts in step order (horizon-bounded list)."""
    entry = F.struct(
        "step",
        iso_time(F.col("target_time")).alias("target_time"),
        "y_pred",
        F.when(~F.isnan("y_true"), F.col("y_true")).alias("y_true"),
        F.when(~F.isnan("abs_error"), F.col("abs_error")).alias("abs_error"),
    )
    by = ["pixel_id", "lat_idx", "lon_idx", "latitude", "longitude", "window_end_time"]
    rows = forecast.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("forecast"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(
            "pixel_id", "lat_idx", "lon_idx", iso_time(F.col("window_end_time")).alias("window_end_time"), "forecast"
        ).alias("properties"),
    )
    return rows.select("pixel_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_features(forecast: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features; each task writes its own part."""
    forecast_features(forecast).select("feature").write.mode("overwrite").text(path)


def write_collection(forecast: DataFrame, path: str, model_name: str, window: int, generated_at: str) -> None:
    """One FeatureCollection with its envelope (``model_name``, ``window``, ``generated_at``), written by all tasks.

    The part files in name order are one document: the envelope's head, a feature a line, the closing brackets.  Lines are
    range-partitioned by (part of the document, pixel, end of window), so no task holds the collection; the first feature,
    which has no comma before it, is found by one aggregation.  No features: an empty list.
    """
    spark = forecast.sparkSession
    features = forecast_features(forecast)
    first = features.agg(F.min(F.struct("pixel_id", "feature"))).scalar()
    comma = F.when(F.struct("pixel_id", "feature") == first, "").otherwise(",")
    body = features.select(F.lit(1).alias("part"), "pixel_id", F.concat(comma, "feature").alias("line"))
    envelope = spark.range(1).select(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(model_name).alias("model_name"), F.lit(window).alias("window"), F.lit(generated_at).alias("generated_at"))).alias("e")
    )
    # the head is the envelope's text without its closing brace
    head = envelope.select(F.lit(0).alias("part"), F.lit("").alias("pixel_id"), F.concat(F.expr("left(e, length(e) - 1)"), F.lit(',"features":[')).alias("line"))
    foot = envelope.select(F.lit(2).alias("part"), F.lit("").alias("pixel_id"), F.lit("]}").alias("line"))
    lines = head.unionByName(body).unionByName(foot)
    lines.repartitionByRange("part", "pixel_id").sortWithinPartitions("part", "pixel_id", "line").select("line").write.mode("overwrite").text(path)


def read_collection(spark: SparkSession, path: str, feature_schema: str) -> DataFrame:
    """(model_name, window, generated_at, feature) of a written collection, a feature a row; lines are parsed where they lie."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith('{"type":"FeatureCollection"'))
    envelope = head.select(F.from_json(F.concat("value", F.lit("]}")), "struct<model_name: string, window: int, generated_at: string>").alias("e"))
    feature = F.from_json(F.regexp_replace("value", "^,", ""), feature_schema)
    rows = lines.filter(F.col("value").rlike('^,?\\{"type":"Feature",')).select(feature.alias("feature"))
    told = envelope.select("e").scalar()
    return rows.select(*[told[c].alias(c) for c in ("model_name", "window", "generated_at")], "feature")
