"""GeoJSON polygons in and out, one feature per line or a whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RINGS = "array<array<array<double>>>"
_GEOMETRY = "struct<type:string,coordinates:string>"


def read_polygons(spark: SparkSession, path: str, name_field: str, *, lines: bool = True) -> DataFrame:
    """``name``, ``part``, ``rings`` and ``properties`` per polygon part.

    A record is a feature or a FeatureCollection. ``lines=True`` reads one record per
    line, which splits across tasks; ``lines=False`` reads documents of any layout, one
    task per document. A record that is no JSON, or neither form, or holds another kind
    of geometry than polygons, fails the read; features without a geometry have no part.
    """
    feature = f"geometry {_GEOMETRY}, properties map<string,string>"
    records = (
        spark.read.schema(f"type string, features array<struct<{_colons(feature)}>>, {feature}")
        .options(multiLine=not lines, mode="FAILFAST").json(path)
    )
    known = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(
        F.col("type") == "Feature", F.array(F.struct("geometry", "properties"))).otherwise(
        F.raise_error(F.concat(F.lit("not a feature or a collection: "), F.coalesce("type", F.lit("no type")))))
    features = records.select(F.explode(known).alias("_f")).select("_f.geometry", "_f.properties")
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(text, f"array<{_RINGS}>")).when(
        kind == "Polygon", F.array(F.from_json(text, _RINGS))).when(
        kind.isNotNull(), F.raise_error(F.concat(F.lit("not a polygon: "), kind)))
    return (
        features.select(F.col("properties")[name_field].alias("name"), "properties", F.posexplode(parts).alias("part", "_rings"))
        .select("name", "part", F.transform("_rings", _points).alias("rings"), "properties")
    )


def _colons(columns: str) -> str:
    """Columns of a table as fields of a struct."""
    return columns.replace("geometry ", "geometry:").replace("properties ", "properties:")


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _positions(ring: Column, x: str, y: str) -> Column:
    return F.transform(ring, lambda p: F.array(p[x], p[y]))


def with_feature(df: DataFrame, ring: str, properties: list[str], *, x: str = "lng", y: str = "lat") -> DataFrame:
    """Add each row's GeoJSON Feature as text; properties that are null are left out."""
    return df.withColumn("feature", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Polygon").alias("type"), F.array(_positions(F.col(ring), x, y)).alias("coordinates")
        ).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )))


def write_features(feature_rows: DataFrame, path: str) -> None:
    """Line-delimited features, written by the tasks that hold them."""
    feature_rows.select("feature").write.text(path)


def collections(df: DataFrame, feature: str, tile: str) -> DataFrame:
    """One FeatureCollection document per tile, for map widgets.

    Tiles must bound the number of features, as coarse cells do for the finer
    cells inside them: a document is put together in one task.
    """
    listed = F.array_join(F.array_sort(F.collect_list(feature)), ",")
    document = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), listed, F.lit("]}"))
    return df.groupBy(tile).agg(document.alias("document"))
