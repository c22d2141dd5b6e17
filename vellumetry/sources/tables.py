"""Tables and the rasters derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.functions.text import SPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, makes: int, most: int = 2_000_000) -> DataFrame:
    """rows dealt out by key, to so many tasks that each makes about `most` rows where one row becomes `makes`.  Unlike this,
    a small file is one task, however much is made of its rows.  What is grouped or joined by the key afterwards stays where it is."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * makes // most))
    return rows.repartition(tasks, key)


def pixels(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """raster_id, y, x, v: each embedding as a raster of `width` columns, scaled to 0..255 and rounded half to even."""
    values = F.transform("embedding", lambda e: e.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), values.alias("e"))
    e = e.select("raster_id", F.array_min("e").alias("low"), F.array_max("e").alias("high"), F.posexplode("e").alias("p", "value"))
    v = F.when(F.col("high") > F.col("low"), F.bround((F.col("value") - F.col("low")) * 255 / (F.col("high") - F.col("low")))).otherwise(0.0)
    return e.select("raster_id", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), v.cast("int").alias("v"))


def image_kind(content: Column) -> Column:
    """The format by its first bytes, never by a declared type."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    )


def png_size(content: Column) -> Column:
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(image_kind(content) == "image/png", F.struct(number(17).alias("width"), number(21).alias("height")))


def photo_from_data_url(url: Column, most_bytes: int = 5 * 1024 * 1024) -> Column:
    """(content, kind, error) of a data URL; error is invalid_photo or photo_too_large.  The declared type must be one of the
    accepted ones, but the kind is told from the bytes.  Decoding ends at the first padding, and an odd letter is left out."""
    body = F.regexp_replace(F.regexp_extract(url, rf"^data:image/(?:png|jpeg|jpg|webp);base64,([A-Za-z0-9+/={SPACE}]+)\z", 1), f"[{SPACE}]", "")
    body = F.regexp_extract(body, "^[^=]*", 0)
    odd = F.char_length(body) % 4
    content = F.try_to_binary(F.when(odd == 1, F.substring(body, F.lit(1), F.char_length(body) - 1)).when(odd > 1, F.rpad(body, F.char_length(body) + 4 - odd, F.lit("="))).otherwise(body), F.lit("base64"))
    bad = content.isNull() | (F.octet_length(content) == 0)
    error = F.when(bad, "invalid_photo").when(F.octet_length(content) > most_bytes, "photo_too_large").when(image_kind(content).isNull(), "invalid_photo")
    return F.struct(content.alias("content"), image_kind(content).alias("kind"), error.alias("error"))


def packed_rasters(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """raster_id, width, height, values: the rasters of pixels(), a row each, straight from the scan."""
    values = F.transform("embedding", lambda e: e.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), values.alias("e"))
    e = e.withColumns({"low": F.array_min("e"), "high": F.array_max("e")})
    scaled = F.transform("e", lambda v: F.when(F.col("high") > F.col("low"), F.bround((v - F.col("low")) * 255 / (F.col("high") - F.col("low")))).otherwise(0.0).cast("int"))
    return e.select("raster_id", F.lit(width).alias("width"), F.floor(F.size("e") / width).cast("int").alias("height"), scaled.alias("values"))
