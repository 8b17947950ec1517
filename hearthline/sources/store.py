"""Telemetry laid out so that a scan of some houses and days reads little else.

Every table is partitioned by ``day`` (UTC) and ``bucket``, a hash of the house. Requested names
give their buckets, so the reader drops the other folders before it opens a file: at planning for
a list of names, at run time (dynamic partition pruning) for a table of houses. Inside a file rows
are sorted by house and time, and aliases are stored normalised, so filters on them reach the
reader and its statistics skip what is left.

Next to the tables lie the list of channels and a dictionary of the aliases that occur, which
substring matching searches in place of the telemetry.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.sources.readers import BUCKETS, bucket_of, house_key

NO_HOUSE = -1  # bucket of readings whose channel is not in the list


class Telemetry(NamedTuple):
    """The inputs of an hourly build. ``aliases`` (house_alias) serves substring matching; it may be absent."""

    readings_1s: DataFrame
    readings: DataFrame
    channels: DataFrame
    messages: DataFrame
    aliases: DataFrame | None = None


def write_store(telemetry: Telemetry, path: str, buckets: int = 256) -> None:
    """Write all tables to a new folder ``path``.

    A task writes a day of a bucket at most, so files are as many as days times buckets in use.
    """
    channels = telemetry.channels.withColumn("house_alias", house_key(F.col("house_alias")))
    houses = channels.select(F.col("id").alias("channel_id"), F.col("house_alias").alias("owner"))
    owned = telemetry.readings.join(houses, "channel_id", "left")

    def placed_in(house: Column) -> Column:
        return F.when(house.isNull(), F.lit(NO_HOUSE)).otherwise(bucket_of(house, buckets))

    def laid_out(df: DataFrame, house: Column, order: list[str]) -> DataFrame:
        placed = df.withColumn("day", F.to_date("ts")).withColumn("bucket", placed_in(house))
        return placed.repartition("day", "bucket").sortWithinPartitions("day", "bucket", *order)

    seconds = telemetry.readings_1s.withColumn("house_alias", house_key(F.col("house_alias")))
    messages = telemetry.messages.withColumn("from_alias", house_key(F.col("from_alias")))
    tables = {
        "readings_1s": laid_out(seconds, F.col("house_alias"), ["house_alias", "ts"]),
        "readings": laid_out(owned, F.col("owner"), ["channel_id", "ts"]).drop("owner"),
        "messages": laid_out(messages, F.col("from_alias"), ["from_alias", "ts"]),
    }
    for name, table in tables.items():
        table.write.partitionBy("day", "bucket").parquet(f"{path}/{name}")
    channels.withColumn("bucket", placed_in(F.col("house_alias"))).write.parquet(f"{path}/channels")
    spark = channels.sparkSession
    stored = [spark.read.parquet(f"{path}/{n}").select(F.col(c).alias("house_alias")) for n, c in (
        ("readings_1s", "house_alias"), ("messages", "from_alias"), ("channels", "house_alias"))]
    aliases = reduce(DataFrame.unionByName, stored).where("house_alias IS NOT NULL").distinct()
    aliases.withColumn("bucket", bucket_of(F.col("house_alias"), buckets)).write.parquet(f"{path}/aliases")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")


def open_store(spark: SparkSession, path: str) -> Telemetry:
    """The tables of a store, as the scans take them."""
    buckets = spark.read.parquet(f"{path}/layout").first().buckets

    def opened(name: str, fields: str) -> DataFrame:
        df = spark.read.schema(f"{fields}, day date, bucket int").parquet(f"{path}/{name}")
        return df.withMetadata("bucket", {BUCKETS: buckets})

    def listed(name: str, fields: str) -> DataFrame:
        return spark.read.schema(f"{fields}, bucket int").parquet(f"{path}/{name}").withMetadata("bucket", {BUCKETS: buckets})

    return Telemetry(
        opened("readings_1s", schemas.READINGS_1S), opened("readings", schemas.READINGS), listed("channels", schemas.READING_CHANNELS),
        opened("messages", schemas.MESSAGES), listed("aliases", "house_alias string"),
    )
