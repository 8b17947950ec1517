"""Scans of the input tables. Filters and column choices reach the file reader."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.config import (
    FORECAST_MESSAGE_TYPE,
    ZONE_CHANNEL_EXCLUDED,
    ZONE_CHANNEL_PATTERN,
    HeatConfig,
)
from hearthline.operators.columns import conform_columns, zone_struct_from_wide


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def half_open(ts: Column, start: datetime, end: datetime) -> Column:
    """``start <= ts < end``."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def house_key(alias: Column) -> Column:
    """Aliases compare without regard to case and surrounding blanks."""
    return F.lower(F.trim(alias))


def house_match(alias: Column, house: str, substring: bool = False) -> Column:
    """Whether a row belongs to a house.

    Exact by default. ``substring=True`` accepts any alias containing the text, which
    can pull in a second house with a longer name.
    """
    if substring:
        return alias.ilike(f"%{house}%")
    return house_key(alias) == house.strip().lower()


#: Metadata key of a ``bucket`` column: how many buckets its table was laid out in.
BUCKETS = "house_buckets"


def bucket_of(house: Column, buckets: int) -> Column:
    """Bucket of a normalised house name."""
    return F.pmod(F.xxhash64(house), F.lit(buckets)).cast("int")


def buckets_of(df: DataFrame) -> int | None:
    """In how many buckets a table is laid out; None if it is not."""
    return df.schema["bucket"].metadata.get(BUCKETS) if "bucket" in df.columns else None


def within_days(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of the stored days from one instant to another, if the table is laid out by day."""
    if buckets_of(df) is None or "day" not in df.columns:
        return df
    return df.where((F.col("day") >= F.to_date(first)) & (F.col("day") <= F.to_date(last)))


def requested(houses: DataFrame) -> DataFrame:
    """Normalised names, each once."""
    return houses.select(house_key(F.col("house_alias")).alias("house_alias")).where("house_alias IS NOT NULL").distinct()


def of_houses(df: DataFrame, houses: list[str] | DataFrame | None, column: str = "house_alias") -> DataFrame:
    """Rows of the requested houses, their names normalised; ``None`` stands for all.

    Tables of a store carry normalised names and a bucket, which prunes the partitions to read:
    of a list of names when the query is planned, of a table of houses when it runs.
    """
    buckets = buckets_of(df)
    rows = df if buckets else df.withColumn(column, house_key(F.col(column)))
    if houses is None:
        return rows
    if isinstance(houses, DataFrame):
        names = requested(houses).withColumnRenamed("house_alias", column)
        if not buckets:
            return rows.join(names, column, "left_semi")
        # The comparison holds for every bucket; it marks the names as a selective side.
        keyed = names.withColumn("bucket", bucket_of(F.col(column), buckets)).where(F.col("bucket") >= 0)
        return rows.join(keyed, ["bucket", column], "left_semi").select(*df.columns).withMetadata("bucket", {BUCKETS: buckets})
    names = sorted({h.strip().lower() for h in houses})
    if not buckets:
        # on the stored column; a blank-padded or capitalised alias still counts
        return rows.where(F.col(column).isin(names))
    return rows.where(F.col("bucket").isin(*[bucket_of(F.lit(n), buckets) for n in names]) & F.col(column).isin(names))


def owners(aliases: DataFrame, houses: DataFrame) -> DataFrame:
    """(stored, house_alias): which stored aliases contain the name of a requested house.

    Matched by an index of character triples: a name is looked up by the triple of its own that
    fewest aliases have, so there is no comparison of all names with all aliases. Names of one or
    two characters are looked up whole; a blank name owns nothing.
    """
    stored = aliases.select(house_key(F.col("house_alias")).alias("stored")).where("stored IS NOT NULL").distinct()
    names = requested(houses).where("house_alias <> ''")

    def grams(text: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1))), lambda i: text.substr(i, width))

    text = F.col("stored")
    all_grams = F.array_distinct(F.concat(*[grams(text, F.lit(w)) for w in (1, 2, 3)]))
    index = stored.select("stored", F.explode(all_grams).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = names.select("house_alias", F.explode(F.array_distinct(grams(F.col("house_alias"), F.lit(3)))).alias("gram"))
    # a triple that no alias has is the rarest, and its name has no owner
    rarest = own.join(frequency, "gram", "left").groupBy("house_alias").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("m")
    ).select("house_alias", "m.gram")
    return index.join(rarest, "gram").where(F.col("stored").contains(F.col("house_alias"))).select("stored", "house_alias")


def rows_of(
    df: DataFrame, houses: DataFrame, substring: bool = False, column: str = "house_alias", aliases: DataFrame | None = None
) -> DataFrame:
    """Rows of the requested houses, under the requested name.

    With ``substring`` a house owns every stored alias that contains its name; an alias that
    contains several names goes to each. ``aliases`` is a dictionary of the aliases in ``df``;
    without one they are gathered from ``df`` itself, at the cost of another scan.
    """
    if not substring:
        return of_houses(df, houses, column)
    buckets = buckets_of(df)
    known = df.select(F.col(column).alias("house_alias")) if aliases is None else aliases
    owned = owners(known, houses)
    rows = df.withColumn("stored", F.col(column) if buckets else house_key(F.col(column))).drop(column)
    if buckets:
        owned = owned.withColumn("bucket", bucket_of(F.col("stored"), buckets)).where(F.col("bucket") >= 0)
    found = rows.join(owned.withColumnRenamed("house_alias", column), ["bucket", "stored"] if buckets else "stored")
    return found.select(*df.columns)


def scan_readings_1s(
    readings_1s: DataFrame,
    start: datetime,
    end: datetime,
    channels: tuple[str, ...],
    houses: list[str] | DataFrame | None = None,
    substring: bool = False,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """One-second readings of some channels in ``[start, end)``, of some houses or all."""
    rows = readings_1s.where(half_open(F.col("ts"), start, end) & F.col("channel_name").isin(*channels))
    rows = within_days(rows, F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    rows = rows_of(rows, houses, True, aliases=aliases) if substring else of_houses(rows, houses)
    return rows.select("house_alias", "ts", "channel_name", "unit", "value")


def scan_readings_with_channels(
    readings: DataFrame,
    channels: DataFrame,
    start: datetime,
    end: datetime,
    houses: list[str] | DataFrame | None = None,
    substring: bool = False,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Irregular readings with their channel's house, name and unit.

    The join is left to the optimizer: it broadcasts the channel list while that is small
    and shuffles on the channel id (splitting hot ids) when a fleet outgrows the limit. Readings
    of a store are pruned by the buckets of the channels that the requested houses leave.
    """
    on = ["bucket", "channel_id"] if buckets_of(readings) and buckets_of(channels) else ["channel_id"]
    # a bucket is that of the stored alias, not of the name it is asked for by
    chosen = rows_of(channels, houses, True, aliases=aliases) if substring else of_houses(channels, houses)
    named = chosen.select(
        F.col("id").alias("channel_id"), "house_alias", F.col("name").alias("channel_name"), "unit", *[c for c in on if c == "bucket"]
    )
    if houses is not None and len(on) == 2:
        named = named.where(F.col("bucket") >= 0)
    rows = readings.where(half_open(F.col("ts"), start, end))
    rows = within_days(rows, F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return rows.select("channel_id", "ts", "value", *[c for c in on if c == "bucket"]).join(named, on).select(
        "channel_id", "ts", "value", "house_alias", "channel_name", "unit"
    )


def is_zone_channel(name: Column) -> Column:
    return name.rlike(ZONE_CHANNEL_PATTERN) & ~name.ilike(ZONE_CHANNEL_EXCLUDED)


def zone_of(name: Column) -> Column:
    return F.regexp_extract(name, ZONE_CHANNEL_PATTERN, 1).cast("int")


def kind_of(name: Column) -> Column:
    return F.regexp_extract(name, ZONE_CHANNEL_PATTERN, 2)


def scan_forecast_messages(
    messages: DataFrame, start: datetime, end: datetime, cfg: HeatConfig, houses: list[str] | DataFrame | None = None,
    substring: bool = False, aliases: DataFrame | None = None,
) -> DataFrame:
    """Parsed weather forecasts from the look-back before ``start`` up to ``end``."""
    since = F.lit(start).cast("timestamp_ntz") - F.expr(
        f"interval {int(cfg.forecast_lookback_hours)} hours"
    )
    until = F.lit(end).cast("timestamp_ntz")
    rows = messages.where(
        (F.col("message_type_name") == FORECAST_MESSAGE_TYPE)
        & (F.col("ts") >= since)
        & (F.col("ts") < until)
    )
    rows = within_days(rows, since, until)
    parsed = F.from_json("payload", schemas.FORECAST_PAYLOAD)
    rows = rows_of(rows, houses, True, "from_alias", aliases) if substring else of_houses(rows, houses, "from_alias")
    return rows.select(F.col("from_alias").alias("house_alias"), "ts", parsed.alias("p")).select(
        "house_alias", "ts", "p.Time", "p.OatF", "p.WindSpeedMph"
    )


def scan_hourly_cache(spark: SparkSession, path: str) -> DataFrame:
    """The engine's own hourly table (parquet)."""
    return conform_columns(spark.read.parquet(path))


def scan_hourly_csv(spark: SparkSession, path: str, house: str | None = None) -> DataFrame:
    """Wide hourly CSV files: unknown columns dropped, absent ones null.

    Either one house's file, or a directory per house as the writer lays it out. Each file is
    read by its own header; blanks and NaN become null. A zone without any value in a row is
    not a zone of that row.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    headers = lines.where(F.col("value").rlike('(^|,)"?hour_start"?(,|$)'))
    out = None
    # a row per header, with the files that have it: as many names as there are files
    for row in headers.groupBy("value").agg(F.collect_set("file").alias("files")).orderBy("value").collect():
        reader = spark.read.option("header", True)
        wide = (reader.option("basePath", path) if house is None else reader).csv(row.files)
        if house is not None:
            wide = wide.withColumn("house_alias", F.lit(house))
        part = conform_columns(zone_struct_from_wide(wide))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schemas.HOURLY) if out is None else out


def scan_solar(spark: SparkSession, path: str) -> DataFrame:
    """Hour and irradiance of a solar CSV; other columns are not read."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("hour_start").cast("timestamp_ntz").alias("hour_start"),
        F.col("solar_w_m2").cast("double").alias("solar_w_m2"),
    )
