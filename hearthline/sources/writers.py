"""Result tables in the shape they are stored in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.config import FORECAST_CHANNELS, HeatConfig
from hearthline.operators.columns import hourly_wide


def _named(arrays: dict[str, str], names: list[str]) -> list[Column]:
    return [
        F.get(column, F.lit(i)).alias(f"{prefix}{name}")
        for i, name in enumerate(names)
        for prefix, column in arrays.items()
    ]


def energy_params_table(params: DataFrame, cfg: HeatConfig) -> DataFrame:
    """One row per house: number of days, each coefficient with its error, fit quality."""
    names = ["intercept", *cfg.feature_names]
    pairs = _named({"": "coefficients", "std_error_": "std_errors"}, names)
    return params.select("house_alias", "n_days", *pairs, "r_squared", "energy_ratio")


def trailing_params_table(fits: DataFrame, cfg: HeatConfig) -> DataFrame:
    """One row per house, look-back and fit day with numbered coefficients (main model)."""
    names = [f"B{i}" for i in range(len(cfg.feature_names) + 1)]
    values = _named({"": "coefficients"}, names)
    errors = _named({"std_error_": "std_errors"}, names)
    return fits.select("house_alias", "n", "fit_day", *values, *errors, "r_squared", "energy_ratio")


def run_manifest(
    houses: DataFrame, start: datetime, end: datetime, run_ms: int, cfg: HeatConfig
) -> DataFrame:
    """One row per house of a run: bounds, parameters, and where its results go."""
    run_dir = f"results/result_{run_ms}"
    house_dir = F.concat(F.lit(f"{run_dir}/"), F.col("house_alias"))
    parts = ("energy_params", "rswt_params", "trailing_performance", "sweep_n")
    return houses.select("house_alias").distinct().select(
        F.lit(start.isoformat()).alias("start_time"),
        F.lit(end.isoformat()).alias("end_time"),
        F.lit(cfg.timezone).alias("timezone"),
        F.lit(run_ms).cast("bigint").alias("run_ms"),
        F.lit(run_dir).alias("run_dir"),
        "house_alias",
        house_dir.alias("house_dir"),
        *[F.concat(house_dir, F.lit(f"/{p}")).alias(f"{p}_dir") for p in parts],
        F.lit(cfg.to_json()).alias("parameters"),
    )


def write_run_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines in a folder per house: writing a house again replaces its entry alone."""
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("house_alias").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_hourly(hourly: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The engine's hourly table: range-partitioned and sorted by house and hour.

    Files cover disjoint house ranges, so a later read of a few houses skips the others by
    file statistics, without a directory per house.
    """
    ordered = hourly.repartitionByRange("house_alias", "hour_start")
    ordered.sortWithinPartitions("house_alias", "hour_start").write.mode(mode).parquet(path)


def write_hourly_csv(hourly: DataFrame, path: str, zones: list[int] | None = None, mode: str = "overwrite") -> None:
    """Wide CSV in a directory per house, sorted by hour, missing values blank.

    Zones are those of the data unless named; naming fewer than the data has is an error.
    """
    # as many rows as there are zone numbers in any house
    found = sorted(r[0] for r in hourly.select(F.explode("zones.zone")).distinct().collect())
    if zones is not None and not set(found) <= set(zones):
        raise ValueError(f"the data has zones {found}, not only {zones}")
    zones = found if zones is None else zones
    wide = hourly_wide(hourly, zones)
    text = wide.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in FORECAST_CHANNELS})
    text.withColumn("hour_start", F.date_format("hour_start", "yyyy-MM-dd'T'HH:mm:ss")).repartitionByRange(
        "house_alias"
    ).sortWithinPartitions("house_alias", "hour_start").write.mode(mode).partitionBy("house_alias").option(
        "header", True
    ).csv(path)


def replace_partitions(df: DataFrame, path: str, partition: list[str], order: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; the others stay as they are.

    The new files are moved in place when all are written, so a job that fails changes nothing.
    """
    placed = df.repartition(*partition).sortWithinPartitions(*partition, *order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def drop_partitions(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Delete partitions of a table that have no rows left."""
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
