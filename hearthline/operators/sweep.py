"""Comparing look-backs: forecast error against steadiness of a coefficient."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import MODEL_FEATURES, HeatConfig

_DELTA_T = 1 + MODEL_FEATURES.index("deltaT")


def coef_lag_diff(fits: DataFrame) -> DataFrame:
    """Change of the ``deltaT`` coefficient from one fit to the next."""
    in_time = Window.partitionBy("house_alias", "n").orderBy("fit_day")
    value = F.get("coefficients", F.lit(_DELTA_T))
    return fits.select(
        "house_alias", "n", "fit_day", value.alias("coefficient"),
        (value - F.lag(value).over(in_time)).alias("change"),
    )


def coef_stability(fits: DataFrame, cfg: HeatConfig) -> DataFrame:
    """How much the ``deltaT`` coefficient moves.

    Weekly training: mean absolute change between fits. Daily training: mean spread within
    the trailing seven calendar days.
    """
    if cfg.training_frequency == "daily":
        week = (
            Window.partitionBy("house_alias", "n")
            .orderBy(F.datediff("fit_day", F.lit("1970-01-01").cast("date")))
            .rangeBetween(-6, Window.currentRow)
        )
        value = F.get("coefficients", F.lit(_DELTA_T))
        moved = fits.withColumn("moved", F.max(value).over(week) - F.min(value).over(week))
    else:
        moved = coef_lag_diff(fits).withColumn("moved", F.abs("change"))
    return moved.groupBy("house_alias", "n").agg(
        F.count("*").alias("n_fits"), F.avg("moved").alias("stability")
    )
