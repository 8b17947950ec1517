"""One run over all houses: parameters, return-water model, and optional backtests, as tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.config import HeatConfig
from hearthline.operators import clean, features as feat, merge, regression, rswt
from hearthline.plans import pipeline
from hearthline.session import stage
from hearthline.sources import readers, writers


def run(
    houses: DataFrame,
    hourly: DataFrame,
    solar: DataFrame | None,
    start: datetime,
    end: datetime,
    out_dir: str,
    run_ms: int,
    cfg: HeatConfig,
    n: int | None = None,
    backtest_n: int | None = None,
    sweep: tuple[int, int] | None = None,
) -> None:
    """Write every result of a run below ``out_dir``.

    Tables hold all houses and are told apart by ``house_alias``. A house that cannot be
    processed is missing from the result tables and explained in ``house_status``.
    """
    target = f"{out_dir.rstrip('/')}/result_{run_ms}"
    cropped = readers.rows_of(
        pipeline.crop(hourly, start, end), houses.select(readers.house_key(F.col("house_alias")).alias("house_alias")).distinct()
    )
    audit = stage(clean.clean_audit(merge.solar_fill(cropped, solar), cfg), "audit")
    features = stage(feat.engineer_features(clean.cleaned_rows(audit), cfg), "features")

    writers.write_run_manifest(writers.run_manifest(houses, start, end, run_ms, cfg), f"{target}/run_parameters")
    status = pipeline.house_status(houses, cropped, features, cfg, backtest_n)
    writers.write_table(status, f"{target}/house_status")

    params = stage(pipeline.energy_params(features, cfg, n), "energy-params")
    writers.write_table(writers.energy_params_table(params, cfg), f"{target}/energy_params")
    points = regression.predict(features, params, cfg)
    writers.write_table(regression.error_metrics(points, ["house_alias"]), f"{target}/in_sample_metrics")
    writers.write_table(regression.error_histogram(points, ["house_alias"]), f"{target}/error_histogram")
    water = pipeline.rswt_params(features, cfg, n)
    writers.write_table(water.params, f"{target}/rswt_params")
    writers.write_table(rswt.rswt_curve(water.rows, water.bands, cfg), f"{target}/rswt_curve")
    writers.write_table(rswt.chc_water_line(water.water), f"{target}/water_line")
    writers.write_table(clean.cleaning_report(audit), f"{target}/cleaning_report")
    writers.write_table(clean.channel_distribution(cropped, clean.cleaned_rows(audit)), f"{target}/channel_distribution")

    if backtest_n is not None:
        fits = stage(pipeline.backtest_fits(features, backtest_n, cfg), "fits")
        result = pipeline.score(features, fits, cfg)
        writers.write_table(writers.trailing_params_table(fits, cfg), f"{target}/trailing_params")
        writers.write_table(result.points, f"{target}/trailing_points")
        writers.write_table(result.metrics, f"{target}/trailing_metrics")
        writers.write_table(result.by_lead, f"{target}/trailing_rmse_by_lead")
        writers.write_table(result.residuals, f"{target}/trailing_residuals_by_hour")
    if sweep is not None:
        writers.write_table(pipeline.sweep_n(features, *sweep, cfg), f"{target}/sweep_n")
