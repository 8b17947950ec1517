"""Refits through history and recursive forecasts from every hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import MODEL_FEATURES, HeatConfig
from hearthline.functions.clock import is_weekend
from hearthline.operators.features import delta_t, occupancy_index
from hearthline.operators.regression import moment_columns, usable_fits, with_gains


def refit_schedule(days: DataFrame, lookbacks: Column, cfg: HeatConfig) -> DataFrame:
    """Days on which each look-back ``n`` is refitted.

    The first fit needs ``n`` days with data (the configured minimum when the window may
    grow). Weekly training then takes the next day at least seven calendar days after the
    previous fit: a fold over the sorted days of a house, a list as long as its calendar.
    """
    per_house = days.groupBy("house_alias").agg(F.array_sort(F.collect_set("day")).alias("days"))
    first = F.lit(max(cfg.min_fit_days - 1, 0)) if cfg.grow_window else F.col("n") - 1
    candidates = F.slice("days", first + 1, F.greatest(F.size("days") - first, F.lit(0)))
    if cfg.training_frequency == "daily":
        fit_days = candidates
    else:
        nothing = F.lit(None).cast("array<date>")
        fit_days = F.aggregate(
            candidates,
            F.coalesce(nothing, F.array().cast("array<date>")),
            lambda picked, day: F.when(
                (F.size(picked) == 0) | (F.date_diff(day, F.element_at(picked, -1)) >= 7),
                F.concat(picked, F.array(day)),
            ).otherwise(picked),
        )
    return (
        per_house.withColumn("n", lookbacks)
        .where(F.size("days") > first)
        .select("house_alias", "n", F.explode(fit_days).alias("fit_day"))
    )


def trailing_days_window(moments: DataFrame, n: int, cfg: HeatConfig) -> DataFrame:
    """Moments of the last ``n`` days with data up to each day (fewer at the start)."""
    frame = Window.partitionBy("house_alias").orderBy("day").rowsBetween(-(n - 1), Window.currentRow)
    return moments.select(
        "house_alias",
        F.lit(n).alias("n"),
        F.col("day").alias("fit_day"),
        F.min("day").over(frame).alias("first_day"),
        *[F.sum(c).over(frame).alias(c) for c in moment_columns(cfg)],
    )


EXACT = "decimal(38,16)"


def prefix_moments(moments: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Running sums of a house's daily moments: one row per day with data, whatever the look-backs.

    The sums are decimals, so a difference of two of them has lost nothing, however long the
    history is. ``index`` counts the days from 1, ``following`` is the day after in that count,
    ``unknown`` counts moments that no such decimal holds.
    """
    in_time = Window.partitionBy("house_alias").orderBy("day")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = moment_columns(cfg)
    exact = {c: F.col(c).try_cast(EXACT) for c in names}
    unknown = sum((F.col(c).isNotNull() & exact[c].isNull()).cast("int") for c in names)
    return moments.select(
        "house_alias", "day", unknown.alias("unknown"), *[e.alias(c) for c, e in exact.items()]
    ).select(
        "house_alias", "day",
        F.row_number().over(in_time).alias("index"),
        F.min("day").over(so_far).alias("first"),
        F.lead("day").over(in_time).alias("following"),
        F.sum("unknown").over(so_far).alias("unknown"),
        *[F.sum(c).over(so_far).alias(c) for c in names],
    )


def windows_of(schedule: DataFrame, prefix: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Moments of the window of every scheduled fit: the running sum of its last day less that before its first.

    A window with fewer than ``n`` days before it (while it grows) begins with the first day. Where
    a moment is unknown all of them are null, which leaves the window to its rows.
    """
    names = moment_columns(cfg)
    upto = prefix.withColumnRenamed("day", "fit_day").drop("following")
    before = prefix.select(
        "house_alias", F.col("index").alias("start"), "following", F.col("unknown").alias("unknown_before"),
        *[F.col(c).alias(f"before__{c}") for c in names])
    ends = schedule.join(upto, ["house_alias", "fit_day"]).withColumn("start", F.greatest(F.col("index") - F.col("n"), F.lit(0)))
    met = ends.join(before, ["house_alias", "start"], "left")
    known = F.col("unknown") == F.coalesce("unknown_before", F.lit(0))
    return met.select(
        "house_alias", "n", "fit_day",
        F.coalesce("following", "first").alias("first_day"),
        *[F.when(known, F.col(c) - F.coalesce(f"before__{c}", F.lit(0).cast(EXACT))).cast("double").alias(c) for c in names],
    )


def fit_intervals(fits: DataFrame) -> DataFrame:
    """Give each fit the days it serves: after its own day, up to the next fit's day."""
    in_time = Window.partitionBy("house_alias", "n").orderBy("fit_day")
    return fits.withColumn("next_fit_day", F.lead("fit_day").over(in_time))


def asof_fit(origins: DataFrame, fits: DataFrame) -> DataFrame:
    """Each origin with the latest fit before its day, once per look-back.

    Every fit is spread over the days it serves, the last one up to the house's last origin,
    and joined on house and day: a pair that is made is a pair that is kept. Both sides are dealt
    to a given number of tasks. Origins carry their targets and must not be broadcast, and fits are
    few bytes, but much work, which adaptive execution would put into few tasks.
    """
    # a fit that failed still ends the service of the one before it
    params = usable_fits(fit_intervals(fits)).select(
        "house_alias", "n", "fit_day", "next_fit_day", "energy_ratio", "coefficients", "baseline_coefficients"
    )
    last = origins.groupBy("house_alias").agg(F.max("day").alias("last_day"))
    until = F.least(F.coalesce("next_fit_day", "last_day"), F.col("last_day"))
    served = params.join(last, "house_alias").where(F.col("fit_day") < until).withColumn(
        "day", F.explode(F.sequence(F.date_add("fit_day", 1), until))
    )
    tasks = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = served.drop("next_fit_day", "last_day").repartition(tasks, "house_alias", "day")
    return origins.hint("merge").join(dealt, ["house_alias", "day"])


def origin_lead_join(features: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Each origin with the surviving rows it forecasts, as an array by step.

    Steps count surviving rows, not clock hours. An origin needs a full horizon, and the
    last such row is not scored.
    """
    in_time = Window.partitionBy("house_alias").orderBy("hour_start")
    ahead = in_time.rowsBetween(Window.currentRow, cfg.horizon_hours - 1)
    occupancy = occupancy_index(F.col("hour_start")) if cfg.include_occupancy else F.lit(None).cast("int")
    target = F.struct(
        F.col("hour_start"), F.col("oat_f"), F.col("temp_avg"), F.col("deltaT"),
        F.col("windspeed_times_deltaT"), F.col("windspeed_times_65_minus_oat"), F.col("solar_w_m2"),
        F.col("OAT_avg_4h"), F.col("dist_kwh_avg_4h"), F.col("dist_kwh"), occupancy.alias("occupancy"),
    )
    return (
        features.select(
            "house_alias",
            F.col("hour_start").alias("origin"),
            "day",
            "previous_dist_kwh",
            "oat_f_forecast",
            "ws_mph_forecast",
            F.row_number().over(in_time).alias("position"),
            F.count("*").over(Window.partitionBy("house_alias")).alias("n_rows"),
            F.collect_list(target).over(ahead).alias("targets"),
        )
        .where(F.col("position") <= F.col("n_rows") - cfg.horizon_hours)
        .drop("position", "n_rows")
    )


def _weather(target: Column, step: Column, cfg: HeatConfig) -> tuple[Column, Column, Column, Column]:
    """Outdoor temperature and wind terms of a step: forecast where both parts exist."""
    seen = (target["oat_f"], target["deltaT"], target["windspeed_times_deltaT"],
            target["windspeed_times_65_minus_oat"])
    if not cfg.use_forecasts:
        return seen
    oat, wind = F.get("oat_f_forecast", step), F.get("ws_mph_forecast", step)
    known = oat.isNotNull() & wind.isNotNull()
    gap = delta_t(target["temp_avg"], oat)
    forecast = (oat, gap, gap * wind, wind * (F.lit(65.0) - oat))
    return tuple(F.when(known, f).otherwise(s) for f, s in zip(forecast, seen))


def baseline_forecast(origins: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Weather-only forecast for every step; no step depends on another."""
    b = lambda i: F.get("baseline_coefficients", F.lit(i))

    def step(target: Column, i: Column) -> Column:
        oat, _, _, wind = _weather(target, i, cfg)
        return F.greatest(F.lit(0.0), b(0) + b(1) * oat + b(2) * wind)

    return origins.withColumn("forecast_baseline", F.transform("targets", step))


def recursive_forecast(origins: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Main model, step by step: each step's lagged load is the previous prediction.

    The part of a step that does not depend on the lag is computed first; the recursion is
    then a fold of ``max(0, known + b_lag * previous)`` over the array.
    """
    b = lambda i: F.get("coefficients", F.lit(i))
    lag = 1 + MODEL_FEATURES.index("previous_dist_kwh_scaled")

    def known_part(target: Column, i: Column) -> Column:
        _, gap, wind_gap, _ = _weather(target, i, cfg)
        total = (
            b(0) + b(1) * gap + b(2) * wind_gap + b(3) * target["solar_w_m2"]
            + b(5) * target["OAT_avg_4h"]
            + b(6) * target["dist_kwh_avg_4h"] * F.col("energy_ratio")
        )
        if cfg.include_occupancy:
            total = total + F.coalesce(F.get("coefficients", target["occupancy"] + 1), F.lit(0.0))
        return total

    start = F.struct(
        (F.col("previous_dist_kwh") * F.col("energy_ratio")).alias("last"),
        F.array().cast("array<double>").alias("path"),
    )

    def advance(state: Column, known: Column) -> Column:
        value = F.greatest(F.lit(0.0), known + b(lag) * state["last"])
        return F.struct(value.alias("last"), F.concat(state["path"], F.array(value)).alias("path"))

    path = F.aggregate(F.transform("targets", known_part), start, advance, lambda state: state["path"])
    return origins.withColumn("forecast", path)


def forecasts(origins: DataFrame, fits: DataFrame, cfg: HeatConfig) -> DataFrame:
    """One row per look-back and origin: its targets, both forecasts and their errors, as arrays by step."""
    out = baseline_forecast(recursive_forecast(asof_fit(origins, fits), cfg), cfg)

    def error(forecast: str) -> Column:
        return F.zip_with(forecast, "targets", lambda f, t: f - t["dist_kwh"] * F.col("energy_ratio"))

    kept = ["house_alias", "n", "origin", "energy_ratio", "targets", "forecast", "forecast_baseline"]
    return out.select(*kept, error("forecast").alias("error"), error("forecast_baseline").alias("error_baseline"))


def forecast_points(forecasts: DataFrame) -> DataFrame:
    """One row per look-back, origin and lead with both predictions and the actual load."""
    step = F.posexplode(F.arrays_zip("targets", "forecast", "forecast_baseline")).alias("step", "at")
    return forecasts.select("house_alias", "n", "origin", "energy_ratio", step).select(
        "house_alias",
        "n",
        "origin",
        (F.col("step") + 1).alias("lead"),
        F.col("at.targets.hour_start").alias("hour_start"),
        F.col("at.targets.oat_f").alias("oat_f"),
        F.col("at.forecast").alias("predicted"),
        F.col("at.forecast_baseline").alias("predicted_baseline"),
        (F.col("at.targets.dist_kwh") * F.col("energy_ratio")).alias("actual"),
    )


def oos_metrics(forecasts: DataFrame) -> DataFrame:
    """Overall errors of the backtest per house and look-back; a row per origin reaches the aggregate."""
    def totals(errors: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("off"), F.lit(0.0).alias("square"))
        return F.aggregate(errors, start, lambda t, e: F.struct(
            (t["n"] + e.isNotNull().cast("long")).alias("n"),
            (t["off"] + F.coalesce(F.abs(e), F.lit(0.0))).alias("off"),
            (t["square"] + F.coalesce(e * e, F.lit(0.0))).alias("square"),
        ))

    rows = forecasts.select(
        "house_alias", "n", F.size("error").cast("long").alias("points"), totals("error").alias("m"), totals("error_baseline").alias("b"))
    sums = rows.groupBy("house_alias", "n").agg(
        F.sum("points").alias("n_points"),
        *[F.sum(f"{x}.{f}").alias(f"{x}_{f}") for x in ("m", "b") for f in ("n", "off", "square")],
    )
    mean = lambda x, f: F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_{f}") / F.col(f"{x}_n"))
    return with_gains(sums.select(
        "house_alias", "n", "n_points", mean("m", "off").alias("mae"), F.sqrt(mean("m", "square")).alias("rmse"),
        mean("b", "off").alias("mae_baseline"), F.sqrt(mean("b", "square")).alias("rmse_baseline"),
    ))


def rmse_by_lead(forecasts: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Errors by lead: arrays are averaged entry by entry, and spread over leads when only the means are left."""
    def mean_square(errors: str, step: int) -> Column:
        e = F.get(errors, F.lit(step))
        return F.avg(e * e)

    steps = range(cfg.horizon_hours)
    means = forecasts.groupBy("house_alias", "n").agg(
        F.count(F.lit(1)).alias("n_points"),
        *[mean_square(c, i).alias(f"{c}_{i}") for c in ("error", "error_baseline") for i in steps],
    )
    leads = F.array(*[
        F.struct(F.lit(i + 1).alias("lead"), F.sqrt(f"error_{i}").alias("rmse"), F.sqrt(f"error_baseline_{i}").alias("rmse_baseline"))
        for i in steps
    ])
    spread = means.select("house_alias", "n", "n_points", F.explode(leads).alias("at"))
    return spread.select("house_alias", "n", "at.lead", "n_points", "at.rmse", "at.rmse_baseline")


def hourly_residual_ci(forecasts: DataFrame) -> DataFrame:
    """Mean first-step error by hour of day, weekdays and weekends apart, with 95 % bounds.

    All 24 hours appear for both kinds of day; an hour never scored has no mean and a zero
    bound, as has an hour scored once.
    """
    first = forecasts.select(
        "house_alias", "n", F.get("targets", F.lit(0))["hour_start"].alias("hour_start"), F.get("error", F.lit(0)).alias("residual"))
    scored = first.groupBy(
        "house_alias", "n", is_weekend(F.col("hour_start")).alias("weekend"), F.hour("hour_start").alias("hour")
    ).agg(
        F.count("*").alias("n_points"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("sd"),
    )
    per_house = scored.groupBy("house_alias", "n").agg(
        F.map_from_entries(
            F.collect_list(F.struct(
                F.struct("weekend", "hour"), F.struct("n_points", "mean_residual", "sd")
            ))
        ).alias("cells")
    )
    slots = F.flatten(F.transform(
        F.array(F.lit(False), F.lit(True)),
        lambda w: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(w.alias("weekend"), h.alias("hour"))),
    ))
    cell = F.col("cells")[F.col("slot")]
    count = F.coalesce(cell["n_points"], F.lit(0).cast("bigint"))
    bound = F.when(count >= 2, F.lit(1.96) * cell["sd"] / F.sqrt(count)).otherwise(0.0)
    return per_house.withColumn("slot", F.explode(slots)).select(
        "house_alias", "n", "slot.weekend", "slot.hour",
        count.alias("n_points"),
        cell["mean_residual"].alias("mean_residual"),
        bound.alias("ci95"),
    )
