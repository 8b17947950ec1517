"""Least squares for many houses and windows at once.

The rows of a day are reduced to sums of products (moments). Any training window is then
a sum of daily moments, so refits never go back to the rows; only the solve of a matrix as
small as the number of coefficients happens in numpy, on Arrow batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import BASELINE_FEATURES, HeatConfig
from hearthline.functions.numbers import null_if_nan, settle
from hearthline.session import stage

# features measured in load units follow the energy ratio, as the target does
_SCALED = {
    "previous_dist_kwh_scaled": "previous_dist_kwh",
    "dist_kwh_scaled_avg_4h": "dist_kwh_avg_4h",
}
TARGET = "dist_kwh"
_FIT = "struct<values:array<double>,std_errors:array<double>,r_squared:double,well_posed:boolean>"


def raw_columns(names: tuple[str, ...]) -> list[str]:
    return [_SCALED.get(name, name) for name in names]


def _terms(names: tuple[str, ...]) -> list[str]:
    return ["one", *raw_columns(names), TARGET]


def _pairs(names: tuple[str, ...]) -> list[tuple[str, str]]:
    terms = _terms(names)
    return [(a, b) for i, a in enumerate(terms) for b in terms[i:]]


def _moment(a: str, b: str) -> str:
    return f"sum__{a}__{b}"


def moment_columns(cfg: HeatConfig) -> list[str]:
    pairs = dict.fromkeys(_pairs(cfg.feature_names) + _pairs(BASELINE_FEATURES))
    return [_moment(a, b) for a, b in pairs] + ["sum__hp"]


def _moment_aggregates(cfg: HeatConfig) -> list[Column]:
    pairs = dict.fromkeys(_pairs(cfg.feature_names) + _pairs(BASELINE_FEATURES))
    value = lambda name: F.lit(1.0) if name == "one" else F.col(name)
    sums = [F.sum(value(a) * value(b)).alias(_moment(a, b)) for a, b in pairs]
    return sums + [F.sum("hp_kwh_th").alias("sum__hp")]


def ols_moments(features: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Sums of products per house and day; partial sums are taken before the shuffle."""
    return features.groupBy("house_alias", "day").agg(*_moment_aggregates(cfg))


def last_n_days(days: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` days with data of each house, all of them when ``n`` is omitted."""
    if n is None:
        return days
    recent_first = Window.partitionBy("house_alias").orderBy(F.col("day").desc())
    return days.withColumn("rank", F.dense_rank().over(recent_first)).where(F.col("rank") <= n).drop("rank")


def window_moments(moments: DataFrame, n: int | None, cfg: HeatConfig) -> DataFrame:
    """Moments of each house's latest training window."""
    return last_n_days(moments, n).groupBy("house_alias").agg(
        (F.count("*") if n is None else F.lit(n).cast("bigint")).alias("n_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("fit_day"),
        *[F.sum(c).alias(c) for c in moment_columns(cfg)],
    )


def _solve_batch(upper: np.ndarray, ratio: np.ndarray, scaled: np.ndarray, floor: float):
    """Solve many small systems given the upper triangles of their moment matrices."""
    size = len(scaled)
    rows, cols = np.triu_indices(size)
    moments = np.zeros((len(upper), size, size))
    moments[:, rows, cols] = upper
    moments[:, cols, rows] = upper
    unit = np.where(scaled[None, :], ratio[:, None], 1.0)
    moments *= unit[:, :, None] * unit[:, None, :]

    count = moments[:, 0, 0]
    means = moments[:, 0, 1:] / count[:, None]
    centred = moments[:, 1:, 1:] - means[:, :, None] * means[:, None, :] * count[:, None, None]
    xx, xy, yy = centred[:, :-1, :-1], centred[:, :-1, -1], centred[:, -1, -1]
    spread = np.einsum("bii->bi", xx)
    size_sq = np.einsum("bii->bi", moments)[:, 1:-1]
    used = size_sq > 0
    constant = used & (spread <= 1e-12 * size_sq)
    sd = np.sqrt(np.where(used & ~constant, spread, 1.0))
    correlation = xx / (sd[:, :, None] * sd[:, None, :])
    live = used & ~constant
    correlation = np.where(live[:, :, None] & live[:, None, :], correlation, 0.0)
    correlation += np.where(live, 0.0, 1.0)[:, :, None] * np.eye(size - 2)

    finite = np.isfinite(correlation).all(axis=(1, 2)) & np.isfinite(xy).all(axis=1)
    correlation[~finite] = np.eye(size - 2)
    lowest = np.linalg.eigvalsh(correlation)[:, 0]
    solvable = finite & (lowest > floor)
    correlation[~solvable] = np.eye(size - 2)
    inverse = np.linalg.inv(correlation)
    slopes = np.einsum("bij,bj->bi", inverse, np.where(live, xy / sd, 0.0)) / sd
    slopes = np.where(live, slopes, 0.0)
    intercept = means[:, -1] - (slopes * means[:, :-1]).sum(axis=1)
    residual = yy - (slopes * np.where(live, xy, 0.0)).sum(axis=1)

    rank = 1 + live.sum(axis=1)
    # too near a perfect or constant fit for differences of moments: leave it to the rows
    measurable = residual > 1e-9 * np.maximum(yy, 1e-300)
    well_posed = solvable & ~constant.any(axis=1) & measurable & (count > rank)
    variance = residual / np.maximum(count - rank, 1)
    reach = np.where(live, means[:, :-1] / sd, 0.0)
    slope_var = np.einsum("bii->bi", inverse) / sd**2
    intercept_var = 1 / count + np.einsum("bi,bij,bj->b", reach, inverse, reach)
    errors = np.sqrt(variance[:, None] * np.column_stack([intercept_var, slope_var]))
    errors[rank < size - 1] = np.nan
    return np.column_stack([intercept, slopes]), errors, 1 - residual / yy, well_posed


def _solver(names: tuple[str, ...], cfg: HeatConfig):
    scaled = np.array([False, *[n in _SCALED for n in names], True])
    floor = cfg.min_eigenvalue

    @F.pandas_udf(_FIT)
    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for upper, ratio in batches:
            with np.errstate(all="ignore"):
                values, errors, r2, good = _solve_batch(
                    np.array(upper.tolist(), dtype=float), ratio.to_numpy(dtype=float), scaled, floor
                )
            yield pd.DataFrame({
                "values": list(values), "std_errors": list(errors), "r_squared": r2, "well_posed": good,
            })

    return solve


def _row_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares on the rows themselves, all of it from one singular value decomposition.

    Directions that carry nothing are left out: that gives the coefficients of least norm. With
    any left out there are no standard errors.
    """
    left, sizes, right = np.linalg.svd(x, full_matrices=False)
    carried = sizes > sizes.max(initial=0.0) * max(x.shape) * np.finfo(float).eps
    scaled = right[carried].T / sizes[carried]
    projected = left[:, carried].T @ y
    values = scaled @ projected
    spread = y - y.mean()
    total, missed = spread @ spread, y - x @ values
    unexplained = float(missed @ missed)
    freedom = max(len(y) - int(carried.sum()), 1)
    full = carried.sum() == x.shape[1]
    errors = np.sqrt((scaled**2).sum(axis=1) * unexplained / freedom) if full else np.full(x.shape[1], np.nan)
    return values, errors, float(1 - unexplained / total) if total else float(unexplained == 0)


def _refit_on_rows(
    windows: DataFrame, features: DataFrame, keys: list[str], cfg: HeatConfig
) -> DataFrame:
    """Exact fit of windows whose moments cannot settle it, both models at once.

    Rows are joined to their windows by house and day; one group holds one training window
    of one house, at most 24 rows per day.
    """
    models = {"fit": cfg.feature_names, "baseline_fit": BASELINE_FEATURES}
    raw = list(dict.fromkeys(c for names in models.values() for c in raw_columns(names)))
    spans = windows.select(*keys, "energy_ratio", "first_day", F.col("fit_day").alias("last_day"))
    days = spans.withColumn("day", F.explode(F.sequence("first_day", "last_day"))).drop("first_day", "last_day")
    rows = days.join(features.select("house_alias", "day", TARGET, *raw), ["house_alias", "day"])
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*keys).schema]
    out_types = [
        f"{m}_{part}" for m in models
        for part in ("values array<double>", "errors array<double>", "r2 double")
    ]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]][keys].reset_index(drop=True)
        ratio = float(pdf["energy_ratio"].iloc[0])
        for model, names in models.items():
            values = errors = np.full(len(names) + 1, np.nan)
            r2 = np.nan
            scale = np.array([ratio if n in _SCALED else 1.0 for n in names])
            x = pdf[raw_columns(names)].to_numpy(dtype=float) * scale
            # without a load or a needed measurement there is nothing to fit
            if np.isfinite(ratio) and np.isfinite(x).all():
                x = np.column_stack([np.ones(len(x)), x])
                values, errors, r2 = _row_fit(x, pdf[TARGET].to_numpy(dtype=float) * ratio)
            out[f"{model}_values"], out[f"{model}_errors"] = [list(values)], [list(errors)]
            out[f"{model}_r2"] = r2
        return out

    fitted = rows.groupBy(*keys).applyInPandas(fit, ", ".join(key_types + out_types))
    return fitted.select(*keys, *[
        F.struct(
            F.col(f"{m}_values").alias("values"),
            F.col(f"{m}_errors").alias("std_errors"),
            F.col(f"{m}_r2").alias("r_squared"),
            F.lit(True).alias("well_posed"),
        ).alias(f"{m}_again")
        for m in models
    ])


def _rounded(values: Column) -> Column:
    return F.transform(values, lambda v: null_if_nan(settle(v, 6)))


def solve_windows(
    windows: DataFrame, features: DataFrame | None, keys: list[str], cfg: HeatConfig
) -> DataFrame:
    """Fit the main and the baseline model of every window.

    ``windows`` has one row per ``keys`` with summed moments, ``first_day`` and ``fit_day``.
    Windows that are singular or nearly so are fitted again on their rows when ``features``
    is given; the solved windows are then staged, so that this branch is planned only if there
    are any. Coefficients and errors are rounded to six decimals, R squared and energy ratio
    to three; predictions use the rounded numbers.
    """
    total_load = F.col(_moment("one", TARGET))
    ratio = F.when(total_load != 0, F.col("sum__hp") / total_load)
    models = {"fit": cfg.feature_names, "baseline_fit": BASELINE_FEATURES}
    fitted = windows.withColumn("energy_ratio", ratio)
    for out, names in models.items():
        upper = F.array(*[_moment(a, b) for a, b in _pairs(names)])
        fitted = fitted.withColumn(out, _solver(names, cfg)(upper, F.col("energy_ratio")))
    fitted = fitted.select(
        *[c for c in windows.columns if not c.startswith("sum__")],
        F.col(_moment("one", "one")).cast("bigint").alias("n_hours"),
        "energy_ratio", "fit", "baseline_fit",
    )
    if features is not None:
        fitted = stage(fitted, "solved")  # a row per window, read by two consumers
        unsettled = fitted.where(~(F.col("fit.well_posed") & F.col("baseline_fit.well_posed")))
        if not unsettled.isEmpty():
            again = _refit_on_rows(unsettled, features, keys, cfg)
            pick = lambda m: F.when(F.col(f"{m}.well_posed"), F.col(m)).otherwise(
                F.coalesce(f"{m}_again", m)
            )
            fitted = fitted.join(again, keys, "left").withColumns({m: pick(m) for m in models})
            fitted = fitted.drop("fit_again", "baseline_fit_again")
    return fitted.select(
        *[c for c in fitted.columns if c not in ("fit", "baseline_fit", "energy_ratio")],
        settle(F.col("energy_ratio"), 3).alias("energy_ratio"),
        _rounded(F.col("fit.values")).alias("coefficients"),
        _rounded(F.col("fit.std_errors")).alias("std_errors"),
        null_if_nan(settle(F.col("fit.r_squared"), 3)).alias("r_squared"),
        F.col("fit.well_posed").alias("well_posed"),
        _rounded(F.col("baseline_fit.values")).alias("baseline_coefficients"),
        _rounded(F.col("baseline_fit.std_errors")).alias("baseline_std_errors"),
        null_if_nan(settle(F.col("baseline_fit.r_squared"), 3)).alias("baseline_r_squared"),
    )


def fit_energy_params(features: DataFrame, n: int | None, cfg: HeatConfig) -> DataFrame:
    """Both models of every house on its last ``n`` days (all days when omitted)."""
    windows = window_moments(ols_moments(features, cfg), n, cfg)
    return solve_windows(windows, features, ["house_alias"], cfg)


def usable_fits(fits: DataFrame) -> DataFrame:
    """Fits that can predict: those with an energy ratio and every coefficient."""
    known = [F.forall(c, lambda v: v.isNotNull()) for c in ("coefficients", "baseline_coefficients")]
    return fits.where(F.col("energy_ratio").isNotNull() & known[0] & known[1])


def linear(coefficients: Column, terms: list[Column]) -> Column:
    total = F.get(coefficients, F.lit(0))
    for i, term in enumerate(terms, start=1):
        total = total + F.get(coefficients, F.lit(i)) * term
    return total


def _term(name: str) -> Column:
    return F.col(_SCALED[name]) * F.col("energy_ratio") if name in _SCALED else F.col(name)


def predict(features: DataFrame, params: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Scaled load by both models next to the scaled actual load, never below zero."""
    fits = usable_fits(params).select(
        "house_alias", "energy_ratio", "coefficients", "baseline_coefficients", "first_day"
    )
    zero = F.lit(0.0)
    return (
        features.join(fits, "house_alias")
        .where(F.col("day") >= F.col("first_day"))
        .withColumns({
            "predicted": F.greatest(zero, linear(F.col("coefficients"), [_term(n) for n in cfg.feature_names])),
            "predicted_baseline": F.greatest(
                zero, linear(F.col("baseline_coefficients"), [F.col(n) for n in BASELINE_FEATURES])
            ),
            "actual": F.col("dist_kwh") * F.col("energy_ratio"),
        })
        .drop("coefficients", "baseline_coefficients", "first_day")
    )


def error_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """MAE and RMSE of model and baseline, and how much better the model is, in percent."""
    error = F.col("predicted") - F.col("actual")
    base = F.col("predicted_baseline") - F.col("actual")
    out = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(base)).alias("mae_baseline"),
        F.sqrt(F.avg(base * base)).alias("rmse_baseline"),
    )
    return with_gains(out)


def with_gains(errors: DataFrame) -> DataFrame:
    """How much better the model is than the baseline, in percent of the baseline's error."""
    gain = lambda m: F.when(
        F.col(f"{m}_baseline") != 0, (F.col(f"{m}_baseline") - F.col(m)) / F.col(f"{m}_baseline") * 100
    )
    return errors.withColumns({"mae_gain_pct": gain("mae"), "rmse_gain_pct": gain("rmse")})


def in_sample_metrics(features: DataFrame, params: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Fit quality on the training rows themselves."""
    return error_metrics(predict(features, params, cfg), ["house_alias"])


def error_histogram(points: DataFrame, keys: list[str], bins: int = 60, reach: float = 6.0) -> DataFrame:
    """Counts of model and baseline errors in equal bins on ``[-reach, reach]``.

    Errors outside are left out; an error equal to the upper edge belongs to the last bin.
    """
    errors = F.array(
        F.struct(F.lit("model").alias("model"), (F.col("predicted") - F.col("actual")).alias("e")),
        F.struct(F.lit("baseline").alias("model"), (F.col("predicted_baseline") - F.col("actual")).alias("e")),
    )
    rows = points.select(*keys, F.explode(errors).alias("x")).select(*keys, "x.model", "x.e")
    bucket = F.width_bucket(F.col("e"), F.lit(-reach), F.lit(reach), F.lit(bins))
    return (
        rows.where(F.col("e").between(-reach, reach))
        .withColumn("bin", F.least(bucket, F.lit(bins)).cast("int"))
        .groupBy(*keys, "model", "bin")
        .agg(F.count("*").alias("n"))
    )
