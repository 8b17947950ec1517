"""Cleaning of hourly rows.

Everything after the first shuffle stays on one hash partitioning by house: windows per
(house, channel), the regrouping per (house, hour) and windows per house are all satisfied
by it. A house has one row per hour, so a window holds as many rows as there are hours in
the period (8,760 per year), whatever the volume of telemetry behind them.

Rules do not delete rows one after the other; ``clean_audit`` keeps each verdict as a
column, so that the cleaned rows and the report come from the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import (
    FILLED_CHANNELS,
    FORECAST_CHANNELS,
    OPTIONAL_CHANNELS,
    VALID_RANGES,
    ZONE_HEATCALL_RANGE,
    ZONE_TEMPERATURE_RANGE,
    HeatConfig,
)
from hearthline.functions import zones as Z
from hearthline.functions.clock import HOUR, hours_between
from hearthline.operators.columns import zone_list

CARRIED = OPTIONAL_CHANNELS + FORECAST_CHANNELS
_ZONE_RANGES = {
    "avg_set": ZONE_TEMPERATURE_RANGE,
    "avg_temp": ZONE_TEMPERATURE_RANGE,
    "heatcall_fraction": ZONE_HEATCALL_RANGE,
}


def _per_house_in_time():
    return Window.partitionBy("house_alias").orderBy("hour_start")


def clamp_small_negative_hp(hourly: DataFrame) -> DataFrame:
    """Slightly negative heat-pump heat is noise around zero."""
    hp = F.col("hp_kwh_th")
    return hourly.withColumn("hp_kwh_th", F.when(hp.between(-1, 0), 0.0).otherwise(hp))


def valid_range_filter(hourly: DataFrame) -> DataFrame:
    """Values outside their inclusive range become null; ``n_out_of_range`` counts them."""

    def outside(value: str, bounds: tuple[float, float]) -> str:
        return f"coalesce(CAST({value} NOT BETWEEN {bounds[0]}D AND {bounds[1]}D AS INT), 0)"

    def kept(value: str, bounds: tuple[float, float]) -> str:
        return f"CASE WHEN {value} BETWEEN {bounds[0]}D AND {bounds[1]}D THEN {value} END"

    house_count = " + ".join(outside(c, b) for c, b in VALID_RANGES.items())
    zone_count = " + ".join(outside(f"z.{f}", b) for f, b in _ZONE_RANGES.items())
    zone_parts = ", ".join(f"{kept(f'z.{f}', b)} AS {f}" for f, b in _ZONE_RANGES.items())
    changed = {c: F.expr(kept(c, b)) for c, b in VALID_RANGES.items()}
    changed["zones"] = F.expr(f"transform(zones, z -> struct(z.zone AS zone, {zone_parts}))")
    changed["n_out_of_range"] = F.expr(
        f"{house_count} + coalesce(aggregate(zones, 0, (n, z) -> n + {zone_count}), 0)"
    )
    return hourly.withColumns(changed)


def rate_of_change_filter(hourly: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Null an outdoor temperature that jumps from the previous present row.

    The previous value is compared as it came, even if it was itself a jump.
    """
    previous = F.lag("oat_f").over(_per_house_in_time())
    jump = F.coalesce(F.abs(F.col("oat_f") - previous) > cfg.max_oat_change_f, F.lit(False))
    return hourly.withColumn("roc_nulled", jump).withColumn(
        "oat_f", F.when(~F.col("roc_nulled"), F.col("oat_f"))
    )


def hour_grid(hourly: DataFrame) -> DataFrame:
    """One row per hour from a house's first to its last; inserted rows are all null.

    Each row is stretched up to the next present hour, so no join is needed. Every row
    lists all zones of its house.
    """
    following = F.lead("hour_start").over(_per_house_in_time())
    stretched = hourly.withColumns({
        "zone_list": zone_list(Window.partitionBy("house_alias")),
        "following": following,
    }).withColumn("grid_hour", F.expr(
        f"explode(sequence(hour_start, coalesce(following - {HOUR}, hour_start), {HOUR}))"
    ))
    present = "grid_hour = hour_start"
    known = f"get(filter(IF({present}, zones, array()), z -> z.zone = k), 0)"
    zones = f"transform(zone_list, k -> struct(k AS zone, {_fields(known)}))"
    values = [c for c in hourly.columns if c not in ("house_alias", "hour_start", "zones")]
    return stretched.selectExpr(
        "house_alias",
        "grid_hour AS hour_start",
        *[f"CASE WHEN {present} THEN {c} END AS {c}" for c in values],
        f"{zones} AS zones",
        f"NOT ({present}) AS inserted",
    )


def _fields(struct: str) -> str:
    return ", ".join(f"{struct}.{f} AS {f}" for f in _ZONE_RANGES)


def to_long(grid: DataFrame) -> DataFrame:
    """One row per (house, hour, channel) for the channels that get filled.

    Columns that are only carried travel in ``carried`` on the first channel's row.
    """
    carried = [c for c in grid.columns if c not in ("house_alias", "hour_start", "zones", *FILLED_CHANNELS)]
    house_level = ", ".join(f"struct('{c}' AS channel, {c} AS value)" for c in FILLED_CHANNELS)
    zone_level = ", ".join(
        f"struct(concat('zone', z.zone, '_{f}') AS channel, z.{f} AS value)" for f in _ZONE_RANGES
    )
    cells = f"concat(array({house_level}), flatten(transform(zones, z -> array({zone_level}))))"
    return grid.selectExpr(
        "house_alias", "hour_start", f"struct({', '.join(carried)}) AS hour_values", f"posexplode({cells}) AS (i, c)"
    ).selectExpr(
        "house_alias", "hour_start", "c.channel", "c.value", "CASE WHEN i = 0 THEN hour_values END AS carried"
    )


def fill_gaps(long: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Per channel: length of each null run (``in_long_gap``) and the linear fill.

    ``lag``/``lead`` that ignore nulls find the neighbours in one sorted pass. Leading
    nulls stay, trailing ones repeat the last value.
    """
    channel = "OVER (PARTITION BY house_alias, channel ORDER BY hour_start)"
    known = "CASE WHEN value IS NOT NULL THEN struct(hour_start AS h, value AS v) END"
    whole = Window.partitionBy("house_alias", "channel")
    neighbours = long.select(
        "*",
        F.expr(f"lag({known}) IGNORE NULLS {channel}").alias("before"),
        F.expr(f"lead({known}) IGNORE NULLS {channel}").alias("after"),
        F.min("hour_start").over(whole).alias("grid_start"),
        F.max("hour_start").over(whole).alias("grid_end"),
    )
    one_hour = F.expr(HOUR)
    run_start = F.coalesce(F.col("before.h"), F.col("grid_start") - one_hour)
    run_end = F.coalesce(F.col("after.h"), F.col("grid_end") + one_hour)
    run_length = hours_between(run_start, run_end) - 1
    position = hours_between(F.col("before.h"), F.col("hour_start")) / hours_between(
        F.col("before.h"), F.col("after.h")
    )
    between = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * position
    missing = F.col("value").isNull()
    return neighbours.select(
        *long.columns,
        (missing & (run_length >= cfg.long_gap_hours)).alias("in_long_gap"),
        F.when(~missing, F.col("value"))
        .when(F.col("after").isNull(), F.col("before.v"))
        .otherwise(between)
        .alias("filled"),
    )


def regroup_hours(filled: DataFrame) -> DataFrame:
    """Channels back to one row per hour.

    An hour in a long gap of any channel keeps its nulls, except the outdoor temperature.
    """
    per_hour = filled.groupBy("house_alias", "hour_start").agg(
        F.max("in_long_gap").alias("gap_hour"),
        F.first("carried", ignorenulls=True).alias("carried"),
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("value", "filled")))).alias("cells"),
    )

    def used(key: str) -> str:
        return f"IF(gap_hour, cells[{key}].value, cells[{key}].filled)"

    house_level = [f"{used(repr(c))} AS {c}" for c in FILLED_CHANNELS if c != "oat_f"]
    zone_cells = ", ".join(f"{used(f'concat(\'zone\', k, \'_{f}\')')} AS {f}" for f in _ZONE_RANGES)
    zone_names = "filter(map_keys(cells), c -> c LIKE 'zone%_avg_set')"
    zone_list = f"array_sort(transform({zone_names}, c -> CAST(regexp_extract(c, '[0-9]+', 0) AS INT)))"
    return per_hour.selectExpr(
        "house_alias",
        "hour_start",
        "carried.*",
        "gap_hour",
        "cells['oat_f'].filled AS oat_f",
        *house_level,
        "cells['oat_f'].value IS NOT NULL AS oat_observed",
        "cells['dist_kwh'].value IS NOT NULL AS load_observed",
        f"transform({zone_list}, k -> struct(k AS zone, {zone_cells})) AS zones",
        "size(map_filter(cells, (c, x) -> x.value IS NULL AND x.filled IS NOT NULL "
        "AND (NOT gap_hour OR c = 'oat_f'))) AS n_filled",
    )


def interpolate_linear(grid: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Long-gap flags and gap filling of a complete hourly grid."""
    return regroup_hours(fill_gaps(to_long(grid), cfg))


def rolling_means(filled: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Means over the previous hours, excluding the current one.

    The temperature mean needs an observed first and last hour, the load mean needs every
    hour observed.
    """
    n = cfg.rolling_hours
    order = _per_house_in_time()
    behind = order.rowsBetween(-n, -1)
    oat_ok = (
        (F.count("oat_f").over(behind) == n)
        & F.coalesce(F.lag("oat_observed", n).over(order), F.lit(False))
        & F.coalesce(F.lag("oat_observed", 1).over(order), F.lit(False))
    )
    load_ok = F.sum(F.col("load_observed").cast("int")).over(behind) == n
    return filled.withColumns({
        "OAT_avg_4h": F.when(oat_ok, F.avg("oat_f").over(behind)),
        "dist_kwh_avg_4h": F.when(load_ok, F.avg("dist_kwh").over(behind)),
    })


def clean_audit(hourly: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Every hour of the grid with cleaned values and the verdict of each rule.

    A rule only looks at rows that earlier rules left; ``dropped_by`` names the first rule
    that removed the row and is null for rows that survive.
    """
    checked = valid_range_filter(clamp_small_negative_hp(hourly))
    grid = hour_grid(rate_of_change_filter(checked, cfg))
    rows = rolling_means(interpolate_linear(grid, cfg), cfg)

    house_nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in FILLED_CHANNELS)
    zone_nulls = " + ".join(f"CAST(z.{f} IS NULL AS INT)" for f in _ZONE_RANGES)
    rows = rows.withColumns({
        "n_missing": F.expr(f"{house_nulls} + aggregate(zones, 0, (n, z) -> n + {zone_nulls})"),
        "external_heat": F.coalesce(Z.external_heat(cfg), F.lit(False)),
    })
    before_rules = (
        F.when(F.col("OAT_avg_4h").isNull() | F.col("dist_kwh_avg_4h").isNull(), "no_rolling_mean")
        .when(F.col("gap_hour"), "long_gap")
        .when(F.col("n_missing") > 0, "missing_values")
        .when(F.col("oil_boiler_pwr") > cfg.oil_boiler_watts, "oil_boiler")
        .when(Z.below_setpoint(cfg), "below_setpoint")
    )
    rows = rows.withColumn("early_verdict", before_rules)
    # the setpoint is compared with the previous row that got this far
    previous = F.expr(
        "lag(CASE WHEN early_verdict IS NULL THEN struct(hour_start AS h, zones AS z) END) "
        "IGNORE NULLS OVER (PARTITION BY house_alias ORDER BY hour_start)"
    )
    rows = rows.withColumn("previous", previous)
    stepped = (F.col("previous.h") == F.col("hour_start") - F.expr(HOUR)) & Z.setpoint_differs("previous.z")
    late = F.when(F.coalesce(stepped, F.lit(False)), "setpoint_change").when(
        Z.broken_thermostat(cfg), "broken_thermostat"
    )
    if cfg.drop_external_heat:
        late = late.when(F.col("external_heat"), "external_heat")
    return rows.withColumn("dropped_by", F.coalesce(F.col("early_verdict"), late)).drop(
        "early_verdict", "previous"
    )


CLEANED_COLUMNS = (
    "house_alias", "hour_start", *FILLED_CHANNELS, *CARRIED, "OAT_avg_4h", "dist_kwh_avg_4h", "zones",
)


def cleaned_rows(audit: DataFrame) -> DataFrame:
    """Rows that no rule removed."""
    return audit.where(F.col("dropped_by").isNull()).select(*CLEANED_COLUMNS)


def cleaning_report(audit: DataFrame) -> DataFrame:
    """Counts per house for every cleaning step."""

    def dropped(rule: str) -> Column:
        return F.count(F.when(F.col("dropped_by") == rule, 1)).alias(f"dropped_{rule}")

    got_past_gaps = F.coalesce(~F.col("dropped_by").isin("no_rolling_mean", "long_gap"), F.lit(True))
    return audit.groupBy("house_alias").agg(
        F.count("*").alias("grid_hours"),
        F.sum(F.coalesce("n_out_of_range", F.lit(0))).alias("nulled_range"),
        F.count(F.when(F.col("roc_nulled"), 1)).alias("nulled_rate_of_change"),
        F.count(F.when(F.col("inserted"), 1)).alias("inserted_hours"),
        F.sum("n_filled").alias("filled_values"),
        F.count(F.when(F.col("gap_hour"), 1)).alias("long_gap_hours"),
        F.sum(F.when(got_past_gaps, F.col("n_missing")).otherwise(0)).alias("remaining_nulls"),
        *[dropped(r) for r in (
            "no_rolling_mean", "long_gap", "missing_values", "oil_boiler", "below_setpoint",
            "setpoint_change", "broken_thermostat", "external_heat")],
        F.count(F.when(F.col("external_heat") & F.col("dropped_by").isNull(), 1)).alias("flagged_external_heat"),
        F.count(F.when(F.col("dropped_by").isNull(), 1)).alias("kept_hours"),
    )


def channel_distribution(before: DataFrame, after: DataFrame) -> DataFrame:
    """Null counts and box-plot summaries per channel before and after cleaning.

    Zone heat-call channels are left out. Quartiles are exact; their state holds one
    counter per distinct value of a channel, at most one per hour.
    """

    def long(df: DataFrame, label: str) -> DataFrame:
        house_level = F.array(*[
            F.struct(F.lit(0).alias("zone"), F.lit(c).alias("channel"), F.col(c).alias("value"))
            for c in FILLED_CHANNELS if c != "oil_boiler_pwr"
        ])
        zone_level = F.flatten(F.transform(
            F.coalesce("zones", F.array()),
            lambda z: F.array(*[
                F.struct(
                    z["zone"].alias("zone"),
                    F.concat(F.lit("zone"), z["zone"].cast("string"), F.lit(f"_{f}")).alias("channel"),
                    z[f].alias("value"),
                )
                for f in ("avg_set", "avg_temp")
            ]),
        ))
        return df.select(
            "house_alias", F.lit(label).alias("stage"), F.explode(F.concat(house_level, zone_level)).alias("c")
        ).select("house_alias", "stage", "c.zone", "c.channel", "c.value")

    rows = long(before, "before").unionByName(long(after, "after"))
    keys = ["house_alias", "stage", "zone", "channel"]
    box = Window.partitionBy(*keys)
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(box)
    fenced = rows.withColumn("q", quartiles).selectExpr(
        *rows.columns, "q[0] AS q1", "q[1] AS median", "q[2] AS q3"
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach), F.col("value"))
    summary = fenced.groupBy(*keys).agg(
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
        F.count("value").alias("n_values"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.least(F.min(inside), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(inside), F.max("q3")).alias("whisker_high"),
        (F.count("value") - F.count(inside)).alias("n_outliers"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    # zones share one axis after cleaning
    zone_box = Window.partitionBy("house_alias", "stage", "zone")
    low, high = F.min("min_value").over(zone_box), F.max("max_value").over(zone_box)
    pad = F.greatest((high - low) * 0.05, F.lit(0.25))
    shared = (F.col("zone") > 0) & (F.col("stage") == "after")
    return summary.select(
        "house_alias", "stage", "channel", "n_null", "n_values", "q1", "median", "q3",
        "whisker_low", "whisker_high", "n_outliers",
        F.when(shared, low - pad).alias("axis_low"),
        F.when(shared, high + pad).alias("axis_high"),
    )
