"""Every operator as a Spark query over the given tables, next to its SQL check."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.config import FILLED_CHANNELS, HeatConfig
from hearthline.functions import zones as Z
from hearthline.functions.clock import local_hour
from hearthline.functions.numbers import decode_units, settle, thermal_power_kw
from hearthline.operators import backtest as B
from hearthline.operators import clean, columns, features as feat, forecast, merge, regression as R
from hearthline.operators import rswt, sensors, sweep, telemetry
from hearthline.plans import pipeline as P
from hearthline.plans import refresh
from hearthline.session import configure, scratch_path, stage, use_folder
from hearthline.sources import adapters, readers, writers
from hearthline.sources.store import Telemetry
from verification import sqlparts as Q
from verification.sqlparts import S, query

START, END = datetime(2023, 12, 31), datetime(2024, 2, 1)
LOOKBACK = 7
SWEEP = (5, 200)  # look-backs longer than a history give no row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@cache
def _own_folder() -> str:
    """Scratch space of a check on one machine."""
    return tempfile.mkdtemp(prefix="hearthline-check-")


class Inputs:
    """Input frames of one scale, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
            use_folder(_own_folder())
        self.sf_dir = sf_dir
        self.cfg = HeatConfig()
        self.since, self.until = P.utc(START, self.cfg.timezone), P.utc(END, self.cfg.timezone)

    @cached_property
    def events(self) -> DataFrame:
        return readers.read_table(self.spark, f"{self.sf_dir}/events.parquet")

    @cached_property
    def houses(self) -> DataFrame:
        return adapters.channels_from_events(self.events).select("house_alias").distinct()

    @cached_property
    def hourly(self) -> DataFrame:
        return adapters.hourly_from_events(self.events)

    @cached_property
    def readings_1s(self) -> DataFrame:
        raw = adapters.readings_1s_from_events(self.events)
        return readers.scan_readings_1s(raw, self.since, self.until, telemetry.CHANNELS_READ)

    @cached_property
    def seconds(self) -> DataFrame:
        return telemetry.pivot_channels_per_second(self.readings_1s)

    @cached_property
    def segments(self) -> DataFrame:
        return telemetry.flow_segments(self.seconds, self.since, self.cfg)

    @cached_property
    def named(self) -> DataFrame:
        return readers.scan_readings_with_channels(
            adapters.readings_from_events(self.events),
            adapters.channels_from_events(self.events),
            self.since,
            self.until,
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        raw = adapters.messages_from_events(self.events)
        return readers.scan_forecast_messages(raw, self.since, self.until, self.cfg)

    @cached_property
    def gridded(self) -> DataFrame:
        checked = clean.valid_range_filter(clean.clamp_small_negative_hp(self.hourly))
        return clean.hour_grid(clean.rate_of_change_filter(checked, self.cfg))

    @cached_property
    def audit(self) -> DataFrame:
        return clean.clean_audit(self.hourly, self.cfg)

    @cached_property
    def features(self) -> DataFrame:
        return P.prepare(self.hourly, None, self.cfg)

    @cached_property
    def rswt_rows(self) -> DataFrame:
        return rswt.rswt_rows(self.features)

    @cached_property
    def staged_features(self) -> DataFrame:
        return stage(self.features, "features")

    @cached_property
    def backtest(self) -> P.Backtest:
        return P.backtest(self.features, LOOKBACK, self.cfg)


def check(name: str, sql: str):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        ORACLES[name] = sql
        return build

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    return settle(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def zone_part(zone: int, field: str) -> Column:
    return F.get(F.filter("zones", lambda z: z["zone"] == zone), F.lit(0))[field]


def flat_zones(df: DataFrame) -> DataFrame:
    short = {"avg_set": "set", "avg_temp": "temp", "heatcall_fraction": "hc"}
    return df.withColumns({f"z{z}_{s}": r(zone_part(z, f)) for z in (1, 2) for f, s in short.items()}).drop("zones")


ZONES = [*Q.ZONE1, *Q.ZONE2]
ZONES_SQL = ", ".join(f"{S(c)} AS {c}" for c in ZONES)


def rsql(*names: str, prefix: str = "") -> str:
    return ", ".join(f"{S(prefix + n)} AS {n}" for n in names)


# ---------------------------------------------------------------------------
# sources and sinks
# ---------------------------------------------------------------------------

@check("scan_readings_1s", query(
    f"SELECT house_alias, channel_name, unit, count(*) AS n, {S('sum(value)', 3)} AS total, min(ts) AS first_ts, "
    "max(ts) AS last_ts FROM r1s GROUP BY 1, 2, 3", "r1s"))
def _(t: Inputs):
    return t.readings_1s.groupBy("house_alias", "channel_name", "unit").agg(
        F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@check("scan_readings_with_channels", query(
    f"SELECT house_alias, channel_name, unit, count(*) AS n, {S('sum(value)', 3)} AS total FROM named GROUP BY 1, 2, 3",
    "named"))
def _(t: Inputs):
    return t.named.groupBy("house_alias", "channel_name", "unit").agg(
        F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@check("reading_channels_join", query(
    f"SELECT house_alias, channel_id, {Q.local_hour('ts')} AS hour_start, count(*) AS n, min(value) AS low, "
    "max(value) AS high FROM named GROUP BY 1, 2, 3", "named"))
def _(t: Inputs):
    hour = local_hour(F.col("ts"), t.cfg.timezone).alias("hour_start")
    return t.named.groupBy("house_alias", "channel_id", hour).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@check("scan_forecast_messages", query(
    "SELECT house_alias, ts, CASE WHEN k % 10 = 0 THEN 0 WHEN k % 3 = 0 THEN 20 ELSE 48 END AS n, "
    "CASE WHEN k % 10 <> 0 THEN 20 + k * 0.5e0 END AS first_oat, "
    "CASE WHEN k % 10 <> 0 THEN (k % 20) + (n - 1) * 0.5e0 END AS last_wind FROM e WHERE event_type = 'view'", "e"))
def _(t: Inputs):
    return t.forecasts.select(
        "house_alias", "ts", F.size("Time").alias("n"), F.get("OatF", F.lit(0)).alias("first_oat"),
        F.get("WindSpeedMph", F.size("WindSpeedMph") - 1).alias("last_wind"))


_HOURLY_NUMBERS = [*Q.CHANNELS, *Q.OPTIONAL]


@check("scan_hourly_cache", query(
    f"SELECT house_alias, hour_start, {rsql(*_HOURLY_NUMBERS)}, {ZONES_SQL}, coalesce(fc_len, 0) AS n_forecast FROM h", "h"))
def _(t: Inputs):
    path = scratch_path(t.spark, "hourly-csv")
    writers.write_hourly_csv(t.hourly, path, zones=[1, 2])
    back = readers.scan_hourly_csv(t.spark, path)
    out = rounded(back, *_HOURLY_NUMBERS).withColumn("n_forecast", F.coalesce(F.size("oat_f_forecast"), F.lit(0)))
    return flat_zones(out.drop("oat_f_forecast", "ws_mph_forecast"))


@check("scan_solar", "SELECT date_trunc('hour', ts) AS hour_start, CAST(greatest(0, 500 - 90 * abs(hour(ts) - 13)) "
       "AS DOUBLE) AS solar_w_m2 FROM events GROUP BY 1, 2")
def _(t: Inputs):
    path = scratch_path(t.spark, "solar-csv")
    writers.write_table(
        adapters.solar_from_events(t.events).withColumn("note", F.lit("x")), path, "csv")
    return readers.scan_solar(t.spark, path)


@check("write_hourly", query(
    f"SELECT house_alias, hour_start, {rsql(*_HOURLY_NUMBERS)}, "
    + ", ".join(f"{S(a)} AS {b}" for a, b in zip(ZONES, [
        "zone1_avg_set", "zone1_avg_temp", "zone1_heatcall_fraction",
        "zone2_avg_set", "zone2_avg_temp", "zone2_heatcall_fraction"])) + " FROM h", "h"))
def _(t: Inputs):
    path = scratch_path(t.spark, "hourly-table")
    writers.write_hourly(t.hourly, path)
    wide = columns.hourly_wide(readers.scan_hourly_cache(t.spark, path), [1, 2])
    wide = wide.drop("oat_f_forecast", "ws_mph_forecast")
    return rounded(wide, *[c for c in wide.columns if c not in merge.HOUSE_HOUR])


def stored(t: Inputs, df: DataFrame, label: str) -> DataFrame:
    """``df`` as its result table gives it back."""
    path = scratch_path(t.spark, label)
    writers.write_table(df, path)
    return t.spark.read.parquet(path)


_COEF_NAMES = ["intercept", *HeatConfig().feature_names]


@check("write_energy_params", query(
    "SELECT house_alias, n_days, " + ", ".join(
        f"main_b{i} AS {n}, main_se{i} AS std_error_{n}" for i, n in enumerate(_COEF_NAMES))
    + ", main_r2 AS r_squared, energy_ratio FROM fit_all", "fit_all"))
def _(t: Inputs):
    return stored(t, writers.energy_params_table(P.energy_params(t.staged_features, t.cfg), t.cfg), "energy-params")


_BAND_COLUMNS = [f"{b}_{c}" for b in ("load_0_2", "load_2_4", "load_4_6", "load_6_8", "load_8_plus")
                 for c in ("rwt_intercept", "rwt_slope")]


@check("write_rswt_params", query(
    "SELECT house_alias, 50e0 AS rwt_min, water_kg_hour_chc, " + ", ".join(
        f"max({c}) FILTER (WHERE band = '{b}') AS {b}_{c}"
        for b in ("load_0_2", "load_2_4", "load_4_6", "load_6_8", "load_8_plus")
        for c in ("rwt_intercept", "rwt_slope"))
    + " FROM bands JOIN chc USING (house_alias) WHERE water_kg_hour_chc IS NOT NULL GROUP BY 1, 2, 3 "
    "HAVING count(rwt_slope) > 0", "bands", "chc"))
def _(t: Inputs):
    back = stored(t, P.rswt_params(t.staged_features, t.cfg).params, "rswt-params")
    return back.select("house_alias", "rwt_min", "water_kg_hour_chc", *_BAND_COLUMNS)


@check("write_trailing_params", Q.one_lookback(LOOKBACK, 
    "SELECT house_alias, n, CAST(fit_day AS VARCHAR) AS fit_day, " + ", ".join(
        f"main_b{i} AS B{i}, main_se{i} AS std_error_B{i}" for i in range(7))
    + f", main_r2 AS r_squared, energy_ratio FROM fit_bt WHERE n = {LOOKBACK}", "fit_bt"))
def _(t: Inputs):
    fits = P.backtest_fits(t.staged_features, LOOKBACK, t.cfg)
    back = stored(t, writers.trailing_params_table(fits, t.cfg), "trailing-params")
    return back.withColumn("fit_day", F.col("fit_day").cast("string"))


#: Parameters of a run by their place in the manifest, with the values they must have.
_PARAMETERS = {
    "zone_clock": ("timezone", "America/New_York"), "horizon": ("horizon_hours", "48"), "training": ("training_frequency", "weekly"),
    "first_feature": ("feature_names[0]", "deltaT"), "last_band": ("load_bands[4][1]", "inf"), "gap_limit": ("long_gap_hours", "4"),
    "boiler": ("oil_boiler_watts", "50.0"), "thermostat": ("thermostat_gap_overrides[0][2]", "4.5"),
    "top_load": ("valid_ranges.dist_kwh[1]", "25.0"), "forecasts": ("use_forecasts", "true"),
}


@check("write_run_manifest", query(
    "SELECT '2023-12-31T00:00:00' AS start_time, '2024-02-01T00:00:00' AS end_time, 'America/New_York' AS timezone, "
    "CAST(1700000000000 AS BIGINT) AS run_ms, 'results/result_1700000000000' AS run_dir, house_alias, "
    "run_dir || '/' || house_alias AS house_dir, " + ", ".join(
        f"house_dir || '/{p}' AS {p}_dir" for p in ("energy_params", "rswt_params", "trailing_performance", "sweep_n"))
    + ", " + ", ".join(f"'{v}' AS {k}" for k, (_, v) in _PARAMETERS.items()) + " FROM houses", "houses"))
def _(t: Inputs):
    path = scratch_path(t.spark, "manifest")
    writers.write_run_manifest(writers.run_manifest(t.houses, START, END, 1700000000000, t.cfg), path)
    # a house written again replaces its own entry alone
    again = t.houses.where(F.col("house_alias").endswith("1"))
    writers.write_run_manifest(writers.run_manifest(again, START, END, 1700000000000, t.cfg), path)
    back = t.spark.read.json(path)
    found = {k: F.get_json_object("parameters", f"$.{at}") for k, (at, _) in _PARAMETERS.items()}
    return back.withColumns(found).drop("parameters")


# ---------------------------------------------------------------------------
# projections, filters, predicates
# ---------------------------------------------------------------------------

@check("half_open_time_filter", query(
    "SELECT house_alias, hour_start, " + S("dist_kwh") + " AS dist_kwh FROM h WHERE "
    "hour_start >= TIMESTAMP '2024-01-01 05:00:00' AND hour_start < TIMESTAMP '2024-01-30 20:00:00'", "h"))
def _(t: Inputs):
    cropped = P.crop(t.hourly, datetime(2024, 1, 1, 5), datetime(2024, 1, 30, 20))
    return cropped.select("house_alias", "hour_start", r("dist_kwh").alias("dist_kwh"))


@check("house_match", query(
    "SELECT house_alias, lower(trim(house_alias)) = 'h1' AS is_house, house_alias ILIKE '%H1%' AS contains_house, "
    "count(*) AS n FROM e GROUP BY 1, 2, 3", "e"))
def _(t: Inputs):
    alias = F.col("house_alias")
    rows = adapters.messages_from_events(t.events).withColumnRenamed("from_alias", "house_alias")
    return rows.groupBy(
        "house_alias",
        readers.house_match(alias, " H1 ").alias("is_house"),
        readers.house_match(alias, "H1", substring=True).alias("contains_house"),
    ).agg(F.count("*").alias("n"))


@check("zone_channel_filter", query(
    "SELECT DISTINCT house_alias, channel_name, regexp_matches(channel_name, '^zone[0-9]+-.+-(temp|set|heat-call)$') "
    "AND channel_name NOT ILIKE '%gw-temp%' AS is_zone, "
    "TRY_CAST(regexp_extract(channel_name, '^zone([0-9]+)-', 1) AS INTEGER) AS zone, "
    "regexp_extract(channel_name, '^zone[0-9]+-.+-(temp|set|heat-call)$', 1) AS kind FROM named", "named"))
def _(t: Inputs):
    name = F.col("channel_name")
    zone = F.when(readers.is_zone_channel(name), readers.zone_of(name))
    return t.named.select(
        "house_alias", "channel_name", readers.is_zone_channel(name).alias("is_zone"),
        zone.alias("zone"), readers.kind_of(name).alias("kind")).distinct()


@check("decode_units", query(
    "SELECT house_alias, channel_name, unit, " + S(
        "sum(CASE WHEN unit = 'GpmTimes100' THEN value / 100 WHEN unit LIKE '%Times1000' THEN value / 1000 ELSE value END)", 4)
    + " AS total FROM (SELECT house_alias, channel_name, unit, value FROM r1s UNION ALL "
    "SELECT house_alias, channel_name, unit, value FROM named) GROUP BY 1, 2, 3", "r1s", "named"))
def _(t: Inputs):
    fields = ["house_alias", "channel_name", "unit", "value"]
    rows = t.readings_1s.select(*fields).unionByName(t.named.select(*fields))
    return rows.groupBy(*fields[:3]).agg(
        r(F.sum(decode_units(F.col("value"), F.col("unit"))), 4).alias("total"))


@check("thermal_power_kw", query(
    f"SELECT house_alias, {Q.local_hour('ts')} AS hour_start, count(hp_kw) AS n_hp, count(dist_kw) AS n_dist, "
    f"{S('min(hp_kw)')} AS hp_low, {S('max(hp_kw)')} AS hp_high, {S('sum(dist_kw)', 4)} AS dist_total "
    "FROM kw GROUP BY 1, 2", "kw"))
def _(t: Inputs):
    hp = thermal_power_kw(F.col("primary_flow_gpm"), F.col("hp_lwt_c"), F.col("hp_ewt_c"))
    dist = thermal_power_kw(F.col("dist_flow_gpm"), F.col("dist_swt_c"), F.col("dist_rwt_c"))
    rows = t.seconds.select(
        "house_alias", local_hour(F.col("ts"), t.cfg.timezone).alias("hour_start"), hp.alias("hp"), dist.alias("dist"))
    return rows.groupBy("house_alias", "hour_start").agg(
        F.count("hp").alias("n_hp"), F.count("dist").alias("n_dist"), r(F.min("hp")).alias("hp_low"),
        r(F.max("hp")).alias("hp_high"), r(F.sum("dist"), 4).alias("dist_total"))


@check("conform_columns", query(
    f"SELECT house_alias, hour_start, {rsql(*[c for c in _HOURLY_NUMBERS if c != 'ws_mph'])}, "
    "CAST(NULL AS DOUBLE) AS ws_mph, " + ZONES_SQL + " FROM h", "h"))
def _(t: Inputs):
    odd = t.hourly.drop("ws_mph").withColumn("note", F.lit("extra"))
    out = columns.conform_columns(odd).drop("oat_f_forecast", "ws_mph_forecast")
    return flat_zones(rounded(out, *_HOURLY_NUMBERS))


@check("discover_zones", query(
    "SELECT house_alias, CASE WHEN bool_or(has2) THEN '1,2' ELSE '1' END AS zones FROM h GROUP BY 1", "h"))
def _(t: Inputs):
    joined = F.array_join(F.col("zone_list").cast("array<string>"), ",")
    return columns.discover_zones(t.hourly).select("house_alias", joined.alias("zones"))


@check("house_status", query(
    "SELECT x.house_alias, coalesce(h.n, 0) AS n_hours, coalesce(f.n, 0) AS n_rows, "
    "CASE WHEN h.n IS NULL THEN 'no_hourly_data' WHEN f.n IS NULL THEN 'no_usable_rows' WHEN f.load = 0 THEN 'no_load' "
    "ELSE 'ok' END AS energy_status, "
    "CASE WHEN h.n IS NULL THEN 'no_hourly_data' WHEN f.n IS NULL THEN 'no_usable_rows' WHEN b.n_rows IS NULL THEN "
    "'no_rswt_rows' WHEN b.n = 0 THEN 'no_band_large_enough' WHEN coalesce(c.n_hours, 0) = 0 THEN 'no_chc_water' "
    "ELSE 'ok' END AS rswt_status, "
    "CASE WHEN h.n IS NULL THEN 'no_hourly_data' WHEN f.n IS NULL THEN 'no_usable_rows' WHEN f.d < 7 THEN "
    "'no_trailing_fit' ELSE 'ok' END AS backtest_status FROM "
    "(SELECT house_alias FROM houses UNION ALL SELECT house_alias || '-new' FROM houses) x "
    "LEFT JOIN (SELECT house_alias, count(*) AS n FROM h GROUP BY 1) h USING (house_alias) "
    "LEFT JOIN (SELECT house_alias, count(*) AS n, count(DISTINCT day) AS d, sum(dist_kwh) AS load FROM feat GROUP BY 1) f "
    "USING (house_alias) LEFT JOIN (SELECT house_alias, count(rwt_slope) AS n, sum(n_hours) AS n_rows FROM bands GROUP BY 1) b "
    "USING (house_alias) LEFT JOIN chc c USING (house_alias)", "houses", "h", "feat", "bands", "chc"))
def _(t: Inputs):
    new = t.houses.select(F.concat("house_alias", F.lit("-new")).alias("house_alias"))
    return P.house_status(t.houses.unionByName(new), t.hourly, t.staged_features, t.cfg, LOOKBACK)


_MERGED_NUMBERS = ["dist_kwh", "hp_kwh_th", "oil_boiler_pwr"]


@check("hourly_defaults", query(
    "SELECT q.house_alias, q.hour_start, CAST(NULL AS DOUBLE) AS ws_mph, 0e0 AS dist_kwh, 0e0 AS hp_kwh_th, "
    "coalesce(o.oil_boiler_pwr, 0e0) AS oil_boiler_pwr, z.avg_set AS z1_set, z.avg_temp AS z1_temp, "
    "coalesce(z.heatcall_fraction, 0e0) AS z1_hc FROM skel q LEFT JOIN oil_h o USING (house_alias, hour_start) "
    "LEFT JOIN zone_h z USING (house_alias, hour_start)", "skel", "oil_h", "zone_h"))
def _(t: Inputs):
    merged = merge.merge_hourly_sources(
        merge.expected_hours(t.houses, START, END),
        sensors.sensor_hourly(t.named, t.cfg))
    return flat_zones(merge.hourly_defaults(merged)).select(
        "house_alias", "hour_start", "ws_mph", *_MERGED_NUMBERS, "z1_set", "z1_temp", "z1_hc")


# ---------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------

@check("segment_bounds_join", query(
    "SELECT house_alias, batch, seg_start, max(ts) AS seg_end, count(*) AS n, "
    "count(*) FILTER (WHERE ts >= seg_start + INTERVAL 30 SECOND) AS n_eligible FROM seg GROUP BY 1, 2, 3", "seg"))
def _(t: Inputs):
    return t.segments.where(F.col("segment_start").isNotNull()).groupBy(
        "house_alias", "batch", F.col("segment_start").alias("seg_start")
    ).agg(F.max("ts").alias("seg_end"), F.count("*").alias("n"), F.count(F.when(F.col("eligible"), 1)).alias("n_eligible"))


@check("asof_forecast", query(
    f"SELECT house_alias, hour_start, local_ts AS forecast_ts, {Q.oat_at('0')} AS oat_f, {Q.wind_at('0')} AS ws_mph, "
    f"{Q.oat_at('47')} AS oat_last, {Q.wind_at('19')} AS wind_20 FROM asof_h", "asof_h"))
def _(t: Inputs):
    chosen = forecast.asof_forecast(t.hourly, forecast.dedupe_forecasts(t.forecasts, t.cfg), t.cfg)
    return chosen.select(
        "house_alias", "hour_start", "forecast_ts", "oat_f", "ws_mph",
        F.get("oat_f_forecast", F.lit(47)).alias("oat_last"), F.get("ws_mph_forecast", F.lit(19)).alias("wind_20"))


@check("solar_fill", query(
    "SELECT house_alias, hour_start, CASE WHEN hour(hour_start) % 3 = 0 THEN "
    "CAST(greatest(0, 500 - 90 * abs(hour(hour_start) - 13)) AS DOUBLE) ELSE solar_w_m2 END AS solar_w_m2, "
    "CASE WHEN has2 THEN 0e0 WHEN hour(hour_start) % 3 <> 0 THEN solar_w_m2 END AS without_lookup FROM h", "h"))
def _(t: Inputs):
    some = F.when(F.hour("hour_start") % 3 != 0, F.col("solar_w_m2"))
    holes = t.hourly.withColumn("solar_w_m2", some)
    filled = merge.solar_fill(holes, adapters.solar_from_events(t.events))
    # houses with two zones stand for houses without any irradiance
    none = holes.withColumn("solar_w_m2", F.when(F.size("zones") == 1, F.col("solar_w_m2")))
    plain = merge.solar_fill(none, None).select(
        "house_alias", "hour_start", F.col("solar_w_m2").alias("without_lookup"))
    return filled.select("house_alias", "hour_start", "solar_w_m2").join(plain, ["house_alias", "hour_start"])


@check("merge_hourly_sources", query(
    f"SELECT house_alias, hour_start, oat_f, ws_mph, oat_47, coalesce(dist_kwh, 0e0) AS dist_kwh, "
    "coalesce(hp_kwh_th, 0e0) AS hp_kwh_th, swt_average_f, rwt_average_f, dist_water_kg, "
    "coalesce(oil_boiler_pwr, 0e0) AS oil_boiler_pwr, avg_set AS z1_set, avg_temp AS z1_temp, "
    "coalesce(heatcall_fraction, 0e0) AS z1_hc FROM merged", "merged"))
def _(t: Inputs):
    hourly = P.build_hourly(
        adapters.readings_1s_from_events(t.events), adapters.readings_from_events(t.events),
        adapters.channels_from_events(t.events), adapters.messages_from_events(t.events),
        t.houses, START, END, t.cfg)
    return flat_zones(hourly).select(
        "house_alias", "hour_start", "oat_f", "ws_mph", F.get("oat_f_forecast", F.lit(47)).alias("oat_47"),
        "dist_kwh", "hp_kwh_th", "swt_average_f", "rwt_average_f", "dist_water_kg", "oil_boiler_pwr",
        "z1_set", "z1_temp", "z1_hc")


def _parts_of(t: Inputs) -> Telemetry:
    return Telemetry(
        adapters.readings_1s_from_events(t.events), adapters.readings_from_events(t.events),
        adapters.channels_from_events(t.events), adapters.messages_from_events(t.events))


@check("refresh_hourly", query(
    "SELECT house_alias, hour_start, oat_f, ws_mph, oat_47, coalesce(dist_kwh, 0e0) AS dist_kwh, "
    "coalesce(hp_kwh_th, 0e0) AS hp_kwh_th, swt_average_f, rwt_average_f, dist_water_kg, "
    "coalesce(oil_boiler_pwr, 0e0) AS oil_boiler_pwr FROM merged "
    "WHERE hour_start >= TIMESTAMP '2024-01-05 00:00:00' AND hour_start < TIMESTAMP '2024-01-25 00:00:00'", "merged"))
def _(t: Inputs):
    """A table with holes brought up to date: whole batches are missing, so their edges are those of a full build."""
    telemetry = _parts_of(t)
    path = scratch_path(t.spark, "hourly")
    first, last = datetime(2024, 1, 5), datetime(2024, 1, 25)  # four batches of five days
    refresh.refresh_hourly(t.spark, path, telemetry, t.houses, first, first + timedelta(days=5), t.cfg)
    odd = t.houses.where(F.substring("house_alias", 2, 9).cast("int") % 2 == 1)
    refresh.refresh_hourly(t.spark, path, telemetry, odd, first + timedelta(days=10), first + timedelta(days=15), t.cfg)
    refresh.refresh_hourly(t.spark, path, telemetry, t.houses, first, last, t.cfg)
    hourly = refresh.read_hourly(t.spark, path, t.houses, first, last)
    return hourly.select(
        "house_alias", "hour_start", "oat_f", "ws_mph", F.get("oat_f_forecast", F.lit(47)).alias("oat_47"), "dist_kwh", "hp_kwh_th",
        "swt_average_f", "rwt_average_f", "dist_water_kg", "oil_boiler_pwr")


_MISSING_SQL = ("SELECT house_alias, hour_start FROM skel EXCEPT SELECT house_alias, hour_start FROM h")


def _missing(t: Inputs) -> DataFrame:
    return merge.missing_hours(merge.expected_hours(t.houses, START, END), t.hourly)


@check("missing_hours", query(_MISSING_SQL, "skel", "h"))
def _(t: Inputs):
    return _missing(t)


@check("hour_grid", query(
    f"SELECT house_alias, hour_start, inserted, {rsql('oat_f', 'dist_kwh', 'swt_average_f', *Q.ZONE1)} FROM grid", "grid"))
def _(t: Inputs):
    return flat_zones(rounded(t.gridded, "oat_f", "dist_kwh", "swt_average_f")).select(
        "house_alias", "hour_start", "inserted", "oat_f", "dist_kwh", "swt_average_f", *Q.ZONE1)


@check("asof_fit", Q.one_lookback(LOOKBACK, 
    "SELECT f.house_alias, f.hour_start AS origin, CAST(max(s.fit_day) AS VARCHAR) AS fit_day FROM feat f "
    f"JOIN sched s ON s.house_alias = f.house_alias AND s.n = {LOOKBACK} AND s.fit_day < f.day "
    "WHERE f.rn <= f.total - 48 GROUP BY 1, 2", "feat", "sched"))
def _(t: Inputs):
    fits = P.backtest_fits(t.staged_features, LOOKBACK, t.cfg)
    origins = B.origin_lead_join(t.staged_features, t.cfg)
    return B.asof_fit(origins, fits).select("house_alias", "origin", F.col("fit_day").cast("string").alias("fit_day"))


@check("origin_lead_join", query(
    f"SELECT house_alias, origin, count(*) AS n_targets, max(hour_start) AS last_hour, {S('sum(dist_kwh)', 4)} AS total, "
    f"{S('max(dist_kwh) FILTER (WHERE step = 10)')} AS load_11 FROM steps GROUP BY 1, 2", "steps"))
def _(t: Inputs):
    loads = F.transform("targets", lambda x: x["dist_kwh"])
    return B.origin_lead_join(t.features, t.cfg).select(
        "house_alias", "origin", F.size("targets").cast("bigint").alias("n_targets"),
        F.element_at("targets", -1)["hour_start"].alias("last_hour"),
        r(F.aggregate(loads, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        r(F.get(loads, F.lit(10))).alias("load_11"))


_RECENT_SQL = ("(SELECT house_alias, day FROM (SELECT DISTINCT house_alias, day FROM feat) "
               "QUALIFY row_number() OVER (PARTITION BY house_alias ORDER BY day DESC) <= 7)")


@check("window_days_semi_join", query(
    f"SELECT house_alias, CAST(day AS VARCHAR) AS day, count(*) AS n, {S('sum(dist_kwh)')} AS total FROM feat "
    f"SEMI JOIN {_RECENT_SQL} d USING (house_alias, day) GROUP BY 1, 2", "feat"))
def _(t: Inputs):
    features = t.staged_features
    days = R.last_n_days(features.select("house_alias", "day").distinct(), 7)
    rows = features.join(days, ["house_alias", "day"], "left_semi")
    return rows.groupBy("house_alias", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), r(F.sum("dist_kwh")).alias("total"))


# ---------------------------------------------------------------------------
# aggregations
# ---------------------------------------------------------------------------

_SECOND_COLUMNS = list(telemetry.SECOND_CHANNELS)


@check("pivot_channels_per_second", query(
    f"SELECT house_alias, date_trunc('hour', ts) AS hour, count(*) AS n_seconds, "
    + ", ".join(f"{S(f'sum({c})', 4)} AS {c}" for c in _SECOND_COLUMNS) + " FROM sec GROUP BY 1, 2", "sec"))
def _(t: Inputs):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return t.seconds.groupBy("house_alias", hour).agg(
        F.count("*").alias("n_seconds"), *[r(F.sum(c), 4).alias(c) for c in _SECOND_COLUMNS])


@check("hourly_energy", query("SELECT * FROM energy_h", "energy_h"))
def _(t: Inputs):
    return telemetry.hourly_energy(t.seconds, t.cfg)


@check("hourly_water_kg", query("SELECT * FROM water_h", "water_h"))
def _(t: Inputs):
    return telemetry.hourly_water_kg(t.seconds, t.cfg)


@check("hourly_flow_temps", query("SELECT * FROM flowt_h", "flowt_h"))
def _(t: Inputs):
    return telemetry.hourly_flow_temps(t.segments, t.cfg)


@check("time_weighted_avg_locf", query(
    f"SELECT house_alias, channel_name, unit, hour_start, {S('avg_value', 4)} AS avg_value FROM tw", "tw"))
def _(t: Inputs):
    return rounded(sensors.time_weighted_avg_locf(t.named, t.cfg), "avg_value", digits=4)


@check("oil_boiler_hourly", query("SELECT * FROM oil_h", "oil_h"))
def _(t: Inputs):
    return sensors.oil_boiler_hourly(t.named, t.cfg)


@check("zone_hourly", query("SELECT * FROM zone_h", "zone_h"))
def _(t: Inputs):
    return sensors.zone_hourly(t.named, t.cfg)


_MOMENT_NAMES = {"one": "one", "dt": "deltaT", "wdt": "windspeed_times_deltaT", "sol": "solar_w_m2",
                 "prev": "previous_dist_kwh", "oat4": "OAT_avg_4h", "load4": "dist_kwh_avg_4h", "y": "dist_kwh",
                 "oat": "oat_f", "w65": "windspeed_times_65_minus_oat"}


def _moment_pairs() -> list[tuple[str, str]]:
    return [(f"sum__{_MOMENT_NAMES[a]}__{_MOMENT_NAMES[b]}", f"m_{a}_{b}") for a, b in Q.MOMENTS] + [("sum__hp", "m_hp")]


@check("ols_moments", query(
    "SELECT house_alias, CAST(day AS VARCHAR) AS day, " + ", ".join(
        f"{S(m, 4)} AS {name}" for name, m in _moment_pairs()) + " FROM mom", "mom"))
def _(t: Inputs):
    moments = R.ols_moments(t.features, t.cfg)
    return moments.select(
        "house_alias", F.col("day").cast("string").alias("day"),
        *[r(name, 4).alias(name) for name, _ in _moment_pairs()])


def _coefs(prefix: str, n: int) -> list[Column]:
    c, e = (f"{prefix}coefficients", f"{prefix}std_errors")
    return [x for i in range(n) for x in (
        F.get(c, F.lit(i)).alias(f"b{i}"), F.get(e, F.lit(i)).alias(f"se{i}"))]


def _coef_sql(kind: str, n: int) -> str:
    return ", ".join(f"{kind}_b{i} AS b{i}, {kind}_se{i} AS se{i}" for i in range(n))


@check("fit_energy_params", query(
    f"SELECT house_alias, n_days, n_hours, energy_ratio, {_coef_sql('main', 7)}, main_r2 AS r_squared FROM fit_all",
    "fit_all"))
def _(t: Inputs):
    return P.energy_params(t.staged_features, t.cfg).select(
        "house_alias", "n_days", "n_hours", "energy_ratio", *_coefs("", 7), "r_squared")


@check("fit_baseline_params", query(
    f"SELECT house_alias, n_days, n_hours, energy_ratio, {_coef_sql('base', 3)}, base_r2 AS r_squared FROM fit_all",
    "fit_all"))
def _(t: Inputs):
    return P.energy_params(t.staged_features, t.cfg).select(
        "house_alias", "n_days", "n_hours", "energy_ratio", *_coefs("baseline_", 3),
        F.col("baseline_r_squared").alias("r_squared"))


@check("fit_rswt_bands", query("SELECT * FROM bands", "bands"))
def _(t: Inputs):
    return rswt.fit_rswt_bands(t.rswt_rows, t.cfg)


@check("chc_water", query(
    f"SELECT house_alias, water_kg_hour_chc, n_hours, {rsql('min_heatcall', 'max_heatcall')}, pool FROM chc", "chc"))
def _(t: Inputs):
    return rounded(rswt.chc_water(t.rswt_rows, t.cfg), "min_heatcall", "max_heatcall")


def metrics(df: DataFrame) -> DataFrame:
    df = rounded(df, "mae", "rmse", "mae_baseline", "rmse_baseline")
    return rounded(df, "mae_gain_pct", "rmse_gain_pct", digits=4)


@check("oos_metrics", Q.one_lookback(LOOKBACK, 
    f"SELECT house_alias, n, {Q.METRICS} FROM points WHERE n = {LOOKBACK} GROUP BY 1, 2", "points"))
def _(t: Inputs):
    return metrics(t.backtest.metrics)


@check("rmse_by_lead", Q.one_lookback(LOOKBACK, 
    f"SELECT house_alias, n, lead, count(*) AS n_points, {S('sqrt(avg(e * e))')} AS rmse, {S('sqrt(avg(eb * eb))')} "
    f"AS rmse_baseline FROM points WHERE n = {LOOKBACK} GROUP BY 1, 2, 3", "points"))
def _(t: Inputs):
    return rounded(t.backtest.by_lead, "rmse", "rmse_baseline")


@check("in_sample_metrics", query(f"SELECT house_alias, {Q.METRICS} FROM ins GROUP BY 1", "ins"))
def _(t: Inputs):
    features = t.staged_features
    return metrics(R.in_sample_metrics(features, P.energy_params(features, t.cfg), t.cfg))


@check("hourly_residual_ci", Q.one_lookback(LOOKBACK, 
    "SELECT x.house_alias, CAST(7 AS INTEGER) AS n, x.weekend, CAST(x.hour AS INTEGER) AS hour, count(e) AS n_points, "
    f"{S('avg(e)')} AS mean_residual, "
    f"CASE WHEN count(e) >= 2 THEN {S('1.96e0 * stddev_samp(e) / sqrt(count(e))')} ELSE 0e0 END AS ci95 FROM "
    "(SELECT DISTINCT house_alias, w.weekend, g.hour FROM points, (VALUES (false), (true)) w(weekend), range(24) g(hour) "
    "WHERE n = 7) x LEFT JOIN points p ON p.house_alias = x.house_alias AND p.n = 7 AND p.lead = 1 "
    "AND hour(p.hour_start) = x.hour AND (isodow(p.hour_start) >= 6) = x.weekend GROUP BY 1, 3, 4", "points"))
def _(t: Inputs):
    return rounded(t.backtest.residuals, "mean_residual", "ci95")


@check("error_histogram", query(
    "SELECT house_alias, model, bin, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT house_alias, '{m}' AS model, CAST(least(60, floor(({e} + 6) * 60 / 12) + 1) AS INTEGER) AS bin "
        f"FROM ins WHERE {e} BETWEEN -6 AND 6" for m, e in (("model", "e"), ("baseline", "eb")))
    + ") GROUP BY 1, 2, 3", "ins"))
def _(t: Inputs):
    features = t.staged_features
    points = R.predict(features, P.energy_params(features, t.cfg), t.cfg)
    return R.error_histogram(points, ["house_alias"])


def _distribution_sql() -> str:
    rows = []
    for stage_name, table in (("before", "h"), ("after", "clean")):
        for c in [c for c in Q.CHANNELS if c != "oil_boiler_pwr"]:
            rows.append(f"SELECT house_alias, '{stage_name}' AS stage, 0 AS zone, '{c}' AS channel, {c} AS value FROM {table}")
        for z in (1, 2):
            for f, full in (("set", "avg_set"), ("temp", "avg_temp")):
                rows.append(f"SELECT house_alias, '{stage_name}', {z}, 'zone{z}_{full}', z{z}_{f} FROM {table}"
                            + (" WHERE has2" if z == 2 else ""))
    return f"""SELECT house_alias, stage, channel, n_null, n_values, {rsql('q1', 'median', 'q3', 'whisker_low', 'whisker_high')},
  n_outliers, CASE WHEN zone > 0 AND stage = 'after' THEN {S('lo - pad')} END AS axis_low,
  CASE WHEN zone > 0 AND stage = 'after' THEN {S('hi + pad')} END AS axis_high
FROM (SELECT *, min(min_value) OVER z AS lo, max(max_value) OVER z AS hi, greatest((hi - lo) * 0.05e0, 0.25e0) AS pad FROM (
  SELECT house_alias, stage, zone, channel, count(*) - count(value) AS n_null, count(value) AS n_values,
    max(q1) AS q1, max(median) AS median, max(q3) AS q3, least(max(q1), min(value) FILTER (WHERE value >= q1 - 1.5e0 * (q3 - q1))) AS whisker_low,
    greatest(max(q3), max(value) FILTER (WHERE value <= q3 + 1.5e0 * (q3 - q1))) AS whisker_high,
    count(*) FILTER (WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)) AS n_outliers,
    min(value) AS min_value, max(value) AS max_value
  FROM (SELECT *, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.5) OVER w AS median,
          quantile_cont(value, 0.75) OVER w AS q3 FROM ({' UNION ALL '.join(rows)})
        WINDOW w AS (PARTITION BY house_alias, stage, channel)) GROUP BY 1, 2, 3, 4)
  WINDOW z AS (PARTITION BY house_alias, stage, zone))"""


@check("channel_distribution", query(_distribution_sql(), "h", "clean"))
def _(t: Inputs):
    out = clean.channel_distribution(t.hourly, clean.cleaned_rows(t.audit))
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high", "axis_low", "axis_high")


_RULES = ("no_rolling_mean", "long_gap", "missing_values", "oil_boiler", "below_setpoint", "setpoint_change",
          "broken_thermostat", "external_heat")


@check("cleaning_report", query(
    "SELECT house_alias, count(*) AS grid_hours, CAST(sum(coalesce(n_out_of_range, 0)) AS BIGINT) AS nulled_range, "
    "count(*) FILTER (WHERE jump) AS nulled_rate_of_change, count(*) FILTER (WHERE inserted) AS inserted_hours, "
    "CAST(sum(n_filled) AS BIGINT) AS filled_values, count(*) FILTER (WHERE gap_hour) AS long_gap_hours, "
    "CAST(sum(CASE WHEN oat4 IS NOT NULL AND load4 IS NOT NULL AND NOT gap_hour THEN n_missing ELSE 0 END) AS BIGINT) "
    "AS remaining_nulls, " + ", ".join(f"count(*) FILTER (WHERE dropped_by = '{x}') AS dropped_{x}" for x in _RULES)
    + ", count(*) FILTER (WHERE external_heat AND dropped_by IS NULL) AS flagged_external_heat, "
    "count(*) FILTER (WHERE dropped_by IS NULL) AS kept_hours FROM audit GROUP BY 1", "audit"))
def _(t: Inputs):
    return clean.cleaning_report(t.audit)


_STABILITY = ("(SELECT house_alias, n, count(*) AS n_fits, avg(abs(d)) AS stability FROM (SELECT *, main_b1 - lag(main_b1) "
              "OVER (PARTITION BY house_alias, n ORDER BY fit_day) AS d FROM fit_bt) GROUP BY 1, 2)")


@check("sweep_n", query(
    f"SELECT s.house_alias, s.n, s.n_fits, {S('s.stability')} AS stability, m.n_points, m.rmse, m.rmse_baseline FROM "
    f"{_STABILITY} s LEFT JOIN (SELECT house_alias, n, count(*) AS n_points, {S('sqrt(avg(e * e))')} AS rmse, "
    f"{S('sqrt(avg(eb * eb))')} AS rmse_baseline FROM points GROUP BY 1, 2) m USING (house_alias, n)", "points", "fit_bt"))
def _(t: Inputs):
    return rounded(P.sweep_n(t.features, *SWEEP, t.cfg), "stability", "rmse", "rmse_baseline")


@check("coef_stability", query(
    f"SELECT house_alias, n, n_fits, {S('stability')} AS stability FROM {_STABILITY}", "fit_bt"))
def _(t: Inputs):
    return rounded(sweep.coef_stability(P.sweep_fits(t.staged_features, *SWEEP, t.cfg), t.cfg), "stability")


# ---------------------------------------------------------------------------
# windows and ordered operators
# ---------------------------------------------------------------------------

@check("local_hour_bucket", query(
    f"SELECT house_alias, {Q.local_hour('ts')} AS hour_start, count(*) AS n, {S('sum(value)', 4)} AS total "
    "FROM e GROUP BY 1, 2", "e"))
def _(t: Inputs):
    events = t.events.select(
        F.concat(F.lit("h"), F.floor(F.col("user_id") / adapters.USERS_PER_HOUSE).cast("string")).alias("house_alias"),
        "ts", "value")
    return events.groupBy("house_alias", local_hour(F.col("ts"), t.cfg.timezone).alias("hour_start")).agg(
        F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@check("flow_segments", query(
    "SELECT house_alias, batch, date_trunc('hour', ts) AS hour, count(*) AS n_flowing, "
    "count(*) FILTER (WHERE ts >= seg_start + INTERVAL 30 SECOND) AS n_eligible, count(DISTINCT seg_start) AS n_segments "
    "FROM seg GROUP BY 1, 2, 3", "seg"))
def _(t: Inputs):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return t.segments.where(F.col("segment_start").isNotNull()).groupBy("house_alias", "batch", hour).agg(
        F.count("*").alias("n_flowing"), F.count(F.when(F.col("eligible"), 1)).alias("n_eligible"),
        F.count_distinct("segment_start").alias("n_segments"))


@check("fetch_ranges", query(
    f"SELECT house_alias, min(hour_start) AS range_start, max(hour_start) + INTERVAL 1 HOUR AS range_end FROM ("
    "SELECT *, hour_start - to_hours(row_number() OVER (PARTITION BY house_alias ORDER BY hour_start)) AS island "
    f"FROM ({_MISSING_SQL})) GROUP BY house_alias, island", "skel", "h"))
def _(t: Inputs):
    return merge.fetch_ranges(_missing(t))


_CACHED = "SELECT house_alias, hour_start, dist_kwh, 'cached' AS origin FROM h WHERE day(hour_start) <= 20"
_FETCHED = "SELECT house_alias, hour_start, dist_kwh + 1 AS dist_kwh, 'fetched' AS origin FROM h WHERE day(hour_start) >= 15"


def _slices(t: Inputs) -> tuple[DataFrame, DataFrame]:
    rows = t.hourly.select("house_alias", "hour_start", "dist_kwh", "zones")
    day = F.dayofmonth("hour_start")
    cached = rows.where(day <= 20).withColumn("origin", F.lit("cached"))
    fetched = rows.where(day >= 15).withColumn("dist_kwh", F.col("dist_kwh") + 1).withColumn("origin", F.lit("fetched"))
    return cached, fetched


@check("upsert_hours", query(
    f"SELECT house_alias, hour_start, {S('dist_kwh')} AS dist_kwh, origin FROM ({_CACHED} UNION ALL {_FETCHED}) "
    "QUALIFY row_number() OVER (PARTITION BY house_alias, hour_start ORDER BY origin DESC) = 1", "h"))
def _(t: Inputs):
    return rounded(P.update_cache(*_slices(t)).drop("zones"), "dist_kwh")


@check("union_cache_and_fetched", query(
    f"SELECT house_alias, hour_start, {S('dist_kwh')} AS dist_kwh, origin, CAST(origin = 'fetched' AS INTEGER) AS freshness "
    f"FROM ({_CACHED} UNION ALL {_FETCHED})", "h"))
def _(t: Inputs):
    return rounded(merge.union_cache_and_fetched(*_slices(t)).drop("zones"), "dist_kwh")


@check("expected_except_present", query(_MISSING_SQL, "skel", "h"))
def _(t: Inputs):
    expected = merge.expected_hours(t.houses, START, END)
    return expected.subtract(t.hourly.select("house_alias", "hour_start"))


@check("zone_union", query(
    "SELECT house_alias, CASE WHEN bool_or(has2) THEN '1,2' ELSE '1' END AS zones FROM h GROUP BY 1", "h"))
def _(t: Inputs):
    first_only = t.hourly.withColumn("zones", F.slice("zones", 1, 1))
    both = merge.zone_union(first_only, t.hourly)
    return both.select("house_alias", F.array_join(F.col("zone_list").cast("array<string>"), ",").alias("zones"))


@check("dedupe_forecasts", query(
    f"SELECT house_alias, local_ts, ts, len AS n, {Q.oat_at('0')} AS first_oat, {Q.wind_at('19')} AS wind_20 FROM fcv", "fcv"))
def _(t: Inputs):
    return forecast.dedupe_forecasts(t.forecasts, t.cfg).select(
        "house_alias", "local_ts", "ts", F.size("oat").alias("n"), F.get("oat", F.lit(0)).alias("first_oat"),
        F.get("wind", F.lit(19)).alias("wind_20"))


@check("rate_of_change_filter", query(
    f"SELECT house_alias, hour_start, jump AS roc_nulled, {S('oat_f')} AS oat_f FROM roc", "roc"))
def _(t: Inputs):
    checked = clean.valid_range_filter(clean.clamp_small_negative_hp(t.hourly))
    return clean.rate_of_change_filter(checked, t.cfg).select(
        "house_alias", "hour_start", "roc_nulled", r("oat_f").alias("oat_f"))


@check("long_gap_flag", query("SELECT house_alias, hour_start, gap_hour FROM gaps", "gaps"))
def _(t: Inputs):
    return clean.interpolate_linear(t.gridded, t.cfg).select("house_alias", "hour_start", "gap_hour")


@check("interpolate_linear", query(
    f"SELECT house_alias, hour_start, {rsql(*Q.CHANNELS)}, {ZONES_SQL}, n_filled FROM filled", "filled"))
def _(t: Inputs):
    out = clean.interpolate_linear(t.gridded, t.cfg)
    return flat_zones(rounded(out, *FILLED_CHANNELS)).select(
        "house_alias", "hour_start", *Q.CHANNELS, *ZONES, "n_filled")


def _means(t: Inputs) -> DataFrame:
    return clean.rolling_means(clean.interpolate_linear(t.gridded, t.cfg), t.cfg)


@check("oat_avg_4h", query(f"SELECT house_alias, hour_start, {S('oat4')} AS oat_avg FROM means", "means"))
def _(t: Inputs):
    return _means(t).select("house_alias", "hour_start", r("OAT_avg_4h").alias("oat_avg"))


@check("load_avg_4h", query(f"SELECT house_alias, hour_start, {S('load4')} AS load_avg FROM means", "means"))
def _(t: Inputs):
    return _means(t).select("house_alias", "hour_start", r("dist_kwh_avg_4h").alias("load_avg"))


@check("previous_load", query(
    f"SELECT house_alias, hour_start, {S('prev')} AS previous_dist_kwh FROM feat", "feat"))
def _(t: Inputs):
    return t.features.select("house_alias", "hour_start", r("previous_dist_kwh").alias("previous_dist_kwh"))


_W7 = "OVER (PARTITION BY house_alias ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@check("trailing_days_window", query(
    f"SELECT house_alias, 7 AS n, CAST(day AS VARCHAR) AS fit_day, CAST(min(day) {_W7} AS VARCHAR) AS first_day, "
    f"{S(f'sum(m_hp) {_W7}')} AS hp, {S(f'sum(m_dt_y) {_W7}', 4)} AS dt_y, CAST(sum(m_one_one) {_W7} AS BIGINT) AS n_hours "
    "FROM mom", "mom"))
def _(t: Inputs):
    windows = B.trailing_days_window(R.ols_moments(t.features, t.cfg), 7, t.cfg)
    return windows.select(
        "house_alias", "n", F.col("fit_day").cast("string").alias("fit_day"),
        F.col("first_day").cast("string").alias("first_day"), r("sum__hp").alias("hp"),
        r("sum__deltaT__dist_kwh", 4).alias("dt_y"), F.col("sum__one__one").cast("bigint").alias("n_hours"))


@check("refit_schedule", query("SELECT house_alias, n, CAST(fit_day AS VARCHAR) AS fit_day FROM sched", "sched"))
def _(t: Inputs):
    days = t.features.select("house_alias", "day").distinct()
    lookbacks = F.explode(F.sequence(F.lit(SWEEP[0]), F.lit(SWEEP[1])))
    return B.refit_schedule(days, lookbacks, t.cfg).withColumn("fit_day", F.col("fit_day").cast("string"))


@check("coef_lag_diff", Q.one_lookback(LOOKBACK, 
    "SELECT house_alias, n, CAST(fit_day AS VARCHAR) AS fit_day, main_b1 AS coefficient, "
    f"{S('main_b1 - lag(main_b1) OVER (PARTITION BY house_alias, n ORDER BY fit_day)')} AS change FROM fit_bt "
    f"WHERE n = {LOOKBACK}", "fit_bt"))
def _(t: Inputs):
    fits = P.backtest_fits(t.staged_features, LOOKBACK, t.cfg)
    out = rounded(sweep.coef_lag_diff(fits), "change")
    return out.withColumn("fit_day", F.col("fit_day").cast("string"))


_POINTS_SQL = (f"SELECT house_alias, origin, lead, hour_start, {{0}} AS predicted, {S('actual')} AS actual "
               f"FROM points WHERE n = {LOOKBACK}")


@check("recursive_forecast", Q.one_lookback(LOOKBACK, _POINTS_SQL.format(S("predicted")), "points"))
def _(t: Inputs):
    return rounded(t.backtest.points, "predicted", "actual").select(
        "house_alias", "origin", "lead", "hour_start", "predicted", "actual")


@check("baseline_forecast", Q.one_lookback(LOOKBACK, _POINTS_SQL.format(S("predicted_baseline")), "points"))
def _(t: Inputs):
    points = t.backtest.points.drop("predicted").withColumnRenamed("predicted_baseline", "predicted")
    return rounded(points, "predicted", "actual").select(
        "house_alias", "origin", "lead", "hour_start", "predicted", "actual")


# ---------------------------------------------------------------------------
# sorts, limits, top-k
# ---------------------------------------------------------------------------

@check("order_by_hour", query(
    f"SELECT house_alias, hour_start, {S('dist_kwh')} AS dist_kwh FROM h ORDER BY house_alias, hour_start", "h"))
def _(t: Inputs):
    rows = t.hourly.select("house_alias", "hour_start", r("dist_kwh").alias("dist_kwh"))
    return rows.orderBy("house_alias", "hour_start")


@check("last_n_days", query(f"SELECT house_alias, CAST(day AS VARCHAR) AS day FROM {_RECENT_SQL}", "feat"))
def _(t: Inputs):
    days = R.last_n_days(t.features.select("house_alias", "day").distinct(), 7)
    return days.select("house_alias", F.col("day").cast("string").alias("day"))


@check("topk_heatcall", query(
    f"SELECT house_alias, hour_start, {S('max_hc')} AS max_zone_heatcall, CAST(row_number() OVER (PARTITION BY house_alias "
    "ORDER BY max_hc DESC, hour_start) AS INTEGER) AS place FROM rw QUALIFY place <= 20", "rw"))
def _(t: Inputs):
    top = rswt.topk_heatcall(t.rswt_rows, t.cfg.band_min_rows)
    return rounded(top, "max_zone_heatcall").select("house_alias", "hour_start", "max_zone_heatcall", "place")


# ---------------------------------------------------------------------------
# cleaning rules
# ---------------------------------------------------------------------------

@check("clamp_small_negative_hp", query(
    f"SELECT house_alias, hour_start, {S('hp_kwh_th')} AS hp_kwh_th FROM clamped", "clamped"))
def _(t: Inputs):
    return clean.clamp_small_negative_hp(t.hourly).select("house_alias", "hour_start", r("hp_kwh_th").alias("hp_kwh_th"))


@check("valid_range_filter", query(
    f"SELECT house_alias, hour_start, n_out_of_range, {rsql(*_HOURLY_NUMBERS)}, {ZONES_SQL} FROM ranged", "ranged"))
def _(t: Inputs):
    out = clean.valid_range_filter(clean.clamp_small_negative_hp(t.hourly))
    return flat_zones(rounded(out, *_HOURLY_NUMBERS)).select(
        "house_alias", "hour_start", "n_out_of_range", *_HOURLY_NUMBERS, *ZONES)


@check("clean_audit", query(
    "SELECT house_alias, hour_start, inserted, gap_hour, n_missing, external_heat, dropped_by FROM audit", "audit"))
def _(t: Inputs):
    return t.audit.select(
        "house_alias", "hour_start", "inserted", "gap_hour", "n_missing", "external_heat", "dropped_by")


def _rule(name: str) -> None:
    @check(f"drop_{name}", query(
        f"SELECT house_alias, hour_start, {rsql(*Q.CHANNELS)} FROM audit WHERE dropped_by = '{name}'", "audit"))
    def _(t: Inputs):
        rows = t.audit.where(F.col("dropped_by") == name)
        return rounded(rows, *FILLED_CHANNELS).select("house_alias", "hour_start", *Q.CHANNELS)


for _name in ("oil_boiler", "below_setpoint", "setpoint_change", "broken_thermostat"):
    _rule(_name)


def _gap_sql(zone: int) -> str:
    gap = "CASE WHEN house_alias = 'h1' THEN 1.0e0 ELSE 0.5e0 END" if zone == 1 else "0.5e0"
    z = f"z{zone}"
    return f"(({z}_hc = 0 AND {z}_set - {z}_temp >= {gap}) OR ({z}_hc > 0.01e0 AND {z}_temp - {z}_set >= {gap}))"


@check("broken_thermostat_gaps", query(
    "SELECT house_alias, hour_start, coalesce(stepped, false) AS after_step, coalesce(early, CASE WHEN coalesce(stepped, false) "
    f"THEN 'setpoint_change' WHEN {_gap_sql(1)} OR (has2 AND {_gap_sql(2)}) THEN 'broken_thermostat' END) AS dropped_by, "
    f"{S('z1_temp - z1_set')} AS z1_above FROM verdict0 LEFT JOIN survivors USING (house_alias, hour_start) "
    "WHERE early IS NULL", "verdict0", "survivors"))
def _(t: Inputs):
    # half a degree, so that the rule drops rows of these data; one degree in a zone of one house
    cfg = t.cfg.with_(thermostat_gap_f=0.5, thermostat_gap_overrides=(("h1", 1, 1.0),))
    late = ("setpoint_change", "broken_thermostat")
    rows = clean.clean_audit(t.hourly, cfg).where(F.col("dropped_by").isNull() | F.col("dropped_by").isin(*late))
    above = r(zone_part(1, "avg_temp") - zone_part(1, "avg_set"))
    return rows.select(
        "house_alias", "hour_start", F.coalesce(F.col("dropped_by") == "setpoint_change", F.lit(False)).alias("after_step"),
        "dropped_by", above.alias("z1_above"))


@check("drop_incomplete_hours", query(
    "SELECT house_alias, hour_start, dropped_by FROM audit WHERE dropped_by IN ('no_rolling_mean', 'long_gap', "
    "'missing_values')", "audit"))
def _(t: Inputs):
    wanted = F.col("dropped_by").isin("no_rolling_mean", "long_gap", "missing_values")
    return t.audit.where(wanted).select("house_alias", "hour_start", "dropped_by")


@check("flag_external_heat", query(
    "SELECT house_alias, hour_start, (hc1 = 0 AND z1_temp - z1_set >= 0.5e0 AND (NOT has2 OR z2_temp <= z1_temp)) "
    "OR (has2 AND hc2 = 0 AND z2_temp - z2_set >= 0.5e0 AND z1_temp <= z2_temp) AS external_heat FROM (SELECT *, "
    "CASE WHEN z1_hc < 0.3e0 THEN 0e0 ELSE z1_hc END AS hc1, CASE WHEN z2_hc < 0.3e0 THEN 0e0 ELSE z2_hc END AS hc2 "
    "FROM clean)", "clean"))
def _(t: Inputs):
    # the data has few hours without any heat call: small shares stand for none
    cfg = t.cfg.with_(external_heat_f=0.5)
    calm = F.transform("zones", lambda z: z.withField(
        "heatcall_fraction", F.when(z["heatcall_fraction"] < 0.3, 0.0).otherwise(z["heatcall_fraction"])))
    rows = clean.cleaned_rows(t.audit).withColumn("zones", calm)
    return rows.select("house_alias", "hour_start", Z.external_heat(cfg).alias("external_heat"))


# ---------------------------------------------------------------------------
# features and prediction
# ---------------------------------------------------------------------------

@check("delta_t", query(f"SELECT house_alias, hour_start, {S('delta_t')} AS delta_t FROM feat", "feat"))
def _(t: Inputs):
    return t.features.select("house_alias", "hour_start", r("deltaT").alias("delta_t"))


@check("wind_features", query(
    f"SELECT house_alias, hour_start, {S('wind_dt')} AS wind_dt, {S('wind_65')} AS wind_65 FROM feat", "feat"))
def _(t: Inputs):
    return t.features.select(
        "house_alias", "hour_start", r("windspeed_times_deltaT").alias("wind_dt"),
        r("windspeed_times_65_minus_oat").alias("wind_65"))


_OCC = HeatConfig(include_occupancy=True)
_OCC_NAMES = _OCC.feature_names[6:]


@check("occupancy_dummies", query(
    "SELECT house_alias, hour_start, " + ", ".join(
        f"CASE WHEN hour(hour_start) = {n.rsplit('_', 1)[1]} AND isodow(hour_start) {'<' if n[:2] == 'wd' else '>='} 6 "
        f"THEN 1e0 ELSE 0e0 END AS {n}" for n in _OCC_NAMES) + " FROM feat", "feat"))
def _(t: Inputs):
    return feat.occupancy_dummies(t.features).select("house_alias", "hour_start", *_OCC_NAMES)


_FEATURE_SQL = {"deltaT": "delta_t", "windspeed_times_deltaT": "wind_dt", "solar_w_m2": "solar_w_m2",
                "previous_dist_kwh": "prev", "OAT_avg_4h": "oat4", "dist_kwh_avg_4h": "load4", "oat_f": "oat_f",
                "windspeed_times_65_minus_oat": "wind_65", "dist_kwh": "dist_kwh", "hp_kwh_th": "hp_kwh_th"}


@check("engineer_features", query(
    "SELECT house_alias, hour_start, " + ", ".join(f"{S(b)} AS {a}" for a, b in _FEATURE_SQL.items()) + " FROM feat", "feat"))
def _(t: Inputs):
    return rounded(t.features, *_FEATURE_SQL).select("house_alias", "hour_start", *_FEATURE_SQL)


@check("predict", query(
    f"SELECT house_alias, hour_start, {rsql('predicted', 'predicted_baseline', 'actual')} FROM ins", "ins"))
def _(t: Inputs):
    features = t.staged_features
    out = R.predict(features, P.energy_params(features, t.cfg), t.cfg)
    return rounded(out, "predicted", "predicted_baseline", "actual").select(
        "house_alias", "hour_start", "predicted", "predicted_baseline", "actual")


@check("rswt_curve", query(
    f"SELECT house_alias, band, n_hours, CASE band WHEN 'load_0_2' THEN 1e0 WHEN 'load_2_4' THEN 3e0 WHEN 'load_4_6' "
    "THEN 5e0 WHEN 'load_6_8' THEN 7e0 ELSE 9e0 END AS mid_load_kwh, CAST(p AS INTEGER) AS point, "
    f"{S('lo + (hi - lo) * p / 99')} AS swt_f, {S('rwt_intercept + rwt_slope * (lo + (hi - lo) * p / 99)')} AS rwt_f "
    "FROM (SELECT *, unnest(range(100)) AS p FROM bands WHERE rwt_slope IS NOT NULL) JOIN (SELECT house_alias, "
    "min(swt_average_f) AS lo, max(swt_average_f) AS hi FROM rw GROUP BY 1) USING (house_alias)", "bands", "rw"))
def _(t: Inputs):
    result = P.rswt_params(t.staged_features, t.cfg)
    return rounded(rswt.rswt_curve(result.rows, result.bands, t.cfg), "swt_f", "rwt_f")


@check("chc_water_line", query(
    f"SELECT house_alias, heatcall_fraction, {S('water_kg_hour_chc * (heatcall_fraction / 0.9e0)')} AS water_kg_hour FROM "
    "(SELECT *, unnest([0e0, 0.9e0]) AS heatcall_fraction FROM chc)", "chc"))
def _(t: Inputs):
    return rounded(rswt.chc_water_line(rswt.chc_water(t.rswt_rows, t.cfg)), "water_kg_hour")


@check("max_zone_heatcall", query(
    f"SELECT house_alias, hour_start, {S('max_hc')} AS max_zone_heatcall FROM rw", "rw"))
def _(t: Inputs):
    return t.rswt_rows.select("house_alias", "hour_start", r("max_zone_heatcall").alias("max_zone_heatcall"))
