"""Building blocks of the DuckDB check queries: one named CTE each, with its needs.

Written apart from the Spark code and on purpose in another style (wide columns, joins,
recursive queries, elimination written out), so that agreement means something.
"""

from __future__ import annotations

CHANNELS = ["oat_f", "ws_mph", "solar_w_m2", "dist_kwh", "hp_kwh_th", "oil_boiler_pwr"]
ZONE1 = ["z1_set", "z1_temp", "z1_hc"]
ZONE2 = ["z2_set", "z2_temp", "z2_hc"]
OPTIONAL = ["swt_average_f", "rwt_average_f", "dist_water_kg"]
RANGES = {
    "oat_f": (-128, 134), "ws_mph": (0, 254), "solar_w_m2": (0, 1361), "dist_kwh": (0, 25),
    "hp_kwh_th": (0, 25), "swt_average_f": (40, 200), "rwt_average_f": (40, 200),
    "dist_water_kg": (0, 2271), "z1_set": (40, 90), "z1_temp": (40, 90), "z1_hc": (0, 1),
    "z2_set": (40, 90), "z2_temp": (40, 90), "z2_hc": (0, 1),
}
TZ = "'America/New_York'"
START_UTC = "TIMESTAMP '2023-12-31 05:00:00'"


def S(x: str, digits: int = 6) -> str:
    """Round half up after snapping to nine decimals."""
    return f"CAST(round(CAST({x} AS DECIMAL(34,9)), {digits}) AS DOUBLE)"


def local_hour(ts: str) -> str:
    return f"date_trunc('hour', ({ts}) AT TIME ZONE 'UTC' AT TIME ZONE {TZ})"


PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], body: str) -> None:
    PARTS[name] = (needs, body)


LOOKBACKS = "range(5, 201)"


def one_lookback(n: int, final: str, *needs: str) -> str:
    """As :func:`query`, with fits and points of a single look-back."""
    return query(final, *needs).replace(LOOKBACKS, f"range({n}, {n + 1})")


def query(final: str, *needs: str) -> str:
    """The final SELECT with every CTE it needs in front, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in PARTS[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final
    ctes = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in order)
    return f"WITH RECURSIVE {ctes}\n{final}"


# --- inputs ----------------------------------------------------------------

part("e", [], """
SELECT user_id // 30 AS house_id, concat('h', CAST(user_id // 30 AS VARCHAR)) AS house_alias, ts,
       event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events""")

part("h0", ["e"], f"""
SELECT house_id, house_alias, date_trunc('hour', ts) AS hour_start, count(*) AS n,
       {S("avg(k)", 9)} AS k_avg,
       {S("avg(value) FILTER (WHERE event_type IN ('view','click','purchase'))", 9)} AS load_raw,
       {S("avg(value) FILTER (WHERE event_type <> 'error')", 9)} AS hp_raw,
       {S("max(value) FILTER (WHERE event_type = 'error')", 9)} AS err_max
FROM e GROUP BY 1, 2, 3""")

_SETPOINT = "CASE WHEN hour(hour_start) BETWEEN 6 AND 21 THEN 68e0 ELSE 66e0 END"
_LEN = "CASE WHEN hour(hour_start) % 4 = 0 THEN 20 WHEN hour(hour_start) % 4 <> 1 THEN 48 END"
part("h", ["h0"], f"""
SELECT house_id, house_alias, hour_start, house_id % 2 = 0 AS has2,
       20e0 + k_avg * 0.5e0 AS oat_f, n * 1.5e0 AS ws_mph,
       CAST(greatest(0, 600 - 100 * abs(hour(hour_start) - 12)) AS DOUBLE) AS solar_w_m2,
       load_raw / 8 AS dist_kwh, hp_raw / 8 * 1.05e0 - 0.05e0 AS hp_kwh_th,
       100e0 + load_raw * 0.5e0 AS swt_average_f,
       90e0 + load_raw * 0.4e0 + k_avg * 0.1e0 AS rwt_average_f,
       400e0 + load_raw * 10 AS dist_water_kg, coalesce(err_max, 0e0) / 4 AS oil_boiler_pwr,
       {_SETPOINT} AS z1_set, {_SETPOINT} + (k_avg - 40) / 40 AS z1_temp,
       least(1e0, load_raw / 100) AS z1_hc,
       CASE WHEN house_id % 2 = 0 THEN 67e0 END AS z2_set,
       CASE WHEN house_id % 2 = 0 THEN 67e0 + (k_avg - 45) / 30 END AS z2_temp,
       CASE WHEN house_id % 2 = 0 THEN least(1e0, hp_raw / 90) END AS z2_hc,
       {_LEN} AS fc_len
FROM h0""")

part("r1s", ["e"], """
SELECT house_alias, t0 + to_seconds(i) AS ts, r.c AS channel_name, r.u AS unit, CAST(r.v AS DOUBLE) AS value FROM (
  SELECT house_alias, date_trunc('second', ts) AS t0, i,
    unnest([
      {'c': 'dist-flow', 'u': 'GpmTimes100', 'v': CASE WHEN i < k % 25 THEN 0e0 ELSE 100e0 + k END},
      {'c': 'primary-flow', 'u': 'GpmTimes100', 'v': 200e0 + k},
      {'c': 'dist-swt', 'u': 'WaterTempCTimes1000', 'v': 40000 + value * 10},
      {'c': 'dist-rwt', 'u': 'WaterTempCTimes1000', 'v': 35000 + value * 8},
      {'c': 'hp-lwt', 'u': 'WaterTempCTimes1000', 'v': 45000 + value * 10},
      {'c': 'hp-ewt', 'u': 'WaterTempCTimes1000', 'v': 41000 + value * 9}]) AS r
  FROM (SELECT *, unnest(range(40)) AS i FROM e))""")

# a small table of the channels read: column, channel, unit and what one of the unit's steps is
part("sensor", [], """
SELECT * FROM (VALUES
  ('dist_flow_gpm', 'dist-flow', 'GpmTimes100', 100), ('dist_rwt_c', 'dist-rwt', 'WaterTempCTimes1000', 1000),
  ('dist_swt_c', 'dist-swt', 'WaterTempCTimes1000', 1000), ('hp_ewt_c', 'hp-ewt', 'WaterTempCTimes1000', 1000),
  ('hp_lwt_c', 'hp-lwt', 'WaterTempCTimes1000', 1000), ('primary_flow_gpm', 'primary-flow', 'GpmTimes100', 100)
) AS t(quantity, channel_name, unit, steps)""")
part("decoded", ["r1s", "sensor"], """
SELECT r.house_alias, r.ts, s.quantity, avg(r.value) / any_value(s.steps) AS x
FROM r1s r JOIN sensor s USING (channel_name, unit) GROUP BY 1, 2, 3""")
part("sec", ["decoded"], """
SELECT house_alias, ts, x['dist_flow_gpm'] AS dist_flow_gpm, x['dist_rwt_c'] AS dist_rwt_c, x['dist_swt_c'] AS dist_swt_c,
       x['hp_ewt_c'] AS hp_ewt_c, x['hp_lwt_c'] AS hp_lwt_c, x['primary_flow_gpm'] AS primary_flow_gpm
FROM (SELECT house_alias, ts, map(list(quantity), list(x)) AS x FROM decoded GROUP BY 1, 2)""")

# heat of water: a gallon a minute weighs 500 lb an hour, a degree Celsius is 1.8 BTU a pound, 3410 BTU an hour are a kW
KW_PER_GPM_AND_DEGREE = 500 * 1.8 / 3410
part("kw", ["sec"], f"""
SELECT *, {KW_PER_GPM_AND_DEGREE!r} * dist_flow_gpm * (dist_swt_c - dist_rwt_c) AS dist_kw,
       {KW_PER_GPM_AND_DEGREE!r} * primary_flow_gpm * (hp_lwt_c - hp_ewt_c) AS hp_kw FROM sec""")

# runs of flowing seconds: a run starts where the second before is missing, and is numbered by the starts so far
part("flowing", ["sec"], f"""
SELECT *, CAST(floor(date_diff('second', {START_UTC} AT TIME ZONE 'UTC' AT TIME ZONE {TZ},
       ts AT TIME ZONE 'UTC' AT TIME ZONE {TZ}) / 432000.0) AS BIGINT) AS batch
FROM sec WHERE dist_flow_gpm > 0""")
part("run", ["flowing"], """
SELECT *, sum(starts) OVER (PARTITION BY house_alias, batch ORDER BY ts) AS run_number FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY house_alias, batch ORDER BY ts) = ts - INTERVAL 1 SECOND THEN 0 ELSE 1 END AS starts
  FROM flowing)""")
part("seg", ["run"], """
SELECT *, first_value(ts) OVER (PARTITION BY house_alias, batch, run_number ORDER BY ts) AS seg_start FROM run""")

part("energy_h", ["kw"], f"""
SELECT house_alias, {local_hour('ts')} AS hour_start,
  coalesce({S('avg(dist_kw)', 2)}, 0e0) AS dist_kwh, coalesce({S('avg(hp_kw)', 2)}, 0e0) AS hp_kwh_th
FROM kw GROUP BY 1, 2""")
part("water_h", ["sec"], f"""
SELECT house_alias, {local_hour('ts')} AS hour_start,
  {S('sum(dist_flow_gpm) * 3.785411784e0 / 60', 2)} AS dist_water_kg FROM sec GROUP BY 1, 2""")
part("flowt_h", ["seg"], f"""
SELECT house_alias, {local_hour('ts')} AS hour_start,
  {S('avg(dist_swt_c) * 9 / 5 + 32', 2)} AS swt_average_f, {S('avg(dist_rwt_c) * 9 / 5 + 32', 2)} AS rwt_average_f
FROM seg WHERE ts >= seg_start + INTERVAL 30 SECOND GROUP BY 1, 2""")

part("chan", [], """
SELECT * FROM (VALUES ('view', 0, 'zone1-down-temp', 'AirTempFTimes1000'),
  ('click', 1, 'zone1-down-set', 'AirTempFTimes1000'), ('purchase', 2, 'zone1-down-heat-call', 'Binary'),
  ('signup', 3, 'zone1-up-temp', 'AirTempFTimes1000'), ('error', 4, 'oil-boiler-pwr', 'PowerW')
) AS c(event_type, pos, channel_name, unit)""")
part("named", ["e", "chan"], """
SELECT house_alias, house_id * 10 + pos AS channel_id, channel_name, unit, ts,
  CASE WHEN e.event_type IN ('view','signup') THEN 66000e0 + k * 50
       WHEN e.event_type = 'click' THEN CASE WHEN k > 50 THEN 68000e0 ELSE 66000e0 END
       WHEN e.event_type = 'purchase' THEN CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END
       ELSE value END AS value
FROM e JOIN chan USING (event_type)""")
part("tw", ["named"], f"""
SELECT house_alias, channel_name, unit, hour_start,
  CASE WHEN max(t) > min(t) THEN sum(value * dt) / (max(t) - min(t)) END AS avg_value
FROM (SELECT *, lead(t) OVER (PARTITION BY house_alias, channel_name, unit, hour_start ORDER BY t) - t AS dt
      FROM (SELECT house_alias, channel_name, unit, {local_hour('ts')} AS hour_start, epoch_us(ts) AS t,
                   min(value) AS value FROM named GROUP BY 1, 2, 3, 4, 5))
GROUP BY 1, 2, 3, 4""")
part("oil_h", ["tw"], f"""
SELECT house_alias, hour_start, coalesce({S('avg_value', 1)}, 0e0) AS oil_boiler_pwr
FROM tw WHERE channel_name = 'oil-boiler-pwr' AND unit = 'PowerW'""")
part("zone_h", ["tw"], f"""
SELECT house_alias, hour_start, zone, {S("avg(v) FILTER (WHERE kind = 'set')", 1)} AS avg_set,
  {S("avg(v) FILTER (WHERE kind = 'temp')", 1)} AS avg_temp,
  {S("avg(v) FILTER (WHERE kind = 'heat-call')", 2)} AS heatcall_fraction
FROM (SELECT house_alias, hour_start, CAST(regexp_extract(channel_name, '^zone([0-9]+)-', 1) AS INTEGER) AS zone,
        regexp_extract(channel_name, '(temp|set|heat-call)$', 1) AS kind,
        CASE WHEN channel_name LIKE '%heat-call' THEN {S('avg_value', 2)}
             WHEN unit = 'AirTempFTimes1000' THEN {S('avg_value / 1000', 1)} ELSE {S('avg_value', 1)} END AS v
      FROM tw WHERE regexp_matches(channel_name, '^zone[0-9]+-.+-(temp|set|heat-call)$')
        AND channel_name NOT ILIKE '%gw-temp%')
GROUP BY 1, 2, 3""")

part("fc", ["e"], f"""
SELECT house_alias, local_ts, min(ts) AS ts, arg_min(k, ts) AS k FROM (
  SELECT house_alias, ts, ts AT TIME ZONE 'UTC' AT TIME ZONE {TZ} AS local_ts, k
  FROM e WHERE event_type = 'view' AND k % 10 <> 0)
GROUP BY 1, 2""")
part("fcv", ["fc"], f"""
SELECT *, CASE WHEN k % 3 = 0 THEN 20 ELSE 48 END AS len FROM fc""")


def oat_at(i: str) -> str:
    return f"CASE WHEN {i} < len THEN {S(f'20 + k * 0.5e0 + {i} * 0.25e0', 1)} END"


def wind_at(i: str) -> str:
    return f"CASE WHEN {i} < len THEN {S(f'(k % 20) + {i} * 0.5e0', 1)} END"


def asof(hours: str, name: str, needs: list[str]) -> None:
    part(name, [*needs, "fcv"], f"""
SELECT q.house_alias, q.hour_start, f.local_ts, f.k, f.len FROM
  (SELECT DISTINCT house_alias, hour_start FROM {hours}) q
  ASOF LEFT JOIN fcv f ON q.house_alias = f.house_alias AND q.hour_start >= f.local_ts""")


asof("h", "asof_h", ["h"])

# --- merged hourly table ---------------------------------------------------

part("houses", ["e"], "SELECT DISTINCT house_alias FROM e")
part("skel", ["houses"], """
SELECT house_alias, unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-01-31 23:00:00',
  INTERVAL 1 HOUR)) AS hour_start FROM houses""")
part("keys", ["skel", "energy_h", "water_h", "flowt_h", "oil_h", "zone_h"], """
SELECT house_alias, hour_start FROM skel UNION SELECT house_alias, hour_start FROM energy_h
UNION SELECT house_alias, hour_start FROM oil_h UNION SELECT house_alias, hour_start FROM zone_h""")
asof("keys", "asof_keys", ["keys"])
part("merged", ["keys", "asof_keys"], f"""
SELECT q.house_alias, q.hour_start, a.len IS NOT NULL AS has_forecast, {oat_at('0')} AS oat_f, {wind_at('0')} AS ws_mph,
  {oat_at('47')} AS oat_47, e.dist_kwh, e.hp_kwh_th, t.swt_average_f, t.rwt_average_f, w.dist_water_kg, o.oil_boiler_pwr,
  z.zone, z.avg_set, z.avg_temp, z.heatcall_fraction
FROM keys q LEFT JOIN energy_h e USING (house_alias, hour_start)
LEFT JOIN flowt_h t USING (house_alias, hour_start) LEFT JOIN water_h w USING (house_alias, hour_start)
LEFT JOIN oil_h o USING (house_alias, hour_start) LEFT JOIN zone_h z USING (house_alias, hour_start)
LEFT JOIN asof_keys a USING (house_alias, hour_start)""")

# --- cleaning --------------------------------------------------------------


def _in_range(c: str) -> str:
    low, high = RANGES[c]
    return f"({c} BETWEEN {low} AND {high})"


_RANGED = list(RANGES)
part("clamped", ["h"], """
SELECT * REPLACE (CASE WHEN hp_kwh_th BETWEEN -1 AND 0 THEN 0e0 ELSE hp_kwh_th END AS hp_kwh_th) FROM h""")
part("ranged", ["clamped"], "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {_in_range(c)} THEN {c} END AS {c}" for c in _RANGED) + "), " + " + ".join(
    f"coalesce(CAST(NOT {_in_range(c)} AS INTEGER), 0)" for c in _RANGED) + " AS n_out_of_range FROM clamped")
part("roc", ["ranged"], """
SELECT * REPLACE (CASE WHEN NOT jump THEN oat_f END AS oat_f) FROM (
  SELECT *, coalesce(abs(oat_f - lag(oat_f) OVER (PARTITION BY house_alias ORDER BY hour_start)) > 25, false) AS jump
  FROM ranged)""")
part("span", ["h"], """
SELECT house_id, house_alias, has2, min(hour_start) AS g0, max(hour_start) AS g1 FROM h GROUP BY 1, 2, 3""")
_KEPT = [*CHANNELS, *ZONE1, *ZONE2, *OPTIONAL]
part("grid", ["span", "roc"], f"""
SELECT g.house_id, g.house_alias, g.has2, g.g0, g.g1, g.hour_start, r.hour_start IS NULL AS inserted,
  r.n_out_of_range, r.jump, r.fc_len, h.oat_f AS raw_oat, h.ws_mph AS raw_ws, {', '.join('r.' + c for c in _KEPT)}
FROM (SELECT *, unnest(generate_series(g0, g1, INTERVAL 1 HOUR)) AS hour_start FROM span) g
LEFT JOIN roc r ON r.house_alias = g.house_alias AND r.hour_start = g.hour_start
LEFT JOIN h ON h.house_alias = g.house_alias AND h.hour_start = g.hour_start""")
PARTS["grid"][0].append("h")

_FILLED = [*CHANNELS, *ZONE1, *ZONE2]
_W = "OVER (PARTITION BY house_alias ORDER BY hour_start ROWS BETWEEN {})"
_BACK = _W.format("UNBOUNDED PRECEDING AND CURRENT ROW")
_AHEAD = _W.format("CURRENT ROW AND UNBOUNDED FOLLOWING")
part("near", ["grid"], "SELECT *, " + ", ".join(
    f"last_value({c} IGNORE NULLS) {_BACK} AS {c}_v0, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN hour_start END IGNORE NULLS) {_BACK} AS {c}_h0, "
    f"first_value({c} IGNORE NULLS) {_AHEAD} AS {c}_v1, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN hour_start END IGNORE NULLS) {_AHEAD} AS {c}_h1"
    for c in _FILLED) + " FROM grid")


def _run(c: str) -> str:
    return (f"(date_diff('hour', coalesce({c}_h0, g0 - INTERVAL 1 HOUR), coalesce({c}_h1, g1 + INTERVAL 1 HOUR)) - 1)")


def _long(c: str) -> str:
    own = f"({c} IS NULL AND {_run(c)} >= 4)"
    return f"(has2 AND {own})" if c in ZONE2 else own


def _fill(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_h1 IS NULL THEN {c}_v0 ELSE {c}_v0 + ({c}_v1 - {c}_v0) * "
            f"(date_diff('hour', {c}_h0, hour_start) / date_diff('hour', {c}_h0, {c}_h1)) END")


part("gaps", ["near"], "SELECT *, " + " OR ".join(_long(c) for c in _FILLED) + " AS gap_hour FROM near")
part("filled", ["gaps"], "SELECT * REPLACE (" + ", ".join(
    f"{_fill(c)} AS {c}" if c == "oat_f" else f"CASE WHEN gap_hour THEN {c} ELSE {_fill(c)} END AS {c}"
    for c in _FILLED) + "), oat_f IS NOT NULL AS oat_seen, dist_kwh IS NOT NULL AS load_seen, " + " + ".join(
    (f"CAST({'has2 AND ' if c in ZONE2 else ''}{c} IS NULL AND ({_fill(c)}) IS NOT NULL"
     f"{'' if c == 'oat_f' else ' AND NOT gap_hour'} AS INTEGER)") for c in _FILLED) + " AS n_filled FROM gaps")
_W4 = "OVER (PARTITION BY house_alias ORDER BY hour_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"
_LAG = "lag({}, {}) OVER (PARTITION BY house_alias ORDER BY hour_start)"
part("means", ["filled"], f"""
SELECT *, CASE WHEN count(oat_f) {_W4} = 4 AND {_LAG.format('oat_seen', 4)} AND {_LAG.format('oat_seen', 1)}
            THEN avg(oat_f) {_W4} END AS oat4,
  CASE WHEN sum(CAST(load_seen AS INTEGER)) {_W4} = 4 THEN avg(dist_kwh) {_W4} END AS load4
FROM filled""")
part("verdict0", ["means"], "SELECT *, " + " + ".join(
    f"CAST({'has2 AND ' if c in ZONE2 else ''}{c} IS NULL AS INTEGER)" for c in _FILLED) + """ AS n_missing,
  CASE WHEN oat4 IS NULL OR load4 IS NULL THEN 'no_rolling_mean' WHEN gap_hour THEN 'long_gap'
       WHEN n_missing > 0 THEN 'missing_values' WHEN oil_boiler_pwr > 50 THEN 'oil_boiler'
       WHEN z1_set - z1_temp >= 1 OR (has2 AND z2_set - z2_temp >= 1) THEN 'below_setpoint' END AS early
FROM means""")
part("survivors", ["verdict0"], """
SELECT house_alias, hour_start,
  lag(hour_start) OVER w = hour_start - INTERVAL 1 HOUR
    AND (lag(z1_set) OVER w <> z1_set OR coalesce(lag(z2_set) OVER w <> z2_set, false)) AS stepped
FROM verdict0 WHERE early IS NULL WINDOW w AS (PARTITION BY house_alias ORDER BY hour_start)""")


def _broken(z: str) -> str:
    return (f"(({z}_hc = 0 AND {z}_set - {z}_temp >= 3) OR ({z}_hc > 0.01e0 AND {z}_temp - {z}_set >= 3))")


part("audit", ["verdict0", "survivors"], f"""
SELECT v.*, coalesce(s.stepped, false) AS stepped,
  coalesce((z1_hc = 0 AND z1_temp - z1_set >= 3 AND (NOT has2 OR coalesce(z2_temp <= z1_temp, true)))
    OR (has2 AND z2_hc = 0 AND z2_temp - z2_set >= 3 AND coalesce(z1_temp <= z2_temp, true)), false) AS external_heat,
  coalesce(early, CASE WHEN coalesce(s.stepped, false) THEN 'setpoint_change'
    WHEN {_broken('z1')} OR (has2 AND {_broken('z2')}) THEN 'broken_thermostat' END) AS dropped_by
FROM verdict0 v LEFT JOIN survivors s USING (house_alias, hour_start)""")
part("clean", ["audit"], "SELECT * FROM audit WHERE dropped_by IS NULL")

# --- features --------------------------------------------------------------

part("feat", ["clean"], """
SELECT *, ws_mph * delta_t AS wind_dt, ws_mph * (65e0 - oat_f) AS wind_65, CAST(hour_start AS DATE) AS day,
  row_number() OVER (PARTITION BY house_alias ORDER BY hour_start) AS rn,
  count(*) OVER (PARTITION BY house_alias) AS total
FROM (SELECT *, greatest(0e0, temp_avg - oat_f) AS delta_t FROM (
  SELECT *, CASE WHEN has2 THEN (z1_temp + z2_temp) / 2 ELSE z1_temp END AS temp_avg,
    lag(dist_kwh) OVER w AS prev, row_number() OVER w AS r0,
    CASE WHEN has2 THEN greatest(z1_hc, z2_hc) ELSE z1_hc END AS max_hc
  FROM clean WINDOW w AS (PARTITION BY house_alias ORDER BY hour_start)) WHERE r0 > 1)""")

# --- regression ------------------------------------------------------------

TERMS = {"one": "1e0", "dt": "delta_t", "wdt": "wind_dt", "sol": "solar_w_m2", "prev": "prev", "oat4": "oat4",
         "load4": "load4", "y": "dist_kwh", "oat": "oat_f", "w65": "wind_65"}
MAIN = ["one", "dt", "wdt", "sol", "prev", "oat4", "load4"]
BASE = ["one", "oat", "w65"]
_SCALED = {"prev", "load4", "y"}
MOMENTS = list(dict.fromkeys(
    (a, b) for terms in ([*MAIN, "y"], [*BASE, "y"]) for i, a in enumerate(terms) for b in terms[i:]))

part("mom", ["feat"], "SELECT house_alias, day, " + ", ".join(
    f"sum(({TERMS[a]}) * ({TERMS[b]})) AS m_{a}_{b}" for a, b in MOMENTS) +
    ", sum(hp_kwh_th) AS m_hp, row_number() OVER (PARTITION BY house_alias ORDER BY day) AS idx"
    " FROM feat GROUP BY 1, 2")
_SUMS = ", ".join([f"sum(m.m_{a}_{b}) AS m_{a}_{b}" for a, b in MOMENTS] + ["sum(m.m_hp) AS m_hp"])


def moment(a: str, b: str) -> str:
    return f"m_{a}_{b}" if (a, b) in MOMENTS else f"m_{b}_{a}"


def fit(win: str, tag: str, needs: list[str], keys: str) -> None:
    """CTEs ``{tag}`` with rounded coefficients, errors, R squared and ratio per window."""
    ratio = f"{tag}_r"
    part(ratio, needs, f"SELECT *, m_hp / m_one_y AS ratio FROM {win}")
    for kind, terms in (("main", MAIN), ("base", BASE)):
        p = len(terms)
        d = lambda t: "ratio" if t in _SCALED else "1"
        g = lambda a, b: f"({moment(a, b)} * {d(a)} * {d(b)})"
        size = lambda t: f"sqrt({g(t, t)})"
        first = []
        for i, a in enumerate(terms):
            first += [f"{g(a, b)} / ({size(a)} * {size(b)}) AS a_{i}_{j}" for j, b in enumerate(terms)]
            first.append(f"{g(a, 'y')} / {size(a)} AS a_{i}_{p}")
            first += [f"{'1e0' if i == j else '0e0'} AS a_{i}_{p + 1 + j}" for j in range(p)]
        part(f"{tag}_{kind}_0", [ratio], f"SELECT *, {', '.join(first)} FROM {ratio}")
        width = 2 * p + 1
        for k in range(p):
            cols = []
            for i in range(p):
                for j in range(width):
                    cols.append(
                        f"a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" if i == k
                        else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}")
            part(f"{tag}_{kind}_{k + 1}", [f"{tag}_{kind}_{k}"],
                 f"SELECT * REPLACE ({', '.join(cols)}) FROM {tag}_{kind}_{k}")
        coef = [f"(a_{i}_{p} / {size(t)})" for i, t in enumerate(terms)]
        ssr = f"({g('y', 'y')} - " + " - ".join(f"{c} * {g(t, 'y')}" for c, t in zip(coef, terms)) + ")"
        sst = f"({g('y', 'y')} - {g('one', 'y')} * {g('one', 'y')} / m_one_one)"
        out = [f"{S(c)} AS {kind}_b{i}" for i, c in enumerate(coef)]
        out += [
            f"{S(f'sqrt({ssr} / greatest(m_one_one - {p}, 1) * a_{i}_{p + 1 + i} / {g(t, t)})')} AS {kind}_se{i}"
            for i, t in enumerate(terms)]
        out.append(f"{S(f'1 - {ssr} / {sst}', 3)} AS {kind}_r2")
        part(f"{tag}_{kind}", [f"{tag}_{kind}_{p}"],
             f"SELECT {keys}, CAST(m_one_one AS BIGINT) AS n_hours, {S('ratio', 3)} AS energy_ratio, "
             f"{', '.join(out)} FROM {tag}_{kind}_{p}")
    part(tag, [f"{tag}_main", f"{tag}_base"],
         f"SELECT * FROM {tag}_main JOIN {tag}_base USING ({keys}, n_hours, energy_ratio)")


part("win_all", ["mom"], f"SELECT house_alias, count(*) AS n_days, {_SUMS} FROM mom m GROUP BY 1")
fit("win_all", "fit_all", ["win_all"], "house_alias, n_days")

# refit days: the greedy seven-day rule as a recursive query
part("lookbacks", [], f"SELECT CAST(unnest({LOOKBACKS}) AS INTEGER) AS n")
part("sched", ["mom", "lookbacks"], """
SELECT l.n, m.house_alias, m.day AS fit_day, m.idx FROM mom m JOIN lookbacks l ON m.idx = l.n
UNION ALL
SELECT n, house_alias, x.day, x.idx FROM (
  SELECT s.n, s.house_alias, min({'day': m.day, 'idx': m.idx}) AS x FROM sched s
  JOIN mom m ON m.house_alias = s.house_alias AND m.day >= s.fit_day + 7 GROUP BY s.n, s.house_alias, s.fit_day)""")
part("win_bt", ["sched", "mom"], f"""
SELECT s.house_alias, s.n, s.fit_day, min(m.day) AS first_day, {_SUMS}
FROM sched s JOIN mom m ON m.house_alias = s.house_alias AND m.idx > s.idx - s.n AND m.idx <= s.idx GROUP BY 1, 2, 3""")
fit("win_bt", "fit_bt", ["win_bt"], "house_alias, n, fit_day")
part("fits", ["fit_bt"], """
SELECT *, lead(fit_day) OVER (PARTITION BY house_alias, n ORDER BY fit_day) AS next_fit_day FROM fit_bt""")

# forecasts: every origin joined to its 48 target rows, recursion over the step number
part("steps", ["feat"], """
SELECT o.house_alias, o.hour_start AS origin, o.day, o.prev, CAST(t.rn - o.rn AS INTEGER) AS step,
  t.hour_start, t.oat_f AS seen_oat, t.solar_w_m2, t.oat4, t.load4, t.dist_kwh,
  CASE WHEN t.rn - o.rn < o.fc_len THEN o.raw_oat + ((t.rn - o.rn) % 7) * 0.25e0 END AS f_oat,
  CASE WHEN t.rn - o.rn < o.fc_len THEN o.raw_ws + ((t.rn - o.rn) % 7) * 0.5e0 END AS f_ws,
  coalesce(f_oat, t.oat_f) AS oat, coalesce(f_ws, t.ws_mph) AS ws,
  greatest(0e0, t.temp_avg - oat) AS dt
FROM feat o JOIN feat t ON t.house_alias = o.house_alias AND t.rn BETWEEN o.rn AND o.rn + 47
WHERE o.rn <= o.total - 48""")
part("known", ["steps", "fits"], """
SELECT s.*, f.n, f.fit_day, f.energy_ratio, f.main_b4 AS lag_b,
  f.main_b0 + f.main_b1 * dt + f.main_b2 * (dt * ws) + f.main_b3 * solar_w_m2 + f.main_b5 * oat4
    + f.main_b6 * load4 * f.energy_ratio AS c,
  greatest(0e0, f.base_b0 + f.base_b1 * oat + f.base_b2 * (ws * (65 - oat))) AS predicted_baseline
FROM steps s JOIN fits f ON f.house_alias = s.house_alias AND s.day > f.fit_day
  AND (f.next_fit_day IS NULL OR s.day <= f.next_fit_day)""")
part("rec", ["known"], """
SELECT house_alias, n, origin, step, greatest(0e0, c + lag_b * prev * energy_ratio) AS predicted
FROM known WHERE step = 0
UNION ALL
SELECT k.house_alias, k.n, k.origin, k.step, greatest(0e0, k.c + k.lag_b * r.predicted)
FROM rec r JOIN known k ON k.house_alias = r.house_alias AND k.n = r.n AND k.origin = r.origin AND k.step = r.step + 1""")
part("points", ["rec", "known"], """
SELECT k.house_alias, k.n, k.origin, k.step + 1 AS lead, k.hour_start, k.seen_oat AS oat_f, r.predicted,
  k.predicted_baseline, k.dist_kwh * k.energy_ratio AS actual,
  r.predicted - k.dist_kwh * k.energy_ratio AS e, k.predicted_baseline - k.dist_kwh * k.energy_ratio AS eb
FROM rec r JOIN known k USING (house_alias, n, origin, step)""")

# in-sample predictions of the whole period
part("ins", ["feat", "fit_all"], """
SELECT f.house_alias, f.hour_start,
  greatest(0e0, main_b0 + main_b1 * delta_t + main_b2 * wind_dt + main_b3 * solar_w_m2
    + main_b4 * prev * energy_ratio + main_b5 * oat4 + main_b6 * load4 * energy_ratio) AS predicted,
  greatest(0e0, base_b0 + base_b1 * oat_f + base_b2 * wind_65) AS predicted_baseline,
  dist_kwh * energy_ratio AS actual, predicted - actual AS e, predicted_baseline - actual AS eb
FROM feat f JOIN fit_all USING (house_alias)""")

METRICS = f"""count(*) AS n_points, {S('avg(abs(e))')} AS mae, {S('sqrt(avg(e * e))')} AS rmse,
  {S('avg(abs(eb))')} AS mae_baseline, {S('sqrt(avg(eb * eb))')} AS rmse_baseline,
  {S('(avg(abs(eb)) - avg(abs(e))) / avg(abs(eb)) * 100', 4)} AS mae_gain_pct,
  {S('(sqrt(avg(eb * eb)) - sqrt(avg(e * e))) / sqrt(avg(eb * eb)) * 100', 4)} AS rmse_gain_pct"""

# --- return water ----------------------------------------------------------

part("rw", ["feat"], """
SELECT *, CASE WHEN dist_kwh < 2 THEN 'load_0_2' WHEN dist_kwh < 4 THEN 'load_2_4' WHEN dist_kwh < 6 THEN 'load_4_6'
  WHEN dist_kwh < 8 THEN 'load_6_8' ELSE 'load_8_plus' END AS band
FROM feat WHERE swt_average_f IS NOT NULL AND rwt_average_f IS NOT NULL""")
part("bands", ["rw"], f"""
SELECT house_alias, band, count(*) AS n_hours,
  CASE WHEN count(*) >= 20 THEN {S('regr_intercept(rwt_average_f, swt_average_f)')} END AS rwt_intercept,
  CASE WHEN count(*) >= 20 THEN {S('regr_slope(rwt_average_f, swt_average_f)')} END AS rwt_slope
FROM rw GROUP BY 1, 2""")
part("chc", ["rw"], f"""
SELECT house_alias, {S('avg(dist_water_kg)', 2)} AS water_kg_hour_chc, count(dist_water_kg) AS n_hours,
  min(max_hc) AS min_heatcall, max(max_hc) AS max_heatcall, max(pool) AS pool
FROM (
  SELECT *, CASE WHEN n_above >= 20 THEN 'above_threshold' WHEN n_floor >= least(20, n_all) THEN 'above_floor'
    ELSE 'all_hours' END AS pool,
    row_number() OVER (PARTITION BY house_alias ORDER BY pool = 'above_floor' AND max_hc < 0.7e0, max_hc DESC, hour_start) AS place
  FROM (SELECT *, count(*) FILTER (WHERE max_hc > 0.8e0) OVER (PARTITION BY house_alias) AS n_above,
          count(*) FILTER (WHERE max_hc >= 0.7e0) OVER (PARTITION BY house_alias) AS n_floor,
          count(*) OVER (PARTITION BY house_alias) AS n_all FROM rw))
WHERE CASE WHEN n_above >= 20 THEN max_hc > 0.8e0 ELSE place <= 20 END GROUP BY 1""")
