"""One-second telemetry to hourly energy, water and flow temperatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import FLOW_UNIT, KG_PER_US_GALLON, WATER_TEMP_UNIT, HeatConfig
from hearthline.functions.clock import epoch_micros, hour_of, local_hour, local_time
from hearthline.functions.numbers import celsius_to_f, settle, thermal_power_kw
from hearthline.session import first_partitions

# output column -> (channel, unit, scale)
SECOND_CHANNELS = {
    "primary_flow_gpm": ("primary-flow", FLOW_UNIT, 100),
    "hp_lwt_c": ("hp-lwt", WATER_TEMP_UNIT, 1000),
    "hp_ewt_c": ("hp-ewt", WATER_TEMP_UNIT, 1000),
    "dist_flow_gpm": ("dist-flow", FLOW_UNIT, 100),
    "dist_swt_c": ("dist-swt", WATER_TEMP_UNIT, 1000),
    "dist_rwt_c": ("dist-rwt", WATER_TEMP_UNIT, 1000),
}
CHANNELS_READ = tuple(channel for channel, _, _ in SECOND_CHANNELS.values())


#: Seconds that :func:`pivot_channels_per_second` shuffles in one row.
LANES = 4
#: Seconds that :func:`second_blocks` puts in one row, and readings that it holds at a time.
BLOCK = 60
COMBINED = 1 << 17
_SECOND = 1_000_000


def _place() -> Column:
    """Number of a reading's channel, null for one in another unit or of another channel."""
    place = F.lit(None).cast("byte")
    for k, (channel, unit, _) in enumerate(SECOND_CHANNELS.values()):
        place = F.when((F.col("channel_name") == channel) & (F.col("unit") == unit), F.lit(k).cast("byte")).otherwise(place)
    return place


def pivot_channels_per_second(readings_1s: DataFrame) -> DataFrame:
    """Channels to columns, one row per house and second.

    Four neighbouring seconds travel as one row, a mean per channel and second: a quarter of the
    groups and keys, and means that resemble each other lie side by side. The aggregate combines on
    the map side, so repeated copies of a second collapse before the shuffle. Instants that are no
    whole seconds differ in ``base`` and stay apart.
    """
    width = len(SECOND_CHANNELS)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # an unknown instant is in the first lane of an unknown base
    lane = F.coalesce(F.expr(f"pmod(micros div {_SECOND}, {LANES})").cast("int"), F.lit(0))
    cells = (
        readings_1s.select("house_alias", "value", micros.alias("micros"), _place().alias("place"))
        .select("house_alias", "value", "micros", "place", lane.alias("lane"))
        .select(
            "house_alias", "value", "lane", (F.col("lane") * width + F.col("place")).alias("cell"),
            (F.col("micros") - F.col("lane") * _SECOND).alias("base"),
        )
    )
    names = {(i, k): f"lane{i}_{name}" for i in range(LANES) for k, name in enumerate(SECOND_CHANNELS)}
    blocks = cells.groupBy("house_alias", "base").agg(
        F.bit_or(F.expr("shiftleft(1, lane)")).alias("known"),
        *[F.avg(F.when(F.col("cell") == i * width + k, F.col("value"))).alias(name) for (i, k), name in names.items()],
    )

    def mean(k: int) -> Column:
        found = F.col(names[LANES - 1, k])
        for i in reversed(range(LANES - 1)):
            found = F.when(F.col("lane") == i, F.col(names[i, k])).otherwise(found)
        return found

    seconds = blocks.select("*", F.explode(F.array(*map(F.lit, range(LANES)))).alias("lane")).where(
        F.expr("known & shiftleft(1, lane)") != 0
    )
    ts = F.timestamp_micros(F.col("base") + F.col("lane") * _SECOND).cast(readings_1s.schema["ts"].dataType)
    return seconds.select(
        "house_alias", ts.alias("ts"),
        *[(mean(k) / scale).alias(name) for k, (name, (_, _, scale)) in enumerate(SECOND_CHANNELS.items())],
    )


def _batch(local: Column, since: Column, cfg: HeatConfig) -> Column:
    """Number of the batch of whole local days after ``since`` (UTC) that a local time is in."""
    first = local_time(since, cfg.timezone)
    return F.floor(F.timestamp_diff("SECOND", first, local) / (cfg.batch_days * 86400))


def _as_column(instant: datetime | Column) -> Column:
    return instant if isinstance(instant, Column) else F.lit(instant).cast("timestamp_ntz")


def _with_segments(per_second: DataFrame, keys: list[str], cfg: HeatConfig) -> DataFrame:
    """Start of the flow run of each second and whether it has lasted long enough, within ``keys``."""
    in_time = Window.partitionBy(*keys).orderBy("ts")
    flowing = F.col("dist_flow_gpm") > 0
    second = F.expr("interval 1 second")
    previous = F.lag(F.when(flowing, F.col("ts"))).over(in_time)
    starts = flowing & (previous.isNull() | (previous != F.col("ts") - second))
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onset = F.expr(f"interval {int(cfg.flow_onset_seconds)} seconds")
    return (
        per_second.withColumn("segment_starts", starts)
        .withColumn(
            "segment_start",
            F.last(F.when(F.col("segment_starts"), F.col("ts")), ignorenulls=True).over(so_far),
        )
        .withColumn(
            "eligible",
            F.coalesce(flowing & (F.col("ts") >= F.col("segment_start") + onset), F.lit(False)),
        )
        .withColumn("segment_start", F.when(flowing, F.col("segment_start")))
        .drop("segment_starts")
    )


def flow_segments(per_second: DataFrame, start: datetime, cfg: HeatConfig) -> DataFrame:
    """Mark the seconds in which distribution water has been flowing long enough.

    A segment is a run of consecutive seconds with positive flow. Its start is carried
    forward inside a (house, batch) window, which holds at most ``batch_days`` times
    86,400 rows however large the fleet or the period is. A run restarts at a batch edge.
    Edges are whole local days after ``start``, so a clock change doesn't move them.
    """
    batch = _batch(local_time(F.col("ts"), cfg.timezone), _as_column(start), cfg)
    return _with_segments(per_second.withColumn("batch", batch), ["house_alias", "batch"], cfg)


def _combine(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Readings to blocks, ``COMBINED`` of them at a time, for ``mapInArrow``."""
    channels, flow_place = len(SECOND_CHANNELS), list(SECOND_CHANNELS).index("dist_flow_gpm")
    names, types = ["at", "flow", "sums", "counts"], [pa.int8(), pa.bool_(), pa.float64(), pa.int32()]

    def blocks_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        timed = np.asarray(rows["micros"].is_valid())
        micros = rows["micros"].fill_null(0).to_numpy()
        lane = np.where(timed, micros // _SECOND % BLOCK, 0)  # an unknown instant is in the first lane of an unknown base
        base = pa.array(micros - lane * _SECOND, mask=~timed)
        block = np.zeros(len(rows), np.int64)
        for column in (base, *(rows[k] for k in keys)):
            code = column.dictionary_encode(null_encoding="encode")
            block = block * len(code.dictionary) + code.indices.to_numpy()
        code = pa.array(block).dictionary_encode()
        block, n_blocks = code.indices.to_numpy(), len(code.dictionary)
        one = np.empty(n_blocks, np.int64)
        one[block] = np.arange(len(rows))  # a row of each block, for its keys

        slot = block.astype(np.int64) * BLOCK + lane
        known = np.zeros(n_blocks * BLOCK, bool)
        known[slot] = True
        second = (np.cumsum(known, dtype=np.int32) - 1)[slot]
        at = np.flatnonzero(known)
        place, value = rows["place"].fill_null(-1).to_numpy(), rows["value"].fill_null(0.0).to_numpy()
        counted = (place >= 0) & np.asarray(rows["value"].is_valid())
        cell = (second.astype(np.int64) * channels + place)[counted]
        flow = np.zeros(len(at), bool)
        flow[second[place == flow_place]] = True
        cells = [
            at % BLOCK, flow, np.bincount(cell, value[counted], len(at) * channels), np.bincount(cell, minlength=len(at) * channels)
        ]
        ends = np.searchsorted(at, np.arange(n_blocks + 1) * BLOCK)
        lists = [
            pa.ListArray.from_arrays(pa.array(ends * (len(x) // len(at)), pa.int32()), pa.array(x.astype(t.to_pandas_dtype()), t))
            for x, t in zip(cells, types, strict=True)
        ]
        owners = [column.take(pa.array(one)) for column in (*(rows[k] for k in keys), base)]
        return pa.RecordBatch.from_arrays([*owners, *lists], [*keys, "base", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= COMBINED:
                yield blocks_of(pa.concat_batches(held))
                held, n = [], 0
        if n:
            yield blocks_of(pa.concat_batches(held))

    return run


def second_blocks(readings_1s: DataFrame, since: datetime | Column) -> DataFrame:
    """Readings combined where they lie: house_alias, since, base, at, flow, sums, counts.

    The seconds of a minute that are read together become one row: ``at`` lists them, ``flow`` says
    whether a second has a reading of the distribution flow, and ``sums`` and ``counts`` hold its
    values, all channels of one second, then of the next. Copies of a second collapse. A reading in
    another unit makes its second known and counts nowhere. Instants that are no whole seconds differ
    in ``base`` and stay apart. A second may be in several rows, whose sums and counts add up.
    """
    keys = ["house_alias"]
    micros = epoch_micros(F.col("ts")).alias("micros")
    columns, schema = ["house_alias", micros, _place().alias("place"), "value"], "house_alias string"
    if isinstance(since, Column):
        keys, schema = [*keys, "since"], f"{schema}, since long"
        columns.append(epoch_micros(since).alias("since"))
    schema += ", base long, at array<tinyint>, flow array<boolean>, sums array<double>, counts array<int>"
    blocks = readings_1s.select(*columns).mapInArrow(_combine(keys), schema)
    count_from = F.timestamp_micros("since").cast("timestamp_ntz") if "since" in keys else _as_column(since)
    return blocks.withColumn("since", count_from)


def _instant(lane: Column) -> Column:
    return F.timestamp_micros(F.col("base") + lane * _SECOND)


def hour_slots(blocks: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Blocks dealt to the local hours (``slot``) in which some second of theirs is needed.

    An hour needs its own seconds and, to know how long water has been flowing at its start, the
    flow of the onset time before it: blocks near its start are dealt twice. ``whole`` marks
    those of which every second is of the slot's own hour; of others :func:`_needed` has to choose.
    """
    if int(cfg.flow_onset_seconds) > 3600:
        raise ValueError("the onset can't be longer than an hour")
    onset = F.expr(f"interval {int(cfg.flow_onset_seconds)} seconds")
    first, last = F.element_at("at", 1), F.element_at("at", -1)
    timed = blocks.withColumns({f"{k}_local": local_time(_instant(lane), cfg.timezone) for k, lane in (("first", first), ("last", last))})
    own = F.array(hour_of(F.col("first_local")), hour_of(F.col("last_local")))
    after = F.array(*[local_hour(_instant(lane) + onset, cfg.timezone) for lane in (first, last)])
    slots = F.array_distinct(F.when(F.array_contains("flow", True), F.concat(own, after)).otherwise(own))
    # no clock change within the block
    even = epoch_micros(F.col("last_local")) - epoch_micros(F.col("first_local")) == (last - first) * F.lit(_SECOND)
    dealt = timed.select("*", own.alias("own"), F.coalesce(even, F.lit(False)).alias("even"), F.explode(slots).alias("slot"))
    whole = F.col("even") & (F.col("own")[0] == F.col("slot")) & (F.col("own")[1] == F.col("slot"))
    return dealt.select("house_alias", "slot", whole.alias("whole"), "since", "base", "at", "flow", "sums", "counts")


def _needed(seconds: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Seconds of their slot's own hour (``own``), and flow of the onset time before it in the same batch."""
    onset = int(cfg.flow_onset_seconds)
    local, slot = local_time(F.col("ts"), cfg.timezone), F.col("slot")
    own = F.when(F.col("whole"), True).otherwise(hour_of(local).eqNullSafe(slot))
    late = F.minute(local) * 60 + F.second(local) >= 3600 - onset
    # runs restart at a batch edge
    same = _batch(hour_of(local), F.col("since"), cfg) == _batch(slot, F.col("since"), cfg)
    before = late & (local_hour(F.col("ts") + F.expr(f"interval {onset} seconds"), cfg.timezone) == slot) & same
    return seconds.where(F.when(own, True).otherwise(F.col("flows") & before)).withColumn("own", own)


def _hp_kw() -> Column:
    return thermal_power_kw(F.col("primary_flow_gpm"), F.col("hp_lwt_c"), F.col("hp_ewt_c"))


def _dist_kw() -> Column:
    return thermal_power_kw(F.col("dist_flow_gpm"), F.col("dist_swt_c"), F.col("dist_rwt_c"))


def _energy_columns() -> list[Column]:
    # the mean power over the seconds that have data, read as kWh of the hour
    return [
        F.coalesce(settle(F.avg(_dist_kw()), 2), F.lit(0.0)).alias("dist_kwh"),
        F.coalesce(settle(F.avg(_hp_kw()), 2), F.lit(0.0)).alias("hp_kwh_th"),
    ]


def _water_column() -> Column:
    return settle(F.sum("dist_flow_gpm") * KG_PER_US_GALLON / 60, 2).alias("dist_water_kg")


def _flow_temperature_columns() -> list[Column]:
    def mean_f(column: str) -> Column:
        return settle(celsius_to_f(F.avg(F.when(F.col("eligible"), F.col(column)))), 2)

    return [
        mean_f("dist_swt_c").alias("swt_average_f"),
        mean_f("dist_rwt_c").alias("rwt_average_f"),
    ]


def _by_hour(per_second: DataFrame, cfg: HeatConfig):
    hour = local_hour(F.col("ts"), cfg.timezone).alias("hour_start")
    return per_second.groupBy("house_alias", hour)


def hourly_energy(per_second: DataFrame, cfg: HeatConfig) -> DataFrame:
    return _by_hour(per_second, cfg).agg(*_energy_columns())


def hourly_water_kg(per_second: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Kilograms pumped; hours in which no flow reading exists are left out of the sum."""
    return _by_hour(per_second, cfg).agg(_water_column())


def hourly_flow_temps(segments: DataFrame, cfg: HeatConfig) -> DataFrame:
    """Mean supply and return temperature over the eligible seconds."""
    return _by_hour(segments.where("eligible"), cfg).agg(*_flow_temperature_columns())


def hourly_from_seconds(readings_1s: DataFrame, since: datetime | Column, cfg: HeatConfig) -> DataFrame:
    """All three hourly results from a single pass over the telemetry, with one exchange.

    Readings are combined to blocks of seconds, which are dealt to (house, local hour) before anything
    is grouped. The seconds, the window that finds flow runs and the hourly aggregate all keep within
    such an hour, so they share that distribution. Blocks are far smaller packed than taken apart, so
    their partitions are not joined by size. ``since`` is the instant (UTC) from which batches count; a
    column where it differs by row.
    """
    keys = ["house_alias", "slot"]
    partitions = first_partitions(readings_1s.sparkSession)
    dealt = hour_slots(second_blocks(readings_1s, since), cfg).repartition(partitions, *keys)
    ts = _instant(F.col("lane")).cast(readings_1s.schema["ts"].dataType)
    apart = dealt.select("*", F.posexplode("at").alias("i", "lane")).select(
        *keys, "whole", "since", ts.alias("ts"), F.get("flow", F.col("i")).alias("flows"),
        *[
            F.get(c, F.col("i") * len(SECOND_CHANNELS) + k).alias(f"{c}_{name}")
            for k, name in enumerate(SECOND_CHANNELS) for c in ("sums", "counts")
        ],
    )
    n = {name: F.sum(f"counts_{name}") for name in SECOND_CHANNELS}
    seconds = _needed(apart, cfg).groupBy(*keys, "ts").agg(
        *[
            (F.when(n[name] > 0, F.sum(f"sums_{name}") / n[name]) / scale).alias(name)
            for name, (_, _, scale) in SECOND_CHANNELS.items()
        ],
        F.max("own").alias("own"),
    )
    segments = _with_segments(seconds, keys, cfg).where("own")
    hours = segments.groupBy(*keys).agg(*_energy_columns(), _water_column(), *_flow_temperature_columns())
    return hours.withColumnRenamed("slot", "hour_start")
