"""Readings are combined before they are shuffled to their hours (FINDINGS_r04)."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.operators import telemetry
from hearthline.session import ARROW_BYTES, NO_LIMIT, configure
from test_plans import plan

T0 = datetime(2024, 1, 10, 12)
CHANNELS = {channel: unit for channel, unit, _ in telemetry.SECOND_CHANNELS.values()}


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.READINGS_1S)


def test_a_row_per_minute_is_shuffled(spark, cfg):
    rows = [("h1", T0 + timedelta(seconds=i), c, u, 100.0 + i) for i in range(120) for c, u in CHANNELS.items() for _ in range(3)]
    readings = frame(spark, rows).coalesce(1)
    blocks = telemetry.second_blocks(readings, T0).collect()
    assert len(blocks) == 2 and all(b["at"] == list(range(60)) for b in blocks)
    assert sum(map(sum, (b.counts for b in blocks))) == len(rows) and sum(map(sum, (b.sums for b in blocks))) == sum(r[4] for r in rows)
    text = plan(telemetry.hourly_from_seconds(readings, T0, cfg))
    assert text.index("Exchange") < text.index("MapInArrow")  # combined below the exchange


def test_blocks_keep_odd_readings(spark):
    half = timedelta(microseconds=500_000)
    rows = [
        ("h1", T0 + half, "dist-flow", "GpmTimes100", 1.0), ("h1", T0, "dist-flow", "GpmTimes100", None),
        ("h1", T0 + timedelta(seconds=1), "dist-swt", "odd", 5.0), (None, T0, "dist-swt", "WaterTempCTimes1000", 7.0),
        ("h1", None, "dist-swt", "WaterTempCTimes1000", 8.0), ("h1", datetime(1969, 12, 31, 23, 59, 59), "dist-flow", "GpmTimes100", 9.0),
    ]
    base = lambda ts: int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    got = {(b.house_alias, b.base): (b["at"], b.flow, sum(b.sums), sum(b.counts)) for b in telemetry.second_blocks(frame(spark, rows).coalesce(1), T0).collect()}
    assert got == {
        ("h1", base(T0 + half)): ([0], [True], 1.0, 1), ("h1", base(T0)): ([0, 1], [True, False], 0.0, 0),
        (None, base(T0)): ([0], [False], 7.0, 1), ("h1", None): ([0], [False], 8.0, 1), ("h1", -60_000_000): ([59], [True], 9.0, 1),
    }


def test_a_second_read_in_many_tasks_is_one(spark, cfg, monkeypatch):
    """Blocks of the same minute, cut anywhere, add up to the hours of the separate operators."""
    rng = random.Random(3)
    edge = T0 + timedelta(hours=1)
    rows = []
    for i in range(-200, 200):
        for channel, unit in CHANNELS.items():
            dry = channel == "dist-flow" and (i == -150 or 60 < i < 80)
            rows += [("h1", edge + timedelta(seconds=i), channel, unit, 0.0 if dry else float(rng.randint(30000, 50000))) for _ in range(rng.choice((1, 2, 3)))]
    rng.shuffle(rows)
    monkeypatch.setattr(telemetry, "COMBINED", 50)
    readings = frame(spark, rows).repartition(7)
    together = {r.hour_start: r for r in telemetry.hourly_from_seconds(readings, T0, cfg).collect()}
    per_second = telemetry.pivot_channels_per_second(readings)
    segments = telemetry.flow_segments(per_second, T0, cfg)
    checked = 0
    for part in (telemetry.hourly_energy(per_second, cfg), telemetry.hourly_water_kg(per_second, cfg), telemetry.hourly_flow_temps(segments, cfg)):
        for row in part.collect():
            checked += 1
            assert all(together[row.hour_start][c] == row[c] for c in part.columns if c not in ("house_alias", "hour_start"))
    assert checked == 6 and len(together) == 2


def test_batches_differ_by_row(spark, cfg):
    """A run goes on over an hour's end where no batch ends there, for each row's own start."""
    edge = T0 + timedelta(days=cfg.batch_days)
    rows = [(h, edge + timedelta(seconds=i), c, CHANNELS[c], v) for h in ("cut", "on") for i in range(-40, 20)
            for c, v in (("dist-flow", 100.0), ("dist-swt", 40000.0))]
    since = F.when(F.col("house_alias") == "cut", F.lit(T0)).otherwise(F.lit(T0 + timedelta(hours=1))).cast("timestamp_ntz")
    out = telemetry.hourly_from_seconds(frame(spark, rows).withColumn("since", since), F.col("since"), cfg)
    # 12:00 UTC is 7 in the morning
    assert {(r.house_alias, r.hour_start.hour): r.swt_average_f for r in out.collect()} == {
        ("cut", 6): 104.0, ("cut", 7): None, ("on", 6): 104.0, ("on", 7): 104.0}


def test_arrow_batches_have_no_limit_in_bytes_unless_texts_set_one(spark):
    from hearthline.llm import common

    before = spark.conf.get(ARROW_BYTES, None)
    rows = spark.conf.get(common.ARROW)
    try:
        spark.conf.unset(ARROW_BYTES)
        assert configure(spark).conf.get(ARROW_BYTES) == NO_LIMIT
        common._text_batches(spark)
        assert spark.conf.get(ARROW_BYTES) == str(common.BATCH_BYTES) == configure(spark).conf.get(ARROW_BYTES)
    finally:
        spark.conf.set(common.ARROW, rows)
        spark.conf.unset(ARROW_BYTES)
        if before is not None:
            spark.conf.set(ARROW_BYTES, before)
