"""Hand-made hourly rows that several test modules share."""

from datetime import datetime, timedelta

from hearthline import schemas

T0 = datetime(2024, 1, 1)


def zone(number=1, avg_set=68.0, avg_temp=68.0, heatcall=0.5):
    return (number, avg_set, avg_temp, heatcall)


def hour_row(i, house="h1", **changes):
    """An unremarkable hourly row ``i`` hours after the start, with changes."""
    row = dict(
        house_alias=house, hour_start=T0 + timedelta(hours=i), oat_f=30.0 + i % 5, ws_mph=5.0,
        solar_w_m2=0.0, dist_kwh=3.0 + i % 3, hp_kwh_th=3.0, swt_average_f=120.0, rwt_average_f=110.0,
        dist_water_kg=500.0, oil_boiler_pwr=0.0, oat_f_forecast=None, ws_mph_forecast=None, zones=[zone()],
    )
    row.update(changes)
    return tuple(row[c] for c in schemas.HOURLY_COLUMNS)


def hourly(spark, rows):
    return spark.createDataFrame(rows, schemas.HOURLY)


def by_hour(df, column, house="h1"):
    """Value of a column by hours since the start."""
    rows = df.where(df.house_alias == house).select("hour_start", column).collect()
    return {int((r[0] - T0).total_seconds() // 3600): r[1] for r in rows}
