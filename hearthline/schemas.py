"""Schemas of the tables that enter the pipeline.

Instants are ``TIMESTAMP_NTZ`` in UTC; ``hour_start`` is ``TIMESTAMP_NTZ`` in the
house's own wall clock. Missing measurements are null, never NaN.
"""

from pyspark.sql import types as T

READINGS_1S = (
    "house_alias string, ts timestamp_ntz, channel_name string, unit string, value double"
)
READINGS = "channel_id bigint, ts timestamp_ntz, value double"
READING_CHANNELS = "id bigint, name string, unit string, house_alias string"
MESSAGES = "ts timestamp_ntz, message_type_name string, from_alias string, payload string"
SOLAR = "hour_start timestamp_ntz, solar_w_m2 double"
FORECAST_PAYLOAD = "Time array<string>, OatF array<double>, WindSpeedMph array<double>"

_DOUBLES = (
    "oat_f",
    "ws_mph",
    "solar_w_m2",
    "dist_kwh",
    "hp_kwh_th",
    "swt_average_f",
    "rwt_average_f",
    "dist_water_kg",
    "oil_boiler_pwr",
)
ZONE = T.StructType([
    T.StructField("zone", T.IntegerType()),
    T.StructField("avg_set", T.DoubleType()),
    T.StructField("avg_temp", T.DoubleType()),
    T.StructField("heatcall_fraction", T.DoubleType()),
])
HOURLY = T.StructType([
    T.StructField("house_alias", T.StringType()),
    T.StructField("hour_start", T.TimestampNTZType()),
    *[T.StructField(name, T.DoubleType()) for name in _DOUBLES],
    T.StructField("oat_f_forecast", T.ArrayType(T.DoubleType())),
    T.StructField("ws_mph_forecast", T.ArrayType(T.DoubleType())),
    T.StructField("zones", T.ArrayType(ZONE)),
])
HOURLY_COLUMNS = tuple(HOURLY.names)
