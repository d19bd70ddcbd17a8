"""Weather series and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.functions import weather as x

SERIES = "properties struct<timeseries:array<struct<time:string,data:struct<instant:struct<details:struct<air_temperature:double,relative_humidity:double,wind_speed:double,wind_from_direction:double>>,next_1_hours:struct<summary:struct<symbol_code:string>,details:struct<probability_of_precipitation:double>>,next_6_hours:struct<summary:struct<symbol_code:string>,details:struct<probability_of_precipitation:double>>,next_12_hours:struct<summary:struct<symbol_code:string>,details:struct<probability_of_precipitation:double>>>>>>"
PERIODS = "properties struct<periods:array<struct<startTime:string,isDaytime:boolean,temperature:double,temperatureUnit:string,windSpeed:string,windDirection:string,shortForecast:string,icon:string,probabilityOfPrecipitation:struct<value:int>>>>"


def hourly_points(raw: DataFrame) -> DataFrame:
    """Points (bucket, at, temp_c, humidity, wind_kph, wind_from, precip, symbol) of the first provider's JSON; a
    symbol and a chance of rain are those of the next hour, else of 6, else of 12."""
    p = raw.select("bucket", F.explode(F.from_json("body", SERIES)["properties"]["timeseries"]).alias("p"))
    d = F.col("p.data")
    first = lambda *path: F.coalesce(*[d[f"next_{n}_hours"][path[0]][path[1]] for n in (1, 6, 12)])
    now = d["instant"]["details"]
    return p.select("bucket", F.try_to_timestamp("p.time").alias("at"), now["air_temperature"].alias("temp_c"), now["relative_humidity"].alias("humidity"), (now["wind_speed"] * 3.6).alias("wind_kph"), x.compass(now["wind_from_direction"]).alias("wind_from"), first("details", "probability_of_precipitation").alias("precip"), first("summary", "symbol_code").alias("symbol"))


def period_points(raw: DataFrame) -> DataFrame:
    """Periods (bucket, place, at, daytime, temp_c, wind_kph, precip, text, icon) of the second provider's JSON."""
    p = raw.select("bucket", F.posexplode(F.from_json("body", PERIODS)["properties"]["periods"]).alias("place", "p"))
    temp = F.when(F.upper("p.temperatureUnit") == "C", F.col("p.temperature")).otherwise(x.f_to_c(F.col("p.temperature")))
    return p.select("bucket", "place", F.try_to_timestamp("p.startTime").alias("at"), F.col("p.isDaytime").alias("daytime"), temp.alias("temp_c"), x.parse_wind_kph(F.col("p.windSpeed")).alias("wind_kph"), F.col("p.probabilityOfPrecipitation.value").alias("precip"), F.col("p.shortForecast").alias("text"), F.col("p.icon").alias("icon"))


def weather_tables(raw: DataFrame, provider: str, zone: str = "UTC") -> dict[str, DataFrame]:
    """The current, hourly and daily tables of a provider's JSON (bucket, body)."""
    if provider == "met":
        points = hourly_points(raw).withColumn("condition", x.symbol_condition(F.col("symbol")))
        daily = daily_series(points, zone)
    else:
        points = period_points(raw).withColumn("condition", x.condition(F.col("text"), F.col("icon")))
        daily = pair_periods(points, zone)
    return {"current": first_hours(points, 1), "hourly": first_hours(points), "daily": daily}


def first_hours(points: DataFrame, n: int = 24) -> DataFrame:
    """The first n points of each bucket."""
    return points.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("at"))).filter(F.col("_n") <= n).drop("_n")


def daily_series(points: DataFrame, zone: str = "UTC", most: int = 7, least_samples: int = 6) -> DataFrame:
    """(bucket, day, hi, lo, precip, condition) by local date; the condition is that nearest to 13:00, the earlier of
    two; a first day of fewer than `least_samples` points goes if there are more than `most` days."""
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)
    days = points.withColumn("_local", local).groupBy("bucket", F.to_date("_local").alias("day")).agg(F.max(F.nanvl("temp_c", F.lit(None))).alias("hi"), F.min(F.nanvl("temp_c", F.lit(None))).alias("lo"), F.max("precip").alias("precip"), F.min_by("condition", F.struct(F.abs(F.hour("_local") - 13), F.col("_local"))).alias("condition"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket").orderBy("day")
    days = days.withColumn("i", F.row_number().over(w)).withColumn("days", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).withColumn("n1", F.first("n").over(w))
    skip = F.when((F.col("days") > most) & (F.col("n1") < least_samples), 1).otherwise(0)
    return days.filter((F.col("i") > skip) & (F.col("i") <= skip + most)).select("bucket", "day", "hi", "lo", "precip", "condition")


def pair_periods(periods: DataFrame, zone: str = "UTC", most: int = 7) -> DataFrame:
    """(bucket, day, hi, lo, precip, condition): periods in pairs, the day's one names the row, the night's the low."""
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy("place"))
    numbered = periods.withColumn("rn", rn).withColumn("pair", F.floor((F.col("rn") - 1) / 2)).filter(F.col("pair") < most)
    second = F.pmod(F.col("rn") - 1, F.lit(2)) == 1
    one = lambda c: F.max(F.when(~second, F.col(c)))
    two = lambda c: F.max(F.when(second, F.col(c)))
    day_first = one("daytime")
    pairs = numbered.groupBy("bucket", "pair").agg(
        F.max("temp_c").alias("hi"), F.when(day_first, two("temp_c")).otherwise(one("temp_c")).alias("night"), F.min("temp_c").alias("low"), F.max("precip").alias("precip"),
        F.when(day_first, one("at")).otherwise(F.coalesce(two("at"), one("at"))).alias("at"), F.when(day_first, one("condition")).otherwise(F.coalesce(two("condition"), one("condition"))).alias("condition"),
    )
    return pairs.select("bucket", F.to_date(F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)).alias("day"), "hi", F.coalesce("night", "low").alias("lo"), "precip", "condition")


def merge_weather(primary: DataFrame, secondary: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per bucket the primary provider's forecast, else the secondary's; alerts of the primary only; the earliest expiry.

    forecasts: bucket, forecast, expires_at; alerts: bucket, n_alerts, expires_at."""
    p = primary.select("bucket", F.col("forecast").alias("f1"), F.col("expires_at").alias("e1"))
    s = secondary.select("bucket", F.col("forecast").alias("f2"), F.col("expires_at").alias("e2"))
    a = alerts.select("bucket", "n_alerts", F.col("expires_at").alias("e3"))
    every = p.select("bucket").union(s.select("bucket")).distinct().join(p, "bucket", "left").join(s, "bucket", "left").join(a, "bucket", "left")
    used = F.when(F.col("f1").isNotNull(), F.col("e1")).otherwise(F.col("e2"))
    return every.select("bucket", F.coalesce("f1", "f2").alias("forecast"), F.col("f1").isNull().alias("fallback"), F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), F.least(used, F.col("e3")).alias("expires_at"))


def is_warning(event: Column, severity: Column) -> Column:
    return F.coalesce(F.lower(event).contains("warning"), F.lit(False)) | F.coalesce(F.lower(severity).isin("extreme", "severe"), F.lit(False))


def new_warnings(alerts: DataFrame, notified: DataFrame) -> DataFrame:
    """Alerts of warning level of which nobody has been told."""
    return alerts.filter(is_warning(F.col("event"), F.col("severity"))).join(notified.select("alert_id").distinct(), "alert_id", "left_anti")


def order_alerts(alerts: DataFrame) -> DataFrame:
    """T4: by severity, then by when they take effect."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, vocab.SEVERITIES)), F.lower("severity")), F.lit(0)), F.lit(len(vocab.SEVERITIES) + 1))
    return alerts.withColumn("severity_rank", rank).orderBy("severity_rank", "effective", "alert_id")


def cache_state(log: DataFrame, now_s: int, min_refresh_s: int) -> DataFrame:
    """(key, state) of the last entry for each key of a fetch log (key, at_s, status, expires_s): fresh before expiry or
    within the minimum refresh, expired after it, stale if the last fetch failed and there is an older body.

    A 304 answer counts as a fetch that expires after the minimum refresh."""
    good = log.filter(F.col("status").isin(200, 304)).withColumn("expires", F.when(F.col("status") == 304, F.col("at_s") + min_refresh_s).otherwise(F.col("expires_s")))
    body = good.groupBy("key").agg(F.max_by(F.struct("at_s", "expires"), "at_s").alias("b"))
    last = log.groupBy("key").agg(F.max_by("status", "at_s").alias("status"))
    fresh = (now_s < F.col("b.expires")) | (now_s - F.col("b.at_s") < min_refresh_s)
    state = F.when(F.col("b").isNull(), "none").when(fresh, "fresh").when(~F.col("status").isin(200, 304), "stale").otherwise("expired")
    return last.join(body, "key", "left").select("key", state.alias("state"))
