"""Exchange sessions as a table, and the last completed close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(spark: SparkSession, start: str, end: str, holidays: list[str], half_days: list[str], zone: str = "America/New_York") -> DataFrame:
    """(session, close_ts): weekdays without holidays; closes at 16:00 local time, 13:00 on half days."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    days = days.where(F.dayofweek("session").between(2, 6) & ~F.date_format("session", "yyyy-MM-dd").isin(holidays or [""]))
    half = F.date_format("session", "yyyy-MM-dd").isin(half_days or [""])
    local = F.col("session").cast("timestamp") + F.when(half, F.expr("INTERVAL 13 HOURS")).otherwise(F.expr("INTERVAL 16 HOURS"))
    return days.select("session", F.to_utc_timestamp(local, zone).alias("close_ts"))


def last_close(probes: DataFrame, table: DataFrame, now: str = "now", days: int = 14) -> DataFrame:
    """Every probe with last_close: the greatest close of the days before that is not after now; null without one.

    Each calendar day gets the closes that its probes may meet, at most one for each of the days
    before: probes meet them in an equi join by day, and equal probes stay rows of their own.
    """
    reach = F.explode(F.sequence("session", F.date_add("session", days))).alias("__day")
    by_day = table.select(reach, "close_ts").groupBy("__day").agg(F.collect_list("close_ts").alias("__closes"))
    near = probes.withColumn("__day", F.to_date(now)).join(by_day, "__day", "left")
    return near.withColumn("last_close", F.array_max(F.filter("__closes", lambda c: c <= F.col(now)))).drop("__day", "__closes")


def weekday_close(now: Column, hour: int = 21) -> Column:
    """The last weekday close at a fixed UTC hour."""
    hour = max(0, min(23, hour))
    day = F.when(F.hour(now) < hour, F.date_sub(F.to_date(now), 1)).otherwise(F.to_date(now))
    back = F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0)
    return F.date_sub(day, back).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))
