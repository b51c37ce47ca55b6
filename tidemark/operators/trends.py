"""Series of follower and member counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def window_of(stats: DataFrame, as_of: str, days: int, room_id: int | None = None, hours: int = 8) -> DataFrame:
    """Samples of the last days before a local time, with ``local_time`` text.

    The condition is put on the stored text shifted back, so it can be pushed to the scan;
    texts that are no time have no local time and drop out.
    """
    least = F.date_format(F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days), hours=F.lit(hours)), "yyyy-MM-dd HH:mm:ss")
    rows = stats.where(F.col("created_at") >= least)
    rows = rows if room_id is None else rows.where(F.col("room_id") == room_id)
    return rows.withColumn("local_time", S.shifted_text("created_at", hours)).where("local_time is not null")


def cleaned(samples: DataFrame, key: str, t: str, v: str, order: str = "id") -> DataFrame:
    """Points without the sentinel -1 whose time is after that of every point before them.

    The last kept time is the running maximum, so one window does; points come in the
    order of time, then ``order``.
    """
    before = Window.partitionBy(key).orderBy(t, order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(t).over(before)
    rows = samples.where(F.col(v).isNotNull() & (F.col(v) != -1) & F.col(t).isNotNull())
    return rows.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(t) > F.col("_top"))).drop("_top")


def cleaned_by_arrival(samples: DataFrame, key: str, t: str, v: str, order: str) -> DataFrame:
    """As ``cleaned``, for points that come in the order of ``order`` alone."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.where(F.col(v).isNotNull() & (F.col(v) != -1) & F.col(t).isNotNull())
    return rows.withColumn("_top", F.max(t).over(before)).where(F.col("_top").isNull() | (F.col(t) > F.col("_top"))).drop("_top")


def summary(points: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """First, last, least and largest value, signed change and axis bounds; series of one point have none."""
    out = points.groupBy(key).agg(F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lower, upper = S.axis_bounds("lo", "hi")
    return out.withColumns({"delta": S.signed(F.col("last") - F.col("first")), "axis_lo": lower, "axis_hi": upper})


def latest(stats: DataFrame, n: int = 50) -> DataFrame:
    """The newest n samples of each room."""
    rank = F.row_number().over(Window.partitionBy("room_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id")))
    return stats.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)
