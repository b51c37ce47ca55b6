"""Sets, counts and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_rooms(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select("room_id").distinct()


def dev_rooms(subscriptions: DataFrame) -> DataFrame:
    """Rooms that a group with the flag subscribes to."""
    return subscriptions.where("dev = 1").select("room_id").distinct()


def with_dev(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return rows.join(dev_rooms(subscriptions), "room_id", "left_semi")


def reconcile(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """room_id, action: what to start and what to stop."""
    a, b = current.select("room_id").distinct(), wanted.select("room_id").distinct()
    start = b.join(a, "room_id", "left_anti").withColumn("action", F.lit("start"))
    return start.unionByName(a.join(b, "room_id", "left_anti").withColumn("action", F.lit("stop")))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def largest(rows: DataFrame, column: str) -> DataFrame:
    """The largest value, 0 without rows."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("top"))


def permitted(requests: DataFrame, managers: DataFrame, initial: DataFrame) -> DataFrame:
    """Requests (group_id, manager_qq) of managers; a group without any first gets its initial one."""
    empty = initial.join(managers.select("group_id").distinct(), "group_id", "left_anti")
    known = managers.select("group_id", "manager_qq").unionByName(empty.select("group_id", "manager_qq"))
    return requests.join(known.distinct(), ["group_id", "manager_qq"], "left_semi")


def keep_newest(files: DataFrame, name: str, keep: int) -> DataFrame:
    """``files`` plus ``delete``: all but the ``keep`` last by name; keeping 0 deletes nothing."""
    if keep <= 0:
        return files.withColumn("delete", F.lit(False))
    newest = files.select(F.col(name).alias("_kept")).distinct().orderBy(F.desc("_kept")).limit(keep)  # a top-k, at most ``keep`` names
    joined = files.join(F.broadcast(newest), F.col(name) == F.col("_kept"), "left")
    return joined.select(*files.columns, F.col("_kept").isNull().alias("delete"))


def edge_alerts(samples: DataFrame, key: str, order: str, bad: Column, good: Column, held_back: Column | None = None) -> DataFrame:
    """``samples`` plus ``alert``: the first bad one since a good one.

    What is neither bad nor good doesn't count.  Where ``held_back`` holds, a bad sample
    fires no alert and isn't remembered either.
    """
    held = F.lit(False) if held_back is None else held_back
    marked = samples.withColumn("_s", F.when(bad & ~held, "bad").when(good, "good")).where("_s is not null")
    before = F.lag("_s").over(Window.partitionBy(key).orderBy(order))
    return marked.withColumn("_p", before).withColumn("alert", (F.col("_s") == "bad") & F.coalesce(F.col("_p") == "good", F.lit(True))).drop("_s", "_p")
