"""Mutations as folds of an ordered change log.

A log row has the key, ``seq`` (arrival order, unique) and ``op``.  A fold gives the
table after the log; a table and a new log fold as the table's rows with seq below all.
Folds are plain aggregates by key, combined map-side, so a hot key is a row per task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(rows: DataFrame, keys: list[str], seq: str, required: list[str], existing: DataFrame | None = None) -> DataFrame:
    """``rows`` plus ``inserted``: the first complete row of a key that isn't there yet.

    Rows that lack a required value are ignored as well, without an error.
    """
    whole = reduce(and_, [F.col(c).isNotNull() for c in dict.fromkeys([*required, *keys])])
    first = rows.where(whole).groupBy(*keys).agg(F.min(seq).alias("_seq"))
    if existing is not None:
        first = first.join(existing.select(*keys).distinct(), keys, "left_anti")
    first = first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_seq")
    same = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col(seq) == F.col("_seq"))
    return rows.join(first, same, "left").select(*rows.columns, F.col("_seq").isNotNull().alias("inserted"))


def inserted_ids(flagged: DataFrame, seq: str, start: int = 0) -> DataFrame:
    """The inserted rows with ids in arrival order.  Ignored rows use an id up too, so ids have gaps."""
    return flagged.where("inserted").withColumn("id", F.lit(start) + F.col(seq))


def last_write(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_x"))
    return last.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def last_known(log: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Per key and column the last value that isn't null; an empty text is a value."""
    return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def checked_last_known(log: DataFrame, keys: list[str], seq: str, columns: list[str], required: list[str], batch: str) -> DataFrame:
    """As ``last_known``, but a batch that holds a row without a required value is left out whole."""
    broken = log.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])).select(batch).distinct()
    return last_known(log.join(broken, batch, "left_anti"), keys, seq, columns)


def subscription_state(log: DataFrame) -> DataFrame:
    """group_id, room_id, dev after ops ``set`` (room), ``dev`` (flag) and ``remove``.

    ``set`` keeps the flag of a row that is there and starts a new one at 0; ``dev`` acts
    only on a row that is there; what came before the last removal doesn't count.
    """
    own = Window.partitionBy("group_id")
    removed = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(own), F.lit(-1))
    live = log.withColumn("_removed", removed).where(F.col("seq") > F.col("_removed"))
    start = F.min(F.when(F.col("op") == "set", F.col("seq"))).over(own)
    live = live.withColumn("_start", start).where(F.col("seq") >= F.col("_start"))
    return live.groupBy("group_id").agg(
        F.max_by("room_id", F.when(F.col("op") == "set", F.col("seq"))).alias("room_id"),
        F.coalesce(F.max_by("dev", F.when(F.col("op") == "dev", F.col("seq"))), F.lit(0)).cast("int").alias("dev"),
    )


def set_state(log: DataFrame, keys: list[str]) -> DataFrame:
    """Members after ops ``add`` and ``remove``: the keys whose last op adds."""
    return log.groupBy(*keys).agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").select(*keys)


def hits(log: DataFrame, keys: list[str]) -> DataFrame:
    """``log`` plus ``hit``: whether an add was new or a removal found something."""
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy("seq"))
    return log.withColumn("hit", F.when(F.col("op") == "add", F.coalesce(before != "add", F.lit(True))).otherwise(F.coalesce(before == "add", F.lit(False))))


def update_existing(table: DataFrame, changes: DataFrame, keys: list[str], column: str, seq: str = "seq") -> DataFrame:
    """``table`` with ``column`` replaced by the last change of its key; changes to absent keys are lost."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(F.col(column).alias("v")), seq).alias("_new"))
    joined = table.join(last, keys, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns])


def guarded_removal(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked removals (seq, group_id, manager_qq) with ``outcome``: removed, refused or absent, as each finds the group.

    In the order of ``seq`` the k-th member of a group of n that is asked for the first
    time goes if k < n; the last one stays, however often it is asked for; who isn't a
    member, or is one no more, is absent.  So a fold needs each member's first request
    and its rank only; a group's ranks are of members, however many requests there are.
    """
    counts = members.select("group_id", "manager_qq").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    first = asked.groupBy("group_id", "manager_qq").agg(F.min("seq").alias("first")).join(members.select("group_id", "manager_qq").distinct(), ["group_id", "manager_qq"], "left_semi")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("first")))
    known = ranked.join(counts, "group_id")
    joined = asked.join(known, ["group_id", "manager_qq"], "left")
    outcome = F.when(F.col("k").isNull(), "absent").when(F.col("k") >= F.col("n"), "refused").when(F.col("seq") == F.col("first"), "removed").otherwise("absent")
    return joined.select("seq", "group_id", "manager_qq", outcome.alias("outcome"))


def set_if_absent(state: DataFrame, key: str, value: DataFrame) -> DataFrame:
    """``state`` (key, value) plus a row for ``key`` with the single value of ``value``, if it has none."""
    fresh = value.select(F.lit(key).alias("key"), F.col(value.columns[0]).cast("string").alias("value"))
    return state.select("key", "value").unionByName(fresh.join(state.select("key"), "key", "left_anti"))
