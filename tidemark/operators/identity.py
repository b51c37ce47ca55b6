"""Names that viewers have had, and names of rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def optional_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalogue table, or an empty one of its schema where there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def sightings(events: DataFrame, history: DataFrame | None) -> DataFrame:
    """uid, uname, ts of both sources, as a bag."""
    seen = events.where("uid is not null and uname is not null").select("uid", "uname", F.col("timestamp").alias("ts"))
    return seen if history is None else history.where("uid is not null and uname is not null").select("uid", "uname", F.col("first_seen").alias("ts")).unionByName(seen)


def name_history(seen: DataFrame) -> DataFrame:
    """uid, names: each uid's names by when they were first seen; equal times by name, undated names first.

    Two map-side combined aggregates; what is gathered for a uid are its distinct names.
    """
    first = seen.groupBy("uid", "uname").agg(F.min("ts").alias("ts"))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ts", F.lit(-(2**62))).alias("ts"), "uname"))), lambda x: x["uname"])
    return first.groupBy("uid").agg(names.alias("names"))


def uids_called(seen: DataFrame, name: str) -> DataFrame:
    return seen.where(F.col("uname") == name).select("uid").distinct()


def history_of(seen: DataFrame, query: str) -> DataFrame:
    """Names of the uid that an all-digit query gives, else of all uids ever called so."""
    if query.isascii() and query.isdigit():
        return name_history(seen.where(F.col("uid") == int(query)))
    return name_history(seen.join(uids_called(seen, query), "uid", "left_semi"))


def history_of_uids(seen: DataFrame, uids: DataFrame) -> DataFrame:
    return name_history(seen.join(uids.select("uid").distinct(), "uid", "left_semi"))


def current_names(livers: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """room_id, uid, name: nickname or name of a room, else what the remote service calls it."""
    own = livers.select("room_id", "uid", S.first_not_blank("nickname", "uname").alias("name"))
    if remote is None:
        return own
    far = remote.select("room_id", F.col("uid").alias("r_uid"), F.col("uname").alias("r_name"))
    return own.join(far, "room_id", "full").select("room_id", F.coalesce("uid", "r_uid").alias("uid"), F.coalesce("name", "r_name").alias("name"))


def by_uid(livers: DataFrame) -> DataFrame:
    """One row per uid, which rooms may share: that of the smallest room."""
    rows = livers.where("uid is not null").groupBy("uid").agg(F.min_by(F.struct("room_id", "uname", "nickname"), "room_id").alias("x"))
    return rows.select("uid", F.col("x.room_id").alias("room_id"), S.first_not_blank("x.nickname", "x.uname").alias("name"))


def with_current(history: DataFrame, names: DataFrame) -> DataFrame:
    """History rows numbered by uid, with the current name or else the last one seen."""
    joined = history.join(names.select("uid", "name"), "uid", "left")
    current = F.coalesce("name", F.element_at("names", -1))
    return numbered(joined.select("uid", current.alias("current"), "names"), "uid").select("n", "uid", "current", "names")


def numbered(rows: DataFrame, key: str, parts: int = 200) -> DataFrame:
    """``rows`` plus ``n``, their number from 1 in the order of a number that no two share.

    The keys' percentiles cut them in parts that are numbered apart, each after what the
    parts before it hold; so no task sees more than about a share of ``parts``.
    """
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []))
    part = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col(key))) if bounds else F.lit(0)
    dealt = rows.withColumn("_part", part)
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_own"))
    before = before.withColumn("_before", F.sum("_own").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_own"))  # a row a part
    n = F.row_number().over(Window.partitionBy("_part").orderBy(key)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").select(*rows.columns, n.cast("bigint").alias("n"))
