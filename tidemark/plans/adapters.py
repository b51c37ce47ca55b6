"""The logical tables as views of the driver's tables, for queries and tests.

Each has a twin in ``plans/oracle.py``, written independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    cmd = (
        F.when(kind == "click", "DANMU_MSG")
        .when(kind == "view", F.when(i % 2 == 0, "SEND_GIFT").otherwise("GUARD_BUY"))
        .when(kind == "purchase", "SUPER_CHAT_MESSAGE")
        .when(kind == "signup", "LIVE")
        .otherwise(F.when(i % 3 == 0, "ROOM_CHANGE").otherwise("PREPARING"))
    )
    viewer, paid = kind.isin("click", "view", "purchase"), kind.isin("view", "purchase")
    return e.select(
        i.alias("id"),
        (F.col("user_id") % 8).alias("room_id"),
        cmd.alias("cmd"),
        F.when(viewer, F.col("user_id")).alias("uid"),
        F.when(viewer, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), (i % 3).cast("string"))).alias("uname"),
        F.when(kind.isin("click", "purchase"), F.col("props")).alias("content"),
        F.when(paid, F.concat(F.lit("g"), (i % 5).cast("string"))).alias("gift_name"),
        F.when(paid, F.when(kind == "purchase", F.lit(1)).otherwise(i % 4 + 1)).cast("bigint").alias("gift_num"),
        F.when(paid, F.floor("value")).cast("bigint").alias("total_coin"),
        F.when((cmd == "ROOM_CHANGE") & (i % 4 != 0), F.concat(F.lit("t"), (i % 4).cast("string"))).alias("title"),
        F.when(~((kind == "signup") & (i % 5 == 0)), _epoch("ts")).alias("timestamp"),
    )


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("uname"), _epoch("o_orderdate").alias("first_seen"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    metric = lambda n, x: F.when(k % n == 0, F.lit(-1)).otherwise(F.floor(x)).cast("bigint")
    return o.select(
        k.alias("id"),
        (F.col("o_custkey") % 8).alias("room_id"),
        F.col("o_custkey").alias("uid"),
        F.concat(F.lit("liver"), (F.col("o_custkey") % 8).cast("string")).alias("uname"),
        metric(50, F.col("o_totalprice")).alias("fans_num"),
        metric(70, F.col("o_totalprice") / 100).alias("guard_num"),
        metric(90, F.col("o_totalprice") / 10).alias("fan_club_num"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("group_id"), (c % 11).alias("room_id"), F.when(c % 4 == 0, 1).otherwise(0).alias("dev"))


def liver(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    nickname = F.when(k % 3 == 1, "  ").when(k % 3 == 2, F.concat(F.lit("nick"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("room_id"), F.col("s_nationkey").cast("bigint").alias("uid"), F.when(k % 7 != 0, F.col("s_name")).alias("uname"), nickname.alias("nickname"))


def manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("group_id"), F.col("l_suppkey").alias("manager_qq")).distinct()


def song_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_name").alias("title"),
        F.when(k % 5 != 0, F.col("p_type")).alias("title_trans"),
        F.col("p_brand").alias("original_singer"),
        F.col("p_size").cast("bigint").alias("count"),
        F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit("la"), k.cast("string"))).alias("lyrics"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with JSON cards, made of pages: kinds 8, 1 and 2 in turn, every sixth without a user."""
    k = F.col("page_id")
    user = F.when(k % 6 != 0, F.struct(F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.lit("un"), k.cast("string")).alias("uname"), F.lit("").alias("head_url"), F.lit("//f/x.jpg").alias("face")))
    item = F.struct(F.when(k % 4 != 0, F.concat(F.lit("d"), k.cast("string"))).otherwise("").alias("description"), F.concat(F.lit("c"), k.cast("string")).alias("content"))
    owner = F.struct(F.concat(F.lit("o"), k.cast("string")).alias("name"), F.lit("//i0.hdslb.com/a.jpg@1w").alias("face"))
    origin = F.when(k % 9 == 1, F.to_json(F.struct(F.struct(F.lit("src").alias("name")).alias("user"), F.struct(F.concat(F.lit("q"), k.cast("string")).alias("description")).alias("item"))))
    card = F.to_json(F.struct(user.alias("user"), owner.alias("owner"), item.alias("item"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit("p.jpg").alias("pic"), origin.alias("origin")))
    kind = F.when(k % 3 == 0, 8).when(k % 3 == 1, 1).otherwise(2).cast("bigint")
    return table(spark, sf_dir, "pages").select(k.alias("id"), F.col("url").alias("activity_id"), (k % 8).alias("room_id"), kind.alias("dy_type"), F.lit(2).cast("bigint").alias("orig_type"), card.alias("card"), (k * 60).alias("timestamp"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, pos, line: every conversation is a log file, user turns are header lines; whole texts, repeated turns too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(order).cast("bigint"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 7), "yyyy-MM-dd HH:mm:ss")
    body = F.regexp_replace("text", r"[^A-Za-z ]", "")
    head = F.concat(stamp, F.lit(",123 - svc"), (F.col("pos") % 3).cast("string"), F.lit(" - INFO - m"), body)
    return c.select(F.col("conv_id").alias("file"), "pos", F.when(F.col("role") == "user", head).otherwise(F.concat(F.lit("  at "), body)).alias("line"))
