"""Posts: reading new ones, freshness, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def after(activities: DataFrame, last_id: int, limit: int = 100) -> DataFrame:
    """The next posts by id, ``limit`` at most."""
    return activities.where(F.col("id") > last_id).orderBy("id").limit(limit)


def newest(activities: DataFrame) -> DataFrame:
    return activities.orderBy(F.desc("id")).limit(1)


def with_fresh(activities: DataFrame, now: int, most: int = 600) -> DataFrame:
    """Posts plus ``eligible``: not older than ``most`` seconds.  A cursor moves over all of them."""
    return activities.withColumn("eligible", F.lit(now) - F.col("timestamp") <= most)


def typed(rows: DataFrame) -> DataFrame:
    """Rows in stored types, an absent creation time as empty text, emoji as a map."""
    out = rows.withColumns({c: F.col(c).cast("bigint") for c in ("id", "room_id", "uid", "timestamp", "dy_type", "orig_type") if c in rows.columns})
    return out.withColumns({"created_at": F.coalesce("created_at", F.lit("")), "emoji": S.emoji_map("emoji_details")})


def cards(activities: DataFrame) -> DataFrame:
    """id and the fields of the post and of what it quotes."""
    fields = activities.withColumns({"_c": S.card_fields("card", "dy_type"), "_o": S.origin_fields("card", "orig_type")})
    return fields.select("id", F.col("_c.username").alias("username"), S.sized_image("_c.avatar_url", "@80w").alias("avatar_url"), F.col("_c.text").alias("text"), F.array_join("_c.pic_urls", ",").alias("pics"), F.col("_o.text").alias("quoted"))


def picture_cells(rows: DataFrame, key: str, urls: str) -> DataFrame:
    """key, pos, url and place in the grid of each picture."""
    out = rows.select(key, F.size(urls).alias("n"), F.posexplode(urls).alias("pos", "url"))
    return out.withColumn("cell", S.grid_cell("pos", "n")).select(key, "pos", "url", "cell.*")


def oldest_first(rows: DataFrame, key: str, items: str) -> DataFrame:
    """A fetched list, newest first, as rows in the order to insert."""
    return rows.select(key, F.posexplode(F.reverse(items)).alias("seq", "item"))
