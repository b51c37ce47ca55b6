"""The song list: search, pick, missing lyrics, dates, best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import udfs as U


def search(songs: DataFrame, keyword: str, limit: int | None = 10) -> DataFrame:
    """Songs whose title or its translation contains the keyword, by id."""
    found = songs.where(S.like_ascii("title", keyword) | S.like_ascii("title_trans", keyword))
    return found if limit is None else found.orderBy("id").limit(limit)


def sung_often(songs: DataFrame, least: int) -> DataFrame:
    return songs.where(F.col("count") >= least)


def pick(songs: DataFrame, least: int, seed: int) -> DataFrame:
    """One song sung at least so often, at random by the seed."""
    return sung_often(songs, least).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)


def without_lyrics(songs: DataFrame, limit: int | None = None) -> DataFrame:
    rows = songs.where(F.col("lyrics").isNull() | (F.col("lyrics") == ""))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def recent_dates(performances: DataFrame, key: str, date: str, n: int = 5) -> DataFrame:
    """key, dates: the last n dates, newest first."""
    days = performances.select(key, date).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))
    top = days.withColumn("_r", rank).where(F.col("_r") <= n)
    return top.groupBy(key).agg(F.sort_array(F.collect_list(date), asc=False).alias("dates"))


def from_csv(rows: DataFrame) -> DataFrame:
    """Song rows of the sheet: ids that are no number are skipped, a count that is none is an error, lists become JSON."""
    #: The sheet's headings.
    names = {"序号": "id", "歌名": "title", "歌名翻译": "title_trans", "原唱": "original_singer", "日期": "records", "备注": "notes", "语言": "language", "次数": "count", "歌切": "clips", "标签": "tags"}
    text = {v: F.regexp_replace(F.coalesce(F.col(f"`{k}`"), F.lit("")), r"(?U)^\s+|\s+$", "") for k, v in names.items()}
    number = text["id"].try_cast("bigint")
    count = F.when(text["count"] == "", F.lit(0)).otherwise(text["count"].cast("bigint"))
    out = rows.where(number.isNotNull() & (number != 0))
    special = {"id": number, "count": count.cast("bigint"), "records": S.list_json(S.date_list(text["records"])), "clips": S.list_json(S.clip_list(text["clips"]))}
    return out.select(*[special.get(c, t).alias(c) for c, t in text.items()])


def best_match(songs: DataFrame, candidates: DataFrame, threshold: float = 0.9) -> DataFrame:
    """song id, candidate pos and scores of the best candidate, if both of its scores reach the threshold.

    ``candidates``: id, pos, c_title, c_artist, c_lyrics.  The best is chosen first - the
    earliest of equal sums - and then tested; blank lyrics never compete.
    """
    pairs = songs.select("id", "title", "original_singer").join(candidates.where(~S.blank("c_lyrics")), "id")
    scored = pairs.withColumns({"title_score": U.similarity("title", "c_title"), "artist_score": U.similarity("original_singer", "c_artist")})
    total = F.col("title_score") + F.col("artist_score")
    best = scored.where(total > 0).groupBy("id").agg(F.max_by(F.struct("pos", "title_score", "artist_score", "c_lyrics"), F.struct(total.alias("t"), F.negative("pos").alias("p"))).alias("x"))
    return best.select("id", "x.*").where((F.col("title_score") >= threshold) & (F.col("artist_score") >= threshold))
