"""Control events and highlighted messages of rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.schemas import CONTROL


def newest_control(events: DataFrame) -> DataFrame:
    """The newest control event over all rooms; undated ones come last, ties go to the larger id."""
    return events.where(F.col("cmd").isin(*CONTROL)).orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(1)


def with_repeats(events: DataFrame) -> DataFrame:
    """Control events plus ``repeated``: LIVE after LIVE, or a title that is the room's last one.

    The previous row of each kind is a lag by room and id over the few control rows.  Two
    missing titles are the same title; a room's first row repeats nothing.
    """
    control = events.where(F.col("cmd").isin(*CONTROL))
    kind = F.when(F.col("cmd") == "ROOM_CHANGE", 1).otherwise(0)
    before = Window.partitionBy("room_id", "kind").orderBy("id")
    lagged = control.withColumn("kind", kind).withColumns({"p_id": F.lag("id").over(before), "p_cmd": F.lag("cmd").over(before), "p_title": F.lag("title").over(before)})
    streaming = (F.col("cmd") == "LIVE") & F.coalesce(F.col("p_cmd") == "LIVE", F.lit(False))
    same_title = (F.col("cmd") == "ROOM_CHANGE") & F.col("p_id").isNotNull() & F.col("title").eqNullSafe(F.col("p_title"))
    return lagged.withColumn("repeated", streaming | same_title).drop("kind", "p_id", "p_cmd", "p_title")


def messages(events: DataFrame, names: DataFrame, mode: str = "lossless") -> DataFrame:
    """id, room and message of what the groups of a room are told.

    ``lossless`` tells every event that repeats nothing, once; ``poll`` tells only the
    newest control event, as a poller that finds several would.
    """
    if mode not in ("lossless", "poll"):
        raise ValueError(f"unknown mode {mode!r}")
    told = with_repeats(events)
    if mode == "poll":
        told = told.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(1)
    told = told.where(~F.col("repeated"))
    named = told.join(names.select("room_id", S.first_not_blank("nickname", "uname").alias("name")), "room_id", "left")
    return named.select("id", "room_id", S.announcement("cmd", "name", "title", "room_id").alias("message")).where("message is not null")


def announcements(events: DataFrame, names: DataFrame, subscriptions: DataFrame, mode: str = "lossless") -> DataFrame:
    """group_id, event id, room and message: ``messages`` for each group of the room."""
    told = messages(events, names, mode)
    return told.join(subscriptions.select("room_id", "group_id"), "room_id").select("group_id", "id", "room_id", "message")


def announced(told: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """group_id, n, least, last_id: how much each group is told, without a row for each message and group.

    Messages are counted by room first, so the join has a row a room on one side.
    """
    rooms = told.groupBy("room_id").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("least"), F.max("id").alias("last_id"))
    joined = subscriptions.select("room_id", "group_id").join(rooms, "room_id")
    return joined.groupBy("group_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("last_id").alias("last_id"))


def day_messages(events: DataFrame, room_id: int | None, day: str, zone: str = S.ZONE, cmd: str = "SUPER_CHAT_MESSAGE") -> DataFrame:
    """Events of one command in a room (or all) on a local day, in time order."""
    first, last = S.day_bounds(day, zone)
    rows = events.where((F.col("cmd") == cmd) & F.col("timestamp").between(first, last))
    return rows if room_id is None else rows.where(F.col("room_id") == room_id)


def message_pages(rows: DataFrame, chunk: int = 40, zone: str = S.ZONE) -> DataFrame:
    """Rows of each room's day with part number, whether the part is full, band, colours and local time."""
    by_room = Window.partitionBy("room_id")
    rn = F.row_number().over(by_room.orderBy("timestamp", "id"))
    part = F.floor((rn - 1) / chunk) + 1
    paged = rows.withColumn("part", part.cast("bigint")).withColumn("full", F.count(F.lit(1)).over(Window.partitionBy("room_id", "part")) == chunk)
    return paged.withColumns({"band": S.price_band("total_coin"), "colour": S.price_colour("total_coin"), "text_colour": S.text_colour("total_coin"), "price": S.price_text("total_coin"), "at": S.local_text("timestamp", "HH:mm:ss", zone)})


def page_files(pages: DataFrame, day: str, as_of: str, existing: DataFrame | None = None) -> DataFrame:
    """room_id, part, file, rows of the pages to draw.

    A part is permanent once it is full or its day is past, else it is the day's open
    page.  Permanent parts that exist are not made again.
    """
    parts = pages.groupBy("room_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full"))
    done = F.col("full") | F.lit(day < as_of)
    out = parts.select("room_id", "part", "n", F.when(done, F.concat(F.lit("part_"), F.col("part").cast("string"))).otherwise("today").alias("file"))
    return out if existing is None else out.join(existing.where("file != 'today'").select("room_id", "file"), ["room_id", "file"], "left_anti")


def page_count(rows: DataFrame, chunk: int = 40) -> DataFrame:
    """How many pages the rows fill, one at least."""
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / chunk)).cast("bigint").alias("pages"))
