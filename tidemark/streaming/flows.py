"""Continuous flows with Structured Streaming.

Sources are any streaming DataFrame of the stated columns; sinks commit by batch id, so
a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import scalars as S
from tidemark.operators import logs
from tidemark.schemas import CONTROL, TRACKED

# Ingest

#: Fixed value: what a raw command may hold, flattened.
RAW = "room_id bigint, cmd string, arrived timestamp, uid bigint, uname string, msg string, gift_name string, num bigint, price bigint, total_coin bigint, title string, time_ms bigint, start_time bigint, live_time bigint, send_time bigint"


def event_rows(raw: DataFrame) -> DataFrame:
    """Event columns of raw commands; commands that aren't tracked, or lack what gives their time, are left out.

    Stateless, so it is the same on a stream.  A LIVE may lack its time; ROOM_CHANGE
    takes its arrival time.
    """
    cmd = S.command_name("cmd")
    rows = raw.withColumn("cmd", cmd).where(F.col("cmd").isin(*TRACKED))
    c = F.col("cmd")
    viewer = c.isin("DANMU_MSG", "SEND_GIFT", "GUARD_BUY", "SUPER_CHAT_MESSAGE")
    paid = c.isin("SEND_GIFT", "GUARD_BUY", "SUPER_CHAT_MESSAGE")
    time = (
        F.when(c == "DANMU_MSG", S.epoch_seconds("time_ms"))
        .when(paid, F.col("start_time"))
        .when(c == "LIVE", F.col("live_time"))
        .when(c == "PREPARING", S.epoch_seconds("send_time"))
        .otherwise(F.unix_timestamp("arrived"))
    )
    out = rows.select(
        "room_id",
        "cmd",
        F.when(viewer, F.col("uid")).alias("uid"),
        F.when(viewer, F.col("uname")).alias("uname"),
        F.when(c.isin("DANMU_MSG", "SUPER_CHAT_MESSAGE"), F.col("msg")).alias("content"),
        F.when(paid, F.col("gift_name")).alias("gift_name"),
        F.when(c == "SUPER_CHAT_MESSAGE", F.lit(1).cast("bigint")).when(paid, F.col("num")).alias("gift_num"),
        F.when(c == "SEND_GIFT", F.col("total_coin")).when(c == "GUARD_BUY", F.col("price") * F.col("num")).when(c == "SUPER_CHAT_MESSAGE", F.col("price")).alias("total_coin"),
        F.when(c == "ROOM_CHANGE", F.col("title")).alias("title"),
        time.alias("timestamp"),
    )
    return out.where((F.col("cmd") == "LIVE") | F.col("timestamp").isNotNull())


def once_per_batch(root: str, write: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch is a folder of its own, replaced if the batch runs again."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        target = f"{root}/batch={batch_id:012d}"
        write(batch, target) if write else batch.write.mode("overwrite").parquet(target)

    return sink


def ingest(raw: DataFrame, root: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Write event rows as they come; ``every`` None takes what is there and stops."""
    out = event_rows(raw).writeStream.foreachBatch(once_per_batch(root)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


# Control events


def _repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Flags repeats by the room's last broadcast command and its last title, kept between batches."""
    command, has_title, title = state.get if state.exists else ("", False, None)
    rows = pd.concat(list(batches)).sort_values("id")
    flags = []
    for c, t in zip(rows["cmd"], rows["title"], strict=True):
        t = None if pd.isna(t) else t
        if c == "ROOM_CHANGE":
            flags.append(has_title and t == title)
            has_title, title = True, t
        else:
            flags.append(c == "LIVE" and command == "LIVE")
            command = c
    state.update((command, has_title, title))
    yield rows.assign(repeated=flags)


def live_events(events: DataFrame) -> DataFrame:
    """Control events (id, room_id, cmd, title, timestamp) with ``repeated``, per room over the whole stream."""
    control = events.where(F.col("cmd").isin(*CONTROL)).select("id", "room_id", "cmd", "title", "timestamp")
    out = "id bigint, room_id bigint, cmd string, title string, timestamp bigint, repeated boolean"
    return control.groupBy("room_id").applyInPandasWithState(_repeats, out, "command string, has_title boolean, title string", "append", GroupStateTimeout.NoTimeout)


def outbox(events: DataFrame, names: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages per group of events that repeat nothing; names and subscriptions are static."""
    told = events.where(~F.col("repeated")).join(names.select("room_id", S.first_not_blank("nickname", "uname").alias("name")), "room_id", "left")
    message = told.withColumn("message", S.announcement("cmd", "name", "title", "room_id")).where("message is not null")
    return message.join(subscriptions.select("room_id", "group_id"), "room_id").select("group_id", "id", "room_id", "message")


# Posts


def new_posts(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of each activity_id (event time ``at``), as far back as the delay."""
    return posts.withWatermark("at", delay).dropDuplicatesWithinWatermark(["activity_id"])


def deliver_posts(posts: DataFrame, subscriptions: DataFrame, root: str, checkpoint: str, now: Column | None = None, most: int = 600) -> StreamingQuery:
    """Fresh posts per group; the checkpoint, which is the cursor, moves over stale ones as well."""
    age = F.unix_timestamp(F.current_timestamp() if now is None else now) - F.col("timestamp")
    out = posts.where(age <= most).join(subscriptions.select("room_id", "group_id"), "room_id")
    return out.writeStream.foreachBatch(once_per_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Logs


def _open_record(idle_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits a record when the next header comes, or when the file has been idle; later lines without a header are dropped."""
    columns = ["file", "timestamp", "logger", "level", "message", "type"]
    held = json.loads(state.get[0]) if state.exists else None
    done = []
    if state.hasTimedOut:
        if held:
            done.append([key[0], *held])
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("pos")
        for r in rows.itertuples():
            if r.type is not None and not pd.isna(r.type):
                if held:
                    done.append([key[0], *held])
                held = [r.timestamp, r.logger, r.level, r.message, r.type]
            elif held:
                held[3] += "\n" + r.line
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(done, columns=columns)


def log_stream(lines: DataFrame, idle_ms: int = 1000) -> DataFrame:
    """Records of a stream of log lines (file, pos, line).

    Idle flushes need a trigger that goes on; with ``availableNow`` a query that keeps
    timeouts doesn't end.
    """
    clean = lines.select("file", "pos", S.clean_line("line").alias("line")).where("line != ''")
    headed = clean.withColumn("h", S.log_header("line")).select("file", "pos", "line", "h.timestamp", "h.logger", "h.level", "h.message", "h.type")
    out = "file string, timestamp string, logger string, level string, message string, type string"
    return headed.groupBy("file").applyInPandasWithState(functools.partial(_open_record, idle_ms), out, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


# Alerts


def _latch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    set_ = state.get[0] if state.exists else False
    rows, flags = pd.concat(list(batches)).sort_values("at"), []
    for kind in rows["kind"]:
        flags.append(kind == "bad" and not set_)
        set_ = kind == "bad"
    state.update((set_,))
    yield rows.assign(alert=flags)


def alert_stream(samples: DataFrame, bad: Column, good: Column) -> DataFrame:
    """Samples (key, at) that are bad or good, with ``alert`` on the first bad one since a good one."""
    marked = samples.withColumn("kind", F.when(bad, "bad").when(good, "good")).where("kind is not null").select("key", "at", "kind")
    return marked.groupBy("key").applyInPandasWithState(_latch, "key string, at bigint, kind string, alert boolean", "latched boolean", "append", GroupStateTimeout.NoTimeout)


# Rooms and schedules


def reconcile_each_batch(state: dict[int, bool], wanted: Callable[[], DataFrame], act: Callable[[int, str], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that starts and stops rooms to match the wanted ones (a handful)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rooms = {r.room_id for r in wanted().select("room_id").distinct().collect()}
        for room in sorted(rooms - set(state)):
            act(room, "start")
            state[room] = True
        for room in sorted(set(state) - rooms):
            act(room, "stop")
            del state[room]

    return step


def run_once(query: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For an outer schedule: take what is new since the last run, then stop."""
    return query.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_records(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """What ``log_stream`` must equal over a finished log."""
    return logs.records(lines)
