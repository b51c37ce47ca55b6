"""Sources, and streams that equal their batch forms."""

import json
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import events as ev
from tidemark.operators import logs, sets
from tidemark.sources import files, rest
from tidemark.streaming import flows


def test_envelope():
    assert rest.envelope("u", {}, '{"code":0,"message":"","msg":"m"}')[:5] == (True, "u", "{}", 0, "m")
    assert rest.envelope("u", {}, "[1]")[3] == -1 and rest.envelope("u", {}, "junk")[0] is False
    calls = []

    def flaky(url, params):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return '{"code":0}'

    assert rest.request("u", {}, flaky, pause=0)[0] is True and len(calls) == 3
    assert rest.request("u", {}, lambda u, p: (_ for _ in ()).throw(OSError("gone")), attempts=2, pause=0)[4] == "gone"


def test_rest_source_and_records(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('{"code":0,"data":{"room_id":5,"uid":7,"title":"t","live_status":1}}')
    got = rest.read_rest(spark, [{"url": f"file://{tmp_path}/a.json"}, {"url": f"file://{tmp_path}/none.json"}], attempts=1, pause=0)
    assert rows(rest.records(got, "room"), "room_id", "uid") == [(5, 7)]
    assert rest.rejected(got).count() == 1
    bad = spark.createDataFrame([(True, "u", "{}", 0, "", '{"data":{}}')], rest.ENVELOPE)
    with pytest.raises(Exception):  # noqa: B017
        rest.records(bad, "room").collect()
    assert rows(rest.records(bad, "room", lenient=True), "room_id") == [(None,)]


def test_posts_and_samples(spark, rows):
    card = lambda i: {"desc": {"dynamic_id_str": str(i), "type": 2, "timestamp": i, "user_profile": {"info": {"uid": 1, "uname": "n"}}}, "card": "{}"}
    body = json.dumps({"data": {"cards": [card(2), card(1)]}})
    df = spark.createDataFrame([(True, "u", "{}", 0, "", body)], rest.ENVELOPE)
    assert [r.activity_id for r in rest.posts(df).orderBy("seq").collect()] == ["1", "2"]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = rest.samples(frame([(1,), (1,), (2,)], "room_id bigint"), frame([(1, 10), (2, 20)], "room_id bigint, uid bigint"), frame([(10, "a", 5), (20, "b", 6)], "uid bigint, uname string, fans_num bigint"), frame([(1, 3)], "room_id bigint, guard_num bigint"), frame([(10, 4), (20, 4)], "uid bigint, fan_club_num bigint"))
    assert rows(got) == [(1, 10, "a", 5, 3, 4)]


def test_sqlite(spark, rows, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE state (key TEXT PRIMARY KEY, value TEXT)")
        db.executemany("INSERT INTO state VALUES (?, ?)", [("a", 1), ("b", "x")])
    assert rows(files.read_sqlite(spark, path, "state")) == [("a", "1", None), ("b", "x", None)]
    assert files.read_sqlite(spark, path, "manager").count() == 0


def test_tables_and_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    files.create_missing(spark, root)
    files.create_missing(spark, root)
    files.append(spark.createDataFrame([("k", "v", None), (None, "v", None)], "key string, value string, updated_at string"), root, "state")
    assert files.read_table(spark, root, "state").count() == 1
    for stamp in ("1", "2", "3"):
        gone = files.snapshot(spark, root, f"file://{tmp_path}/snap", stamp)
    assert gone == ["snapshot=1"]
    assert files.with_missing_columns(spark.range(1).select("id"), "stats").columns[-1] == "created_at"


def test_sheet_and_logs(spark, rows, tmp_path):
    (tmp_path / "s.csv").write_text('﻿序号,歌名,备注\n1,"a\nb",\n2,c\n', encoding="utf-8")
    assert rows(files.read_song_sheet(spark, str(tmp_path / "s.csv"))) == [("1", "a\nb", ""), ("2", "c", "")]
    (tmp_path / "x.log").write_bytes(b"one\n\xfftwo\n")
    assert rows(files.read_logs(spark, str(tmp_path / "x.log")), "pos", "line") == [(0, "one"), (1, "two"), (2, "")]


def test_settings_and_rooms(spark, rows):
    assert files.parse_settings(["A=1", "# B=2", "", "A=3", "C='x=y'", "junk"], {"D": "4"}) == {"D": "4", "A": "1", "C": "x=y"}
    subs = spark.createDataFrame([(9,)], "room_id bigint")
    assert rows(files.wanted_rooms(spark, "1，2", None, subs)) == [(1,), (2,)]
    assert rows(files.wanted_rooms(spark, None, '{"rooms": ["3", "x", 4]}', subs)) == [(3,), (4,)]
    assert rows(files.wanted_rooms(spark, None, None, subs)) == [(9,)]
    with pytest.raises(ValueError):
        files.parse_rooms("1,x")


def _stream(spark, df, path, parts, order):
    """``df`` as a file stream, one file a batch, in ``order``."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _events(spark):
    kinds = ["LIVE", "LIVE", "PREPARING", "ROOM_CHANGE", "DANMU_MSG"]
    return spark.createDataFrame([(i, i % 3, kinds[(i * 7) % 5], None if i % 4 else "t", i) for i in range(60)], "id bigint, room_id bigint, cmd string, title string, timestamp bigint")


def test_live_stream_equals_batch(spark, rows, tmp_path):
    df = _events(spark)
    got = _drain(flows.live_events(_stream(spark, df, str(tmp_path / "in"), 5, "id")), "live", tmp_path)
    want = ev.with_repeats(df)
    assert rows(got, "id", "repeated") == rows(want, "id", "repeated")
    names = spark.createDataFrame([(1, None, "un")], "room_id bigint, nickname string, uname string")
    subs = spark.createDataFrame([(10, 1), (11, 2)], "group_id bigint, room_id bigint")
    assert rows(flows.outbox(got, names, subs)) == rows(ev.announcements(df, names, subs))


def test_ingest_stream(spark, rows, tmp_path):
    item = lambda cmd, **kw: {"room_id": 1, "cmd": cmd, "uid": 5, "uname": "u", "msg": "m", "gift_name": "g", "num": 3, "price": 7, "total_coin": 9, "title": "t", "time_ms": 1999, "start_time": 50, "live_time": None, "send_time": 61000} | kw
    raw = spark.createDataFrame([item("DANMU_MSG:4:0"), item("SEND_GIFT"), item("GUARD_BUY"), item("SUPER_CHAT_MESSAGE"), item("LIVE"), item("PREPARING"), item("ROOM_CHANGE"), item("OTHER"), item("PREPARING", send_time=None)], "room_id bigint, cmd string, uid bigint, uname string, msg string, gift_name string, num bigint, price bigint, total_coin bigint, title string, time_ms bigint, start_time bigint, live_time bigint, send_time bigint").withColumn("arrived", F.timestamp_seconds(F.lit(77)))
    want = [("DANMU_MSG", 5, None, None, 1), ("GUARD_BUY", 5, 3, 21, 50), ("LIVE", None, None, None, None), ("PREPARING", None, None, None, 61), ("ROOM_CHANGE", None, None, None, 77), ("SEND_GIFT", 5, 3, 9, 50), ("SUPER_CHAT_MESSAGE", 5, 1, 7, 50)]
    assert rows(flows.event_rows(raw), "cmd", "uid", "gift_num", "total_coin", "timestamp") == want
    stream = _stream(spark, raw, str(tmp_path / "in"), 3, "cmd")
    for _ in range(2):  # a second run finds nothing new
        flows.ingest(stream, str(tmp_path / "out"), str(tmp_path / "c"), every=None).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "cmd", "uid", "gift_num", "total_coin", "timestamp") == want


def test_log_stream(spark, rows, tmp_path):
    lines = ["orphan", "2024-01-02 03:04:05,123 - svc - INFO - a", " b", "2024-01-02 03:04:06,123 - svc - INFO - c", " d", "2024-01-02 03:04:07,123 - svc - INFO - e"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos bigint, line string")
    stream = flows.log_stream(_stream(spark, df, str(tmp_path / "in"), 3, "pos"), idle_ms=8000)
    q = stream.writeStream.format("memory").queryName("logs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    until = time.time() + 60
    while time.time() < until and spark.table("logs").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert rows(spark.table("logs"), "timestamp", "message") == rows(logs.records(df), "timestamp", "message")


def test_alert_stream(spark, rows, tmp_path):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([-101, -101, 5, -101, 0, -101], 1)], "key string, at bigint, code bigint")
    bad, good = F.col("code") == -101, F.col("code") == 0
    got = _drain(flows.alert_stream(_stream(spark, df, str(tmp_path / "in"), 3, "at"), bad, good), "alerts", tmp_path)
    assert rows(got.where("alert"), "at") == rows(sets.edge_alerts(df, "key", "at", bad, good).where("alert"), "at") == [(1,), (6,)]


def test_posts_stream(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, f"a{i % 4}", i % 2, 1000 + i) for i in range(12)], "id bigint, activity_id string, room_id bigint, timestamp bigint").withColumn("at", F.timestamp_seconds("timestamp"))
    stream = flows.new_posts(_stream(spark, df, str(tmp_path / "in"), 3, "id"))
    subs = spark.createDataFrame([(1, 0), (2, 1)], "group_id bigint, room_id bigint")
    flows.deliver_posts(stream, subs, str(tmp_path / "out"), str(tmp_path / "c"), now=F.timestamp_seconds(F.lit(1602)), most=600).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "group_id") == [(2, 1), (3, 2)]


def test_reconcile_step(spark):
    told, state = [], {1: True}
    step = flows.reconcile_each_batch(state, lambda: spark.createDataFrame([(2,)], "room_id bigint"), lambda room, what: told.append((room, what)))
    step(None, 0)
    step(None, 1)
    assert told == [(2, "start"), (1, "stop")] and state == {2: True}


def test_dataflow_zone(spark):
    assert spark.range(1).select(S.local_text(F.lit(0), "HH:mm:ss").alias("x")).first().x == "08:00:00"
