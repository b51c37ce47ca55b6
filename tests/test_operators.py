"""Hand-made cases: null, blank and tie semantics of each operator."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import udfs as U
from tidemark.operators import activity as ac
from tidemark.operators import events as ev
from tidemark.operators import identity as idn
from tidemark.operators import logs, merge, sets, songs, trends
from tidemark.schemas import SCHEMAS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def events(spark, items):
    """(id, room, cmd, title, timestamp) rows as events."""
    df = spark.createDataFrame(items, "id bigint, room_id bigint, cmd string, title string, timestamp bigint")
    return df.withColumns({c: F.lit(None).cast(k) for c, k in (f.strip().split(" ") for f in SCHEMAS["event"].split(",")) if c not in df.columns})


CONTROL = [(1, 1, "LIVE", None, 1), (2, 1, "LIVE", None, 2), (3, 1, "PREPARING", None, 3), (4, 1, "LIVE", None, 4), (5, 1, "ROOM_CHANGE", None, 5), (6, 1, "ROOM_CHANGE", None, 6), (7, 1, "ROOM_CHANGE", "a", 7), (8, 1, "ROOM_CHANGE", "a", 8), (9, 1, "LIVE", None, None)]


def test_repeats_and_newest(spark):
    flagged = ev.with_repeats(events(spark, CONTROL))
    assert {r.id for r in flagged.where("repeated").collect()} == {2, 6, 8, 9}
    assert ev.newest_control(events(spark, CONTROL)).first().id == 8
    assert ev.newest_control(events(spark, [])).count() == 0


def test_announcements(spark, rows):
    names = spark.createDataFrame([(1, " ", "un")], "room_id bigint, nickname string, uname string")
    subs = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "group_id bigint, room_id bigint")
    told = ev.announcements(events(spark, CONTROL), names, subs)
    assert rows(told.where("group_id = 10"), "id", "message") == [(1, "un开播了！"), (3, "un下播了..."), (4, "un开播了！"), (7, "un把直播标题修改为：a")]
    assert told.where("group_id = 12").count() == 0
    assert ev.announcements(events(spark, CONTROL), names, subs, "poll").count() == 0
    with pytest.raises(ValueError):
        ev.announcements(events(spark, []), names, subs, "often")


def test_day_bounds_and_pages(spark, rows):
    first, last = one(spark, *S.day_bounds("2024-01-03"))
    assert (first, last) == (1704211200, 1704297599)
    items = [(i, 1, "SUPER_CHAT_MESSAGE", None, t) for i, t in enumerate([first - 1, first, first + 5, last, last + 1, None])]
    day = ev.day_messages(events(spark, items).withColumn("total_coin", F.lit(30).cast("bigint")), 1, "2024-01-03")
    pages = ev.message_pages(day, chunk=2)
    assert rows(pages, "id", "part", "full", "at") == [(1, 1, True, "00:00:00"), (2, 1, True, "00:00:05"), (3, 2, False, "23:59:59")]
    assert rows(ev.page_files(pages, "2024-01-03", "2024-01-03"), "part", "file") == [(1, "part_1"), (2, "today")]
    old = spark.createDataFrame([(1, "part_1"), (1, "today")], "room_id bigint, file string")
    assert rows(ev.page_files(pages, "2024-01-03", "2024-01-04", old), "file") == [("part_2",)]
    assert ev.page_count(day.limit(0), 40).first().pages == 1


def test_name_history(spark):
    history = spark.createDataFrame([(1, "A", 50), (2, "C", 5)], "uid bigint, uname string, first_seen bigint")
    seen = events(spark, []).select("uid", "uname", "timestamp").unionByName(spark.createDataFrame([(1, "B", 10), (1, "A", 5), (1, "B", 60), (2, "C", 9), (None, "x", 1)], "uid bigint, uname string, timestamp bigint"))
    both = idn.sightings(seen, history)
    got = {r.uid: r.names for r in idn.name_history(both).collect()}
    assert got == {1: ["A", "B"], 2: ["C"]}
    assert [r.uid for r in idn.history_of(both, "C").collect()] == [2]
    assert [r.uid for r in idn.history_of(both, "1").collect()] == [1]
    assert idn.history_of(idn.sightings(seen, None), "absent").count() == 0


def test_optional_table(spark):
    assert idn.optional_table(spark, "no_such_table_here", "uid bigint").count() == 0


def test_trends(spark, rows):
    points = [(1, 1, 10, 5), (2, 1, 10, 6), (3, 1, 9, 7), (4, 1, 11, -1), (5, 1, 11, 8), (6, 1, 12, 9), (7, 2, 1, 4)]
    df = spark.createDataFrame(points, "id bigint, k bigint, t bigint, v bigint")
    kept = trends.cleaned_by_arrival(df, "k", "t", "v", "id")
    assert rows(kept.where("k = 1"), "t", "v") == [(10, 5), (11, 8), (12, 9)]
    s = trends.summary(kept, "k", "t", "v").collect()
    assert len(s) == 1 and (s[0].first, s[0].last, s[0].delta, s[0].axis_lo, s[0].axis_hi) == (5, 9, "+4", 3.0, 11.0)
    # In time order the earlier time comes first.
    assert rows(trends.cleaned(df, "k", "t", "v").where("k = 1"), "t", "v") == [(10, 5), (11, 8), (12, 9), (9, 7)]


def test_resample(spark):
    df = spark.createDataFrame([(1, float(t), float(t**3)) for t in range(6)] + [(2, 0.0, 1.0), (2, 1.0, 2.0), (3, 0.0, 1.0)], "k bigint, t double, v double")
    got = U.resample(df, "k", "t", "v").toPandas()
    cubic = got[got.k == 1]
    assert len(cubic) == 300 and abs(cubic.v - cubic.t**3).max() < 1e-9 and cubic.tick.sum() == 5
    assert len(got[got.k == 2]) == 2 and len(got[got.k == 3]) == 0


def test_scalars(spark):
    bands = {p: one(spark, S.price_band(F.lit(p)).alias("x")).x for p in (1, 2, 29, 30, 49, 50, 99, 100, 499, 500, 999, 1000, 1999, 2000)}
    assert bands == {1: 0, 2: 2, 29: 2, 30: 30, 49: 30, 50: 50, 99: 50, 100: 100, 499: 100, 500: 500, 999: 500, 1000: 1000, 1999: 1000, 2000: 2000}
    days = {d: one(spark, S.relative_day(F.lit(d), "2024-03-10").alias("x")).x for d in ("2024-03-10", "2024-03-09", "2024-03-04", "2024-03-03", "2024-02-09", "2023-03-10", "2024-03-12", "junk")}
    assert list(days.values()) == ["今天", "昨天", "6天前", "1周前", "1个月前", "1年前", "-2天前", "junk"]
    assert one(spark, S.date_list(F.lit("2023/1/5， 2023/01/06，，x")).alias("x")).x == ["2023-01-05", "2023-01-06", "x"]
    assert one(spark, S.date_list(F.lit(" ")).alias("x")).x == []
    assert one(spark, S.epoch_seconds(F.lit(-1)).alias("x")).x == -1
    assert one(spark, S.command_name(F.lit(None).cast("string")).alias("x")).x == ""
    assert one(spark, S.json_list(F.lit("{}")).alias("a"), S.json_list(F.lit('["x"]')).alias("b")) == ([], ["x"])
    assert one(spark, S.first_not_blank(F.lit("　\t"), F.lit(" n ")).alias("x")).x == " n "
    assert one(spark, S.signed(F.lit(0)).alias("x")).x == "+0"
    assert [S.days_argument(x) for x in ("3天", "7", " 2 日", "x", None, "", "²")] == [3, 7, 2, 1, 1, 1, 1]
    for wrong in ("8", "0", "30天"):
        with pytest.raises(ValueError):
            S.days_argument(wrong)
    today = datetime.date(2024, 5, 6)
    assert [S.date_argument(x, today) for x in (None, "  ", " 2024-01-03 ")] == [today, today, datetime.date(2024, 1, 3)]
    for wrong in ("2024/1/3", "2024-02-30", "x"):
        with pytest.raises(ValueError):
            S.date_argument(wrong, today)
    assert one(spark, S.shifted_text(F.lit("2024-01-01 20:00:00.9")).alias("a"), S.shifted_text(F.lit("junk")).alias("b")) == ("2024-01-02 04:00:00", None)
    assert one(spark, S.popularity(F.lit("12")).alias("a"), S.popularity(F.lit("1x")).alias("b")) == (12, None)


def test_like(spark, rows):
    df = spark.createDataFrame([(1, "Ä", None), (2, "Lemon", None), (3, "axb", None), (4, "z", "a\\b")], "id bigint, title string, title_trans string")
    find = lambda k: [r.id for r in songs.search(df, k, None).collect()]
    assert (find("ä"), find("LEMON"), find("a_b"), find("\\")) == ([], [2], [3, 4], [4])


def test_widths():
    cut = {t: U.truncated(t, 18) for t in ("123456789012345678", "1234567890123456789", "直播间的观众朋友们好", "abcdefghijklmn直播间", "é" * 9, "é" * 10)}
    assert list(cut.values()) == ["123456789012345678", "123456789012345...", "直播间的观众朋...", "abcdefghijklmn...", "é" * 9, "é" * 7 + "..."]
    assert U.wrapped("hello big world", 9) == "hello big\nworld"
    assert U.wrapped("incomprehensible a", 5) == "incomprehensible\n a"
    assert U.wrapped("", 5) == ""


def test_cards(spark):
    video, post = '{"owner":{"name":"o"},"title":"t"}', '{"user":{},"owner":{"name":"ow"},"item":{"description":"","content":"c","pictures":[{"img_src":"p"}]},"origin":"{\\"user\\":{\\"name\\":\\"q\\"},\\"item\\":{\\"description\\":\\"x\\"}}"}'
    df = spark.createDataFrame([(1, video, 8), (2, post, 2), (3, "{}", 1), (4, "junk", 2)], "id bigint, card string, dy_type bigint").withColumn("orig_type", F.lit(2))
    got = {r.id: r for r in ac.cards(df).collect()}
    assert (got[1].username, got[1].text) == ("o", "▶ 视频：t")
    assert (got[2].username, got[2].text, got[2].pics, got[2].quoted) == ("ow", "c", "p", "@q: x")
    assert (got[3].username, got[3].text, got[4].username) == ("未知", "", "未知")


def test_grid(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, list("abcd")), (3, list("abcde"))], "id bigint, urls array<string>")
    got = {(r.id, r.url): (r.col, r.row, r.cols, r.rows) for r in ac.picture_cells(df, "id", "urls").collect()}
    assert got[1, "a"] == (0, 0, 1, 1) and got[2, "d"] == (1, 1, 2, 2) and got[3, "e"] == (1, 1, 3, 2)


def test_emoji(spark):
    df = spark.createDataFrame([("a[x]b[xy]", ["[x]", "[xy]"]), (None, ["[x]"]), ("q", None)], "t string, k array<string>")
    assert [r[0] for r in df.select(U.emoji_tokens("t", "k")).collect()] == [["a", "[x]", "b", "[xy]"], [], ["q"]]


def test_folds(spark, rows):
    log = spark.createDataFrame([(1, "a", "p", 1), (1, "b", None, 2), (1, "", "q", 3)], "id bigint, title string, x string, seq bigint")
    assert rows(merge.last_known(log, ["id"], "seq", ["title", "x"])) == [(1, "", "q")]
    assert rows(merge.last_write(log, ["id"], "seq"), "title", "x") == [("", "q")]
    acts = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, None), (4, "k2")], "seq bigint, key string")
    flagged = merge.insert_or_ignore(acts, ["key"], "seq", ["key"])
    assert rows(flagged, "seq", "inserted") == [(1, True), (2, False), (3, False), (4, True)]
    assert rows(merge.inserted_ids(flagged, "seq"), "id") == [(1,), (4,)]
    subs = spark.createDataFrame([(1, 1, "dev", None, 1), (1, 2, "set", 5, None), (1, 3, "dev", None, 1), (1, 4, "set", 6, None), (2, 5, "set", 7, None), (2, 6, "remove", None, None), (3, 7, "dev", None, 1)], "group_id bigint, seq bigint, op string, room_id bigint, dev int")
    assert rows(merge.subscription_state(subs)) == [(1, 6, 1)]
    members = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "group_id bigint, manager_qq bigint")
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 2, 1), (4, 2, 2), (5, 2, 1), (6, 2, 2)], "seq bigint, group_id bigint, manager_qq bigint")
    assert rows(merge.guarded_removal(members, asked), "seq", "outcome") == [(1, "refused"), (2, "absent"), (3, "removed"), (4, "refused"), (5, "absent"), (6, "refused")]


def test_guarded_removal_against_a_loop(spark, rows):
    rng = random.Random(6)
    members = {(rng.randrange(6), rng.randrange(8)) for _ in range(20)}
    asked = [(k, rng.randrange(7), rng.randrange(8)) for k in range(150)]
    left, want = set(members), []
    for k, g, m in asked:
        here = (g, m) in left
        last = here and sum(x == g for x, _ in left) <= 1
        want.append((k, "refused" if last else "removed" if here else "absent"))
        if here and not last:
            left.discard((g, m))
    got = merge.guarded_removal(spark.createDataFrame(list(members) * 2, "group_id bigint, manager_qq bigint"), spark.createDataFrame(asked, "seq bigint, group_id bigint, manager_qq bigint"))
    assert rows(got, "seq", "outcome") == sorted(want, key=repr)


def test_numbered(spark, rows):
    keys = random.Random(7).sample(range(10**9), 300)
    got = idn.numbered(spark.createDataFrame([(k,) for k in keys], "uid bigint"), "uid", parts=7)
    assert rows(got, "n", "uid") == sorted(((n, k) for n, k in enumerate(sorted(keys), 1)), key=repr)
    assert idn.numbered(spark.createDataFrame([], "uid bigint"), "uid").count() == 0


def test_spline_against_a_dense_solve():
    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 40):
        x, y = np.cumsum(rng.uniform(0.5, 3, n)), rng.normal(size=n)
        # One cubic a piece; values meet, first and second derivatives agree, thirds at the outer inner knots too.
        rows, right = [], []
        power = lambda d, k: [np.prod(range(p - k + 1, p + 1)) * d ** (p - k) if p >= k else 0.0 for p in range(4)]
        for i in range(n - 1):
            for at, value in ((0.0, y[i]), (x[i + 1] - x[i], y[i + 1])):
                rows.append([0.0] * 4 * i + power(at, 0) + [0.0] * 4 * (n - 2 - i))
                right.append(value)
        for i in range(n - 2):
            for k in (1, 2, *([3] if i in (0, n - 3) else [])):
                row = [0.0] * 4 * (n - 1)
                row[4 * i : 4 * i + 4], row[4 * i + 4 : 4 * i + 8] = power(x[i + 1] - x[i], k), [-v for v in power(0.0, k)]
                rows.append(row)
                right.append(0.0)
        c = np.linalg.lstsq(np.array(rows, float), np.array(right), rcond=None)[0].reshape(-1, 4)
        at = np.linspace(x[0], x[-1], 50)
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        want = sum(c[i, p] * (at - x[i]) ** p for p in range(4))
        assert np.allclose(U.not_a_knot(x, y, at), want, atol=1e-7)


def test_keep_newest_repeats(spark, rows):
    files = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    assert rows(sets.keep_newest(files, "name", 2), "name", "delete") == [("a", True), ("b", False), ("b", False), ("c", False)]


def test_fold_against_a_loop(spark, rows):
    import random

    random.seed(5)
    ops = [(random.randrange(4), i, random.choice(["set", "dev", "remove"]), random.randrange(9), random.randrange(2)) for i in range(200)]
    table: dict = {}
    for g, _, op, room, dev in ops:
        if op == "set":
            table[g] = (room, table[g][1] if g in table else 0)
        elif op == "dev" and g in table:
            table[g] = (table[g][0], dev)
        elif op == "remove":
            table.pop(g, None)
    df = spark.createDataFrame(ops, "group_id bigint, seq bigint, op string, room_id bigint, dev int")
    assert rows(merge.subscription_state(df)) == sorted(((g, *v) for g, v in table.items()), key=repr)


def test_sets(spark, rows):
    a = spark.createDataFrame([(1,), (2,)], "room_id bigint")
    b = spark.createDataFrame([(2,), (3,), (3,)], "room_id bigint")
    assert rows(sets.reconcile(a, b)) == [(1, "stop"), (3, "start")]
    files = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "name string")
    assert rows(sets.keep_newest(files, "name", 2).where("delete"), "name") == [("1",), ("2",)]
    assert sets.keep_newest(files, "name", 0).where("delete").count() == 0
    codes = spark.createDataFrame(list(enumerate([-101, -101, 5, -101, 0, -101], 1)), "at bigint, code bigint").withColumn("k", F.lit(1))
    fired = sets.edge_alerts(codes, "k", "at", F.col("code") == -101, F.col("code") == 0)
    assert rows(fired.where("alert"), "at") == [(1,), (6,)]
    assert sets.largest(a.limit(0), "room_id").first().top == 0


def test_best_match(spark, rows):
    own = spark.createDataFrame([(1, "Lemon Tree", "Fools"), (2, "x", "y")], "id bigint, title string, original_singer string")
    cand = spark.createDataFrame([(1, 0, "lemon-tree", "Fools", " "), (1, 1, "lemon-tree", "fools", "la"), (1, 2, "Lemon Tree", "Fools", "late"), (2, 0, "x", "q", "la"), (2, 1, None, None, "la")], "id bigint, pos bigint, c_title string, c_artist string, c_lyrics string")
    assert rows(songs.best_match(own, cand), "id", "pos") == [(1, 1)]


def test_song_sheet(spark):
    sheet = spark.createDataFrame([("1", "歌", "", "s", "2023/1/5", "", "c", "2", "a,b", ""), ("x", "q", "", "", "", "", "", "", "", "")], "`序号` string, `歌名` string, `歌名翻译` string, `原唱` string, `日期` string, `备注` string, `语言` string, `次数` string, `歌切` string, `标签` string")
    got = songs.from_csv(sheet).collect()
    assert len(got) == 1 and (got[0].id, got[0].records, got[0]["count"], got[0].clips) == (1, '["2023-01-05"]', 2, '["a","b"]')
    with pytest.raises(Exception):  # noqa: B017
        songs.from_csv(sheet.withColumn("次数", F.lit("many"))).collect()


LINES = ["orphan", "2024-01-02 03:04:05,123 - svc - INFO - first", " more", "", "\x1b[31mred\x1b[0m", "01-02 03:04:05 [info] nonebot | hello", "01-02 03:04:06 [WARN] other | hey", "2024-01-02 03:04:05,123 - ERROR - lost"]


def test_logs(spark, rows):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(LINES)], "file string, pos bigint, line string")
    got = rows(logs.records(df), "n", "timestamp", "logger", "level", "message", "type")
    assert got == [(1, "01-02 03:04:05", "svc", "INFO", "first\n more\nred", "custom"), (2, "01-02 03:04:05", "nonebot", "INFO", "hello", "nonebot"), (3, "01-02 03:04:06", "other", "WARN", "hey", "napcat"), (4, "01-02 03:04:05", "lyrics", "ERROR", "lost", "lyrics")]
    five = spark.createDataFrame([(i,) for i in range(1, 6)], "n bigint")
    assert [sorted(r.n for r in logs.page(five, "n", o, 2).collect()) for o in (0, 2, 4, 5)] == [[4, 5], [2, 3], [1], []]
