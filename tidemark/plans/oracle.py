"""The queries of ``catalog`` in DuckDB SQL, written on their own over the driver's tables."""

from __future__ import annotations

_EPOCH = "CAST(floor(epoch({0})) AS BIGINT)"

EVENT = f"""event AS (
  SELECT event_id AS id, user_id % 8 AS room_id,
    CASE event_type WHEN 'click' THEN 'DANMU_MSG'
      WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'SEND_GIFT' ELSE 'GUARD_BUY' END
      WHEN 'purchase' THEN 'SUPER_CHAT_MESSAGE' WHEN 'signup' THEN 'LIVE'
      ELSE CASE WHEN event_id % 3 = 0 THEN 'ROOM_CHANGE' ELSE 'PREPARING' END END AS cmd,
    CASE WHEN event_type IN ('click','view','purchase') THEN user_id END AS uid,
    CASE WHEN event_type IN ('click','view','purchase') THEN 'u' || user_id || '_' || event_id % 3 END AS uname,
    CASE WHEN event_type IN ('view','purchase') THEN 'g' || event_id % 5 END AS gift_name,
    CASE WHEN event_type IN ('view','purchase') THEN CAST(floor(value) AS BIGINT) END AS total_coin,
    CASE WHEN event_type NOT IN ('click','view','purchase','signup') AND event_id % 3 = 0 AND event_id % 4 <> 0 THEN 't' || event_id % 4 END AS title,
    CASE WHEN NOT (event_type = 'signup' AND event_id % 5 = 0) THEN {_EPOCH.format("ts")} END AS timestamp
  FROM events)"""
CONTROL = f"""{EVENT}, control AS (
  SELECT *, lag(id) OVER w AS p_id, lag(cmd) OVER w AS p_cmd, lag(title) OVER w AS p_title
  FROM event WHERE cmd IN ('LIVE','PREPARING','ROOM_CHANGE')
  WINDOW w AS (PARTITION BY room_id, cmd = 'ROOM_CHANGE' ORDER BY id)),
told AS (SELECT *, (cmd = 'LIVE' AND p_cmd IS NOT DISTINCT FROM 'LIVE')
  OR (cmd = 'ROOM_CHANGE' AND p_id IS NOT NULL AND title IS NOT DISTINCT FROM p_title) AS repeated FROM control)"""
STATS = """stats AS (
  SELECT o_orderkey AS id, o_custkey % 8 AS room_id,
    CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS fans_num,
    CASE WHEN o_orderkey % 70 = 0 THEN -1 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS guard_num,
    CASE WHEN o_orderkey % 90 = 0 THEN -1 ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS fan_club_num,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders)"""
LIVER = """liver AS (
  SELECT s_suppkey AS room_id, CAST(s_nationkey AS BIGINT) AS uid, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS uname,
    CASE s_suppkey % 3 WHEN 1 THEN '  ' WHEN 2 THEN 'nick' || s_suppkey END AS nickname FROM supplier),
names AS (SELECT *, CASE WHEN trim(nickname) <> '' THEN nickname WHEN trim(uname) <> '' THEN uname END AS name FROM liver)"""
SUBSCRIPTION = "subscription AS (SELECT c_custkey AS group_id, c_custkey % 11 AS room_id, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS dev FROM customer)"
MANAGER = "manager AS (SELECT DISTINCT l_orderkey % 100 AS group_id, l_suppkey AS manager_qq FROM lineitem)"
SONGS = """songs AS (
  SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS title_trans, CAST(p_size AS BIGINT) AS count,
    CASE p_partkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'la' || p_partkey END AS lyrics FROM part)"""
SEEN = f"""{EVENT}, seen AS (
  SELECT uid, uname, timestamp AS ts FROM event WHERE uid IS NOT NULL
  UNION ALL SELECT o_custkey, o_orderpriority, {_EPOCH.format("o_orderdate")} FROM orders),
first_seen AS (SELECT uid, uname, min(ts) AS ts FROM seen GROUP BY uid, uname),
history AS (SELECT uid, string_agg(uname, '|' ORDER BY ts NULLS FIRST, uname) AS names, arg_max(uname, ROW(ts, uname)) AS last_name FROM first_seen GROUP BY uid)"""
_DAY = "epoch(TIMESTAMP '2024-01-03') - 28800"
SUPERCHAT = f"""{EVENT}, day AS (
  SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY timestamp, id) AS rn FROM event
  WHERE cmd = 'SUPER_CHAT_MESSAGE' AND timestamp >= {_DAY} AND timestamp < {_DAY} + 86400),
paged AS (SELECT *, (rn - 1) // 3 + 1 AS part FROM day)"""
_COLOUR = "CASE WHEN total_coin >= 2000 THEN '#AB1A32' WHEN total_coin >= 1000 THEN '#E54D4D' WHEN total_coin >= 500 THEN '#E09443' WHEN total_coin >= 100 THEN '#E2B52B' WHEN total_coin >= 50 THEN '#427D9E' WHEN total_coin >= 30 THEN '#2A60B2' WHEN total_coin >= 2 THEN '#DDDDDD' ELSE '#FFFFFF' END"
_BAND = "CASE WHEN total_coin >= 2000 THEN 2000 WHEN total_coin >= 1000 THEN 1000 WHEN total_coin >= 500 THEN 500 WHEN total_coin >= 100 THEN 100 WHEN total_coin >= 50 THEN 50 WHEN total_coin >= 30 THEN 30 WHEN total_coin >= 2 THEN 2 ELSE 0 END"
MESSAGE = """CASE cmd WHEN 'LIVE' THEN who || '开播了！' WHEN 'PREPARING' THEN who || '下播了...'
  ELSE CASE WHEN trim(title) <> '' THEN who || '把直播标题修改为：' || trim(title) END END"""
TOLD = f"""{CONTROL}, {LIVER}, {SUBSCRIPTION}"""
ACTIVITY = """activity AS (SELECT page_id AS id, url AS activity_id, page_id % 8 AS room_id, page_id * 60 AS timestamp FROM pages)"""
LOGS = """turns AS (SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, turn, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS body FROM conversations),
lines AS (SELECT *, make_timestamp((1700000000 + file * 3600 + turn * 7) * 1000000) AS stamp, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS n FROM turns),
records AS (SELECT file, CAST(n AS BIGINT) AS n,
  min(CASE WHEN role = 'user' THEN strftime(stamp, '%m-%d %H:%M:%S') END) AS timestamp,
  min(CASE WHEN role = 'user' THEN 'svc' || pos % 3 END) AS logger, 'INFO' AS level,
  string_agg(CASE WHEN role = 'user' THEN 'm' || body ELSE '  at ' || body END, chr(10) ORDER BY pos) AS message, 'custom' AS type
  FROM lines WHERE n > 0 GROUP BY file, n)"""
CLEAN = """clean AS (SELECT * FROM (SELECT *, max(created_at) OVER (PARTITION BY room_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM stats WHERE {0} <> -1) WHERE top IS NULL OR created_at > top)"""
SUBSCRIPTION_LOG = """log AS (SELECT c_custkey % 100 AS group_id, c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN 'remove' WHEN c_custkey % 7 IN (1, 2) THEN 'dev' ELSE 'set' END AS op,
  CAST(c_nationkey AS BIGINT) AS room_id, CAST(c_custkey // 3 % 2 AS INTEGER) AS dev FROM customer)"""
MANAGER_LOG = "log AS (SELECT o_custkey % 20 AS group_id, o_orderkey % 50 AS manager_qq, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'add' END AS op FROM orders)"


def _summary(metric: str) -> str:
    return f"""WITH {STATS}, {CLEAN.format(metric)},
    g AS (SELECT room_id, arg_min({metric}, created_at) AS first, arg_max({metric}, created_at) AS last, min({metric}) AS lo, max({metric}) AS hi, count(*) AS n FROM clean GROUP BY room_id)
    SELECT *, CASE WHEN last >= first THEN '+' ELSE '' END || (last - first) AS delta,
      round(greatest(0.0, lo - greatest(hi - lo, 10) * 0.2::DOUBLE), 4) AS axis_lo, round(hi + greatest(hi - lo, 10) * 0.2::DOUBLE, 4) AS axis_hi FROM g WHERE n > 1"""


SQL: dict[str, str] = {
    "superchat_day": f"""WITH {SUPERCHAT} SELECT id, room_id, part, count(*) OVER (PARTITION BY room_id, part) = 3 AS "full", {_BAND} AS band, {_COLOUR} AS colour,
        CASE WHEN total_coin >= 30 THEN 'white' ELSE 'black' END AS text_colour, '￥' || total_coin AS price, strftime(make_timestamp((timestamp + 28800) * 1000000), '%H:%M:%S') AS at FROM paged""",
    "superchat_pages": f"WITH {SUPERCHAT} SELECT room_id, part, count(*) AS n, CASE WHEN count(*) = 3 THEN 'part_' || part ELSE 'today' END AS file FROM paged GROUP BY room_id, part",
    "superchat_page_count": f"WITH {SUPERCHAT} SELECT greatest(1, CAST(ceil(count(*) / 40) AS BIGINT)) AS pages FROM day WHERE room_id = 3",
    "live_newest": f"WITH {EVENT} SELECT id, room_id, cmd, title, timestamp FROM event WHERE cmd IN ('LIVE','PREPARING','ROOM_CHANGE') ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 1",
    "live_is_streaming": f"WITH {CONTROL} SELECT id, room_id FROM told WHERE cmd = 'LIVE' AND repeated",
    "room_change_dup": f"WITH {CONTROL} SELECT id, room_id, title FROM told WHERE cmd = 'ROOM_CHANGE' AND repeated",
    "live_announcements": f"""WITH {TOLD}, m AS (SELECT t.*, coalesce(n.name, '房间' || t.room_id) AS who FROM told t LEFT JOIN names n ON n.room_id = t.room_id WHERE NOT repeated),
        x AS (SELECT *, {MESSAGE} AS message FROM m)
        SELECT s.group_id, count(*) AS n, min(message) AS least, max(id) AS last_id FROM x JOIN subscription s USING (room_id) WHERE message IS NOT NULL GROUP BY s.group_id""",
    "live_announcements_poll": f"""WITH {TOLD}, newest AS (SELECT * FROM told ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 1),
        m AS (SELECT t.*, coalesce(n.name, '房间' || t.room_id) AS who FROM newest t LEFT JOIN names n ON n.room_id = t.room_id WHERE NOT repeated),
        x AS (SELECT *, {MESSAGE} AS message FROM m)
        SELECT s.group_id, id, room_id, message FROM x JOIN subscription s USING (room_id) WHERE message IS NOT NULL""",
    "name_history_all": f"WITH {SEEN} SELECT uid, names FROM history",
    "name_history_by_name": f"WITH {SEEN} SELECT uid, names FROM history WHERE uid IN (SELECT uid FROM seen WHERE uname = 'u5_1')",
    "name_history_by_uid": f"WITH {SEEN} SELECT uid, names FROM history WHERE uid = 5",
    "name_history_of_livers": f"WITH {SEEN}, {LIVER} SELECT uid, names FROM history WHERE uid IN (SELECT uid FROM liver)",
    "name_history_current": f"""WITH {SEEN}, {LIVER}, one AS (SELECT uid, arg_min(name, room_id) FILTER (WHERE TRUE) AS name, min(room_id) AS r FROM names GROUP BY uid),
        picked AS (SELECT o.uid, n.name FROM one o JOIN names n ON n.room_id = o.r)
        SELECT row_number() OVER (ORDER BY h.uid) AS n, h.uid, coalesce(p.name, h.last_name) AS current, h.names FROM history h JOIN picked p ON p.uid = h.uid""",
    "name_lookup": f"""WITH {LIVER}, far AS (SELECT room_id + 1 AS room_id, uid, 'far' || room_id AS uname FROM liver WHERE room_id % 2 = 0)
        SELECT coalesce(n.room_id, f.room_id) AS room_id, coalesce(n.uid, f.uid) AS uid, coalesce(n.name, f.uname) AS name FROM names n FULL JOIN far f ON n.room_id = f.room_id""",
    "liver_by_uid": f"WITH {LIVER}, m AS (SELECT uid, min(room_id) AS room_id FROM liver GROUP BY uid) SELECT m.uid, m.room_id, n.name FROM m JOIN names n ON n.room_id = m.room_id",
    "trend_clean": f"WITH {STATS}, {CLEAN.format('fans_num')} SELECT room_id, created_at, fans_num FROM clean",
    "trend_summary_fans": _summary("fans_num"),
    "trend_summary_guard": _summary("guard_num"),
    "trend_summary_club": _summary("fan_club_num"),
    "trend_window": f"""WITH {STATS}, s AS (SELECT *, strptime(created_at, '%Y-%m-%d %H:%M:%S') + INTERVAL 8 HOURS AS local FROM stats)
        SELECT id, room_id, strftime(local, '%Y-%m-%d %H:%M:%S') AS local_time, fans_num FROM s WHERE local >= TIMESTAMP '1998-07-25 12:00:00'""",
    "stats_latest_n": f"WITH {STATS}, r AS (SELECT id, room_id, row_number() OVER (PARTITION BY room_id ORDER BY created_at DESC, id DESC) AS rank, created_at FROM stats) SELECT * FROM r WHERE rank <= 50",
    "fold_last_write": f"WITH {EVENT} SELECT CAST(room_id AS VARCHAR) AS key, arg_max(cmd, id) AS value FROM event GROUP BY room_id",
    "fold_last_known": f"""WITH {EVENT} SELECT room_id, {", ".join(f"arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("title", "gift_name", "uname", "total_coin"))} FROM event GROUP BY room_id""",
    "fold_last_known_checked": f"""WITH {EVENT} SELECT room_id, {", ".join(f"arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("uname", "gift_name"))}
        FROM event WHERE id // 4 NOT IN (SELECT id // 4 FROM event WHERE uid IS NULL) GROUP BY room_id""",
    "subscription_state": f"""WITH {SUBSCRIPTION_LOG}, r AS (SELECT *, coalesce(max(seq) FILTER (WHERE op = 'remove') OVER (PARTITION BY group_id), -1) AS gone FROM log),
        s AS (SELECT *, min(seq) FILTER (WHERE op = 'set') OVER (PARTITION BY group_id) AS start FROM r WHERE seq > gone)
        SELECT group_id, arg_max(room_id, seq) FILTER (WHERE op = 'set') AS room_id, coalesce(arg_max(dev, seq) FILTER (WHERE op = 'dev'), 0) AS dev FROM s WHERE seq >= start GROUP BY group_id""",
    "manager_state": f"WITH {MANAGER_LOG} SELECT group_id, manager_qq FROM log GROUP BY ALL HAVING arg_max(op, seq) = 'add'",
    "manager_hits": f"""WITH {MANAGER_LOG}, p AS (SELECT *, lag(op) OVER (PARTITION BY group_id, manager_qq ORDER BY seq) AS before FROM log)
        SELECT seq, CASE WHEN op = 'add' THEN before IS DISTINCT FROM 'add' ELSE before IS NOT DISTINCT FROM 'add' END AS hit FROM p""",
    "manager_count": f"WITH {MANAGER} SELECT group_id, count(*) AS n FROM manager GROUP BY group_id",
    "manager_list": f"WITH {MANAGER} SELECT * FROM manager WHERE group_id = 7",
    # Request by request: what is left of a group is a list that each granted removal shortens.
    "manager_guarded_removal": f"""WITH RECURSIVE {MANAGER}, asked AS (SELECT o_orderkey AS seq, o_custkey % 150 AS group_id, o_orderkey % 110 AS manager_qq FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS k FROM asked),
        members AS (SELECT group_id, list(manager_qq) AS left_over FROM manager GROUP BY group_id),
        start AS (SELECT g.group_id, coalesce(m.left_over, []) AS left_over FROM (SELECT DISTINCT group_id FROM asked) g LEFT JOIN members m USING (group_id)),
        step AS (SELECT group_id, CAST(0 AS BIGINT) AS k, left_over, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS manager_qq, CAST(NULL AS VARCHAR) AS outcome FROM start
          UNION ALL SELECT s.group_id, r.k,
            CASE WHEN list_contains(s.left_over, r.manager_qq) AND len(s.left_over) > 1 THEN list_filter(s.left_over, lambda x: x <> r.manager_qq) ELSE s.left_over END, r.seq, r.manager_qq,
            CASE WHEN NOT list_contains(s.left_over, r.manager_qq) THEN 'absent' WHEN len(s.left_over) > 1 THEN 'removed' ELSE 'refused' END
          FROM step s JOIN r ON r.group_id = s.group_id AND r.k = s.k + 1)
        SELECT seq, group_id, manager_qq, outcome FROM step WHERE k > 0""",
    "manager_permitted": f"""WITH {MANAGER}, asked AS (SELECT DISTINCT o_orderkey % 150 AS group_id, o_custkey % 40 AS manager_qq FROM orders),
        known AS (SELECT * FROM manager UNION ALL SELECT DISTINCT group_id, 3 FROM asked WHERE group_id NOT IN (SELECT group_id FROM manager))
        SELECT * FROM asked SEMI JOIN known USING (group_id, manager_qq)""",
    "state_init": f"""WITH {EVENT} SELECT CAST(room_id AS VARCHAR) AS key, arg_max(cmd, id) AS value FROM event GROUP BY room_id
        UNION ALL SELECT 'last_event_id', CAST(max(id) AS VARCHAR) FROM event""",
    "lyrics_update": f"WITH {SONGS}, {LIVER} SELECT s.id, CASE WHEN l.room_id IS NOT NULL THEN l.nickname ELSE s.lyrics END AS lyrics FROM songs s LEFT JOIN liver l ON l.room_id * 3 = s.id",
    "activity_dedup": """WITH a AS (SELECT doc_id AS seq, CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS activity_id FROM documents)
        SELECT seq, activity_id, activity_id IS NOT NULL AND row_number() OVER (PARTITION BY activity_id ORDER BY seq) = 1 AS inserted FROM a""",
    "activity_inserted_ids": """WITH a AS (SELECT doc_id AS seq, CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS activity_id FROM documents)
        SELECT 1000 + min(seq) AS id, activity_id FROM a WHERE seq % 2 = 1 AND activity_id IS NOT NULL AND activity_id NOT IN (SELECT activity_id FROM a WHERE seq % 2 = 0 AND activity_id IS NOT NULL) GROUP BY activity_id""",
    "rooms_distinct": f"WITH {SUBSCRIPTION} SELECT DISTINCT room_id FROM subscription",
    "dev_rooms": f"WITH {SUBSCRIPTION} SELECT DISTINCT room_id FROM subscription WHERE dev = 1",
    "dev_events": f"WITH {EVENT}, {SUBSCRIPTION} SELECT room_id, cmd, count(*) AS n FROM event WHERE room_id IN (SELECT room_id FROM subscription WHERE dev = 1) GROUP BY room_id, cmd",
    "rooms_diff": f"""WITH {EVENT}, {SUBSCRIPTION}, a AS (SELECT room_id FROM event), b AS (SELECT room_id FROM subscription)
        SELECT room_id, 'start' AS action FROM (SELECT room_id FROM b EXCEPT SELECT room_id FROM a) UNION ALL SELECT room_id, 'stop' FROM (SELECT room_id FROM a EXCEPT SELECT room_id FROM b)""",
    "retention_keep_k": "WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS name FROM orders) SELECT name FROM f WHERE name NOT IN (SELECT name FROM f ORDER BY name DESC LIMIT 40)",
    "alert_edges": """WITH s AS (SELECT event_id, user_id % 8 AS room_id, event_type FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND event_id >= 120)),
        p AS (SELECT *, lag(event_type) OVER (PARTITION BY room_id ORDER BY event_id) AS before FROM s) SELECT event_id, room_id FROM p WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'""",
    "song_search": f"WITH {SONGS} SELECT id, title, title_trans FROM songs WHERE lower(title) LIKE '%ring%' OR lower(title_trans) LIKE '%ring%' ORDER BY id LIMIT 5",
    "song_search_wild": f"WITH {SONGS} SELECT id, title FROM songs WHERE lower(title) LIKE '%r_d%g%' OR lower(title_trans) LIKE '%r_d%g%' ORDER BY id LIMIT 5",
    "song_search_all": f"WITH {SONGS} SELECT id, title FROM songs WHERE lower(title) LIKE '%o%' OR lower(title_trans) LIKE '%o%'",
    "song_sung_often": f"WITH {SONGS} SELECT id, count FROM songs WHERE count >= 30",
    "songs_without_lyrics": f"WITH {SONGS} SELECT id, title, lyrics FROM songs WHERE lyrics IS NULL OR lyrics = '' ORDER BY id LIMIT 100",
    "song_recent_dates": """WITH u AS (SELECT DISTINCT l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC) AS n FROM u) SELECT l_partkey, string_agg(day, ',' ORDER BY day DESC) AS dates FROM r WHERE n <= 5 GROUP BY l_partkey""",
    "song_relative_dates": """WITH x AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS d FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'junk' WHEN d = 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d < 7 THEN d || '天前' WHEN d < 30 THEN d // 7 || '周前' WHEN d < 365 THEN d // 30 || '个月前' ELSE d // 365 || '年前' END AS ago FROM x""",
    "song_date_parse": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|x' || o_orderkey || '|2023/13/1' AS dates, o_orderpriority || '|b' AS clips FROM orders""",
    "activity_after": f"WITH {ACTIVITY} SELECT id, activity_id FROM activity WHERE id > 50 ORDER BY id LIMIT 100",
    "activity_max": f"WITH {ACTIVITY} SELECT coalesce(max(id), 0) AS top FROM activity",
    "activity_newest": f"WITH {ACTIVITY} SELECT id, activity_id, room_id FROM activity ORDER BY id DESC LIMIT 1",
    "activity_fresh": f"WITH {ACTIVITY} SELECT room_id, count(*) FILTER (WHERE 6000 - timestamp <= 600) AS eligible, max(id) AS cursor FROM activity GROUP BY room_id",
    "card_extract": """SELECT page_id AS id,
        CASE page_id % 3 WHEN 0 THEN 'o' || page_id WHEN 1 THEN CASE WHEN page_id % 6 = 0 THEN '未知' ELSE 'un' || page_id END ELSE CASE WHEN page_id % 6 = 0 THEN 'o' ELSE 'n' END || page_id END AS username,
        CASE WHEN page_id % 3 = 0 OR (page_id % 3 = 2 AND page_id % 6 = 0) THEN 'https://i0.hdslb.com/a.jpg@80w' WHEN page_id % 6 = 0 THEN '' ELSE 'https://f/x.jpg' END AS avatar_url,
        CASE page_id % 3 WHEN 0 THEN '▶ 视频：t' || page_id WHEN 1 THEN 'c' || page_id ELSE CASE WHEN page_id % 4 <> 0 THEN 'd' ELSE 'c' END || page_id END AS text,
        CASE WHEN page_id % 3 = 0 THEN 'p.jpg' ELSE '' END AS pics, CASE WHEN page_id % 9 = 1 THEN '@src: q' || page_id END AS quoted FROM pages""",
    "grid_layout": """WITH p AS (SELECT p_size % 9 + 1 AS n, unnest(range(p_size % 9 + 1)) AS pos FROM part), c AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN n IN (2, 4) THEN 2 ELSE 3 END AS cols FROM p)
        SELECT cols, CAST(ceil(n / cols) AS INTEGER) AS "rows", CAST(pos % cols AS INTEGER) AS col, CAST(pos // cols AS INTEGER) AS "row", count(*) AS n FROM c GROUP BY ALL""",
    "emoji_map": "SELECT page_id, 'v' || page_id AS a, 'w' AS b, 'x|[a]|[c]|[b]|' || page_id AS tokens FROM pages",
    "log_records": f"WITH {LOGS} SELECT * FROM records",
    "log_page": f"""WITH {LOGS}, b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC) AS back FROM records) SELECT file, n, message FROM b WHERE back > 1 AND back <= 3""",
    "log_tail_n": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "log_files": "SELECT DISTINCT 'f' || conv_id || '.log' AS name FROM conversations",
    "scalar_numbers": """SELECT event_id, event_type AS cmd, CAST(floor((event_id * 333 - 5000) / 1000) AS BIGINT) AS seconds, CASE WHEN event_id % 3 = 0 THEN user_id END AS popularity, event_id % 3 = 0 AS numeric,
        CASE WHEN floor(value) >= 20 THEN '+' ELSE '' END || (CAST(floor(value) AS BIGINT) - 20) AS delta,
        CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(make_timestamp((event_id * 1000 + 28800) * 1000000), '%Y-%m-%d %H:%M') END AS at FROM events""",
    "scalar_text": """SELECT p_partkey, replace(lower(p_name), ' ', '') AS form, CAST(len(string_split(p_name, ' ')) * 2 + 1 AS INTEGER) AS tokens,
        CASE WHEN p_partkey % 2 = 0 THEN 'https://i0.hdslb.com/' || p_brand || '@80w' ELSE 'http://other/' || p_brand || '@9w.png' END AS image,
        CASE WHEN p_partkey % 3 <> 0 THEN p_brand WHEN p_partkey <> 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'activity' END AS file,
        CASE WHEN p_size > 20 THEN '["' || p_brand || '","' || p_type || '"]' ELSE '[]' END AS list FROM part""",
}
