"""Explicit schemas of the stored tables."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "event": "id bigint, room_id bigint, cmd string, uid bigint, uname string, content string, gift_name string, gift_num bigint, total_coin bigint, title string, timestamp bigint",
    "name_history": "uid bigint, uname string, first_seen bigint",
    "activity": "id bigint, activity_id string, room_id bigint, uid bigint, uname string, timestamp bigint, dy_type bigint, orig_type bigint, card string, emoji_details string, created_at string",
    "stats": "id bigint, room_id bigint, uid bigint, uname string, fans_num bigint, guard_num bigint, fan_club_num bigint, created_at string",
    "liver": "room_id bigint, uid bigint, uname string, nickname string",
    "subscription": "group_id bigint, room_id bigint, dev int, updated_at string",
    "manager": "group_id bigint, manager_qq bigint, created_at string",
    "state": "key string, value string, updated_at string",
    "song_list": "id bigint, title string, title_trans string, original_singer string, records string, notes string, language string, count bigint, clips string, tags string, lyrics string, updated_at string",
}

#: The key of each table, by which mutations address rows.
KEYS: dict[str, tuple[str, ...]] = {
    "event": ("id",),
    "activity": ("activity_id",),
    "stats": ("id",),
    "liver": ("room_id",),
    "subscription": ("group_id",),
    "manager": ("group_id", "manager_qq"),
    "state": ("key",),
    "song_list": ("id",),
}

#: Columns that a row must have; rows without them are rejected or ignored.
REQUIRED: dict[str, tuple[str, ...]] = {
    "event": ("room_id", "cmd"),
    "activity": ("activity_id", "room_id", "uid", "uname", "timestamp", "dy_type", "orig_type", "card"),
    "stats": ("room_id", "uid", "uname", "fans_num", "guard_num", "fan_club_num"),
    "liver": ("room_id",),
    "subscription": ("group_id", "room_id"),
    "manager": ("group_id", "manager_qq"),
    "state": ("key", "value"),
    "song_list": ("id", "title"),
}

#: The commands that are stored, those that control a broadcast.
TRACKED = ("DANMU_MSG", "SEND_GIFT", "GUARD_BUY", "SUPER_CHAT_MESSAGE", "LIVE", "PREPARING", "ROOM_CHANGE")
CONTROL = ("LIVE", "PREPARING", "ROOM_CHANGE")
