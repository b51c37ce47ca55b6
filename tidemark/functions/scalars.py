"""Scalar functions as column expressions; all run in the JVM.

Local time is always an explicit zone name, never the session's.  Blank means empty or
white space by Unicode rules.  Each function says what it makes of null.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Commands and numbers


def command_name(cmd: Column | str) -> Column:
    """What stands before the first colon; null is empty."""
    return F.substring_index(F.coalesce(_col(cmd), F.lit("")), ":", 1)


def popularity(value: Column | str) -> Column:
    """An all-digit text as a number, else null."""
    v = _col(value).cast("string")
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint"))


def epoch_seconds(ms: Column | str) -> Column:
    """Milliseconds to seconds, rounding down; null stays."""
    return F.floor(_col(ms) / F.lit(1000)).cast("bigint")


def is_number_query(q: Column | str) -> Column:
    """Whether a query text names a uid (digits only) rather than a name."""
    return _col(q).rlike("^[0-9]+$")


def digits_or_null(text: Column | str) -> Column:
    t = F.trim(_col(text))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def days_argument(text: str | None, least: int = 1, most: int = 7) -> int:
    """A number of days, with an optional unit; without a number it is one day, and out of range an error."""
    digits = (text or "").strip().rstrip("天日").strip()
    if not (digits.isascii() and digits.isdigit()):
        return 1
    if not least <= int(digits) <= most:
        raise ValueError(f"days must be {least} to {most}: {digits}")
    return int(digits)


def date_argument(text: str | None, today: datetime.date) -> datetime.date:
    """A date as year-month-day; a blank is ``today``, anything else an error."""
    given = (text or "").strip()
    return datetime.datetime.strptime(given, "%Y-%m-%d").date() if given else today


# Text


def blank(text: Column | str) -> Column:
    """Null, empty or white space only."""
    t = _col(text)
    return t.isNull() | ~t.rlike(r"(?U)\S")


def first_not_blank(*texts: Column | str) -> Column:
    """The first text that isn't blank, untrimmed; else null."""
    return F.coalesce(*[F.when(~blank(t), _col(t)) for t in texts])


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_col(text), _UPPER, _LOWER)


def like_ascii(text: Column | str, keyword: str) -> Column:
    """Contains the keyword, A-Z alike in either case; % and _ in it are wildcards."""
    folded = keyword.translate(str.maketrans(_UPPER, _LOWER))
    return F.like(ascii_lower(text), F.lit(f"%{folded}%"), F.lit("\u0001"))


def match_form(text: Column | str) -> Column:
    """The form in which titles are compared: lower case, white space and separators gone."""
    return F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)[\s\-_/\\.,，。·]+", "")


#: Fixed value: what is laid out as one.
DISPLAY_TOKEN = r"[a-zA-Z0-9]+|\s+|[^\x00-\xff]|."


def display_tokens(text: Column | str) -> Column:
    """Words, runs of blanks, wide characters and other single characters."""
    return F.regexp_extract_all(_col(text), F.lit(f"({DISPLAY_TOKEN})"), F.lit(1))


def signed(number: Column | str) -> Column:
    """A number with its sign; 0 is +0."""
    n = _col(number)
    return F.concat(F.when(n >= 0, F.lit("+")).otherwise(F.lit("")), n.cast("string"))


# Money


#: Least price of each band and the colour of its row.
PRICE_BANDS = ((2000, "#AB1A32"), (1000, "#E54D4D"), (500, "#E09443"), (100, "#E2B52B"), (50, "#427D9E"), (30, "#2A60B2"), (2, "#DDDDDD"))
PRICE_REST = "#FFFFFF"


def price_band(price: Column | str) -> Column:
    """The least price of the band, 0 below all; null stays null."""
    p, out = _col(price), F.lit(0)
    for least, _ in reversed(PRICE_BANDS):
        out = F.when(p >= least, F.lit(least)).otherwise(out)
    return F.when(p.isNotNull(), out)


def price_colour(price: Column | str) -> Column:
    p, out = _col(price), F.lit(PRICE_REST)
    for least, colour in reversed(PRICE_BANDS):
        out = F.when(p >= least, F.lit(colour)).otherwise(out)
    return F.when(p.isNotNull(), out)


def text_colour(price: Column | str) -> Column:
    """White on the darker bands."""
    return F.when(_col(price) >= 30, "white").when(_col(price).isNotNull(), "black")


def price_text(price: Column | str) -> Column:
    return F.concat(F.lit("￥"), _col(price).cast("string"))


# Time


def local_text(epoch: Column | str, pattern: str, zone: str = ZONE) -> Column:
    """Epoch seconds as local text; null stays."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(_col(epoch)), zone), pattern)


def card_time(epoch: Column | str, zone: str = ZONE) -> Column:
    """Minutes for a card; 0 and null are empty. Years beyond 9999 have no plus sign."""
    e = _col(epoch)
    return F.when(e.isNull() | (e == 0), "").otherwise(F.ltrim(local_text(e, "yyyy-MM-dd HH:mm", zone), F.lit("+")))


def day_bounds(day: str, zone: str = ZONE) -> tuple[Column, Column]:
    """First and last epoch second of a local calendar day (yyyy-MM-dd)."""
    at = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), zone))
    first = F.to_date(F.lit(day))
    return at(first), at(F.date_add(first, 1)) - 1


def stored_time(text: Column | str) -> Column:
    """A stored UTC text as a timestamp, null if it is none."""
    return F.try_to_timestamp(_col(text))


def shifted_text(text: Column | str, hours: int = 8) -> Column:
    """A stored UTC text moved by whole hours, to the second; null if it is no time."""
    return F.date_format(stored_time(text) + F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd HH:mm:ss")


def relative_day(date_text: Column | str, as_of: str) -> Column:
    """How long ago a date is, in the largest unit; texts that are no date pass through."""
    day = F.try_to_date(_col(date_text), "yyyy-MM-dd")
    ago = F.datediff(F.lit(as_of).cast("date"), day)
    whole = lambda n: F.floor(ago / n).cast("string")
    return (
        F.when(day.isNull(), _col(date_text))
        .when(ago == 0, "今天")
        .when(ago == 1, "昨天")
        .when(ago < 7, F.concat(ago.cast("string"), F.lit("天前")))
        .when(ago < 30, F.concat(whole(7), F.lit("周前")))
        .when(ago < 365, F.concat(whole(30), F.lit("个月前")))
        .otherwise(F.concat(whole(365), F.lit("年前")))
    )


# Lists and JSON


def _parts(text: Column | str, separator: str) -> Column:
    pieces = F.transform(F.split(F.coalesce(_col(text), F.lit("")), separator), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def date_list(text: Column | str) -> Column:
    """Dates between full-width commas as ISO dates; what is no date stays as it is."""
    return F.transform(_parts(text, "，"), lambda x: F.coalesce(F.date_format(F.try_to_date(x, "yyyy/M/d"), "yyyy-MM-dd"), x))


def clip_list(text: Column | str) -> Column:
    return _parts(text, ",")


def json_list(text: Column | str) -> Column:
    """A JSON array of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(_col(text), "array<string>"), F.array().cast("array<string>"))


def list_json(items: Column | str) -> Column:
    """A list as JSON text; null is an empty list."""
    return F.to_json(F.coalesce(_col(items), F.array().cast("array<string>")))


def recent(items: Column | str, n: int = 5) -> Column:
    """The n largest, descending."""
    return F.slice(F.sort_array(_col(items), asc=False), 1, n)


# Cards


def _json(source: Column, path: str) -> Column:
    return F.get_json_object(source, path)


def _either(*options: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(o != "", o) for o in options])


def card_fields(card: Column | str, kind: Column | str) -> Column:
    """struct<username, avatar_url, text, pic_urls> of a card by its kind: 8 video, 1 repost, else post."""
    c, k = _col(card), _col(kind)
    unknown, none = F.lit("未知"), F.lit("")
    pictures = F.from_json(_json(c, "$.item.pictures"), "array<struct<img_src:string>>")
    video = F.struct(
        F.coalesce(_json(c, "$.owner.name"), unknown).alias("username"),
        F.coalesce(_json(c, "$.owner.face"), none).alias("avatar_url"),
        F.concat(F.lit("▶ 视频："), F.coalesce(_json(c, "$.title"), none)).alias("text"),
        F.array(F.coalesce(_json(c, "$.pic"), none)).alias("pic_urls"),
    )
    repost = F.struct(
        F.coalesce(_json(c, "$.user.uname"), unknown).alias("username"),
        F.coalesce(_json(c, "$.user.face"), none).alias("avatar_url"),
        F.coalesce(_json(c, "$.item.content"), none).alias("text"),
        F.array().cast("array<string>").alias("pic_urls"),
    )
    # An absent or empty user gives way to the owner.
    user = F.coalesce(F.when(~_json(c, "$.user").isin("{}", "", "null"), _json(c, "$.user")), _json(c, "$.owner"))
    post = F.struct(
        F.coalesce(_either(_json(user, "$.name"), _json(user, "$.uname")), unknown).alias("username"),
        F.coalesce(_either(_json(user, "$.head_url"), _json(user, "$.face")), none).alias("avatar_url"),
        F.coalesce(_either(_json(c, "$.item.description"), _json(c, "$.item.content"), _json(c, "$.dynamic")), none).alias("text"),
        F.coalesce(F.transform(pictures, lambda p: p["img_src"]), F.array().cast("array<string>")).alias("pic_urls"),
    )
    return F.when(k == 8, video).when(k == 1, repost).otherwise(post)


def origin_fields(card: Column | str, origin_kind: Column | str) -> Column:
    """The fields of the post a card quotes (JSON inside JSON), its text led by its author; null without one."""
    origin = _json(_col(card), "$.origin")
    there = origin.isNotNull() & ~origin.isin("", "null")
    f = card_fields(origin, origin_kind)
    quoted = F.struct(f["username"].alias("username"), f["avatar_url"].alias("avatar_url"), F.concat(F.lit("@"), f["username"], F.lit(": "), f["text"]).alias("text"), f["pic_urls"].alias("pic_urls"))
    return F.when(there, quoted)


def emoji_map(details: Column | str) -> Column:
    """name -> url of a JSON array of emoji; later entries win, junk is an empty map."""
    kind = "array<struct<emoji_name:string,url:string>>"
    items = F.filter(F.coalesce(F.from_json(_col(details), kind), F.array().cast(kind)), lambda e: e["emoji_name"].isNotNull())
    names = F.array_distinct(F.transform(items, lambda e: e["emoji_name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(items, lambda e: e["emoji_name"] == n), -1)["url"])
    return F.map_from_arrays(names, last)


def grid_columns(count: Column | str) -> Column:
    """Columns of a picture grid: 1 for one, 2 for two or four, else 3."""
    n = _col(count)
    return F.when(n == 1, 1).when(n.isin(2, 4), 2).otherwise(3)


def grid_cell(index: Column | str, count: Column | str) -> Column:
    """struct<col, row, cols, rows> of a picture."""
    i, n, cols = _col(index), _col(count), grid_columns(count)
    return F.struct((i % cols).alias("col"), F.floor(i / cols).cast("int").alias("row"), cols.alias("cols"), F.ceil(n / cols).cast("int").alias("rows"))


def sized_image(url: Column | str, suffix: str) -> Column:
    """An image address with a size suffix on the hosts that take one; scheme-less addresses get https."""
    u = _col(url)
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when(full.contains("hdslb.com"), F.concat(F.substring_index(full, "@", 1), F.lit(suffix))).otherwise(full)


# Announcements and names of results


def announcement(cmd: Column | str, name: Column | str, title: Column | str, room: Column | str) -> Column:
    """The message for a control event; null if there is none to send."""
    who = F.coalesce(_col(name), F.concat(F.lit("房间"), _col(room).cast("string")))
    t = F.regexp_replace(_col(title), r"(?U)^\s+|\s+$", "")
    return (
        F.when(_col(cmd) == "LIVE", F.concat(who, F.lit("开播了！")))
        .when(_col(cmd) == "PREPARING", F.concat(who, F.lit("下播了...")))
        .when((_col(cmd) == "ROOM_CHANGE") & (t != ""), F.concat(who, F.lit("把直播标题修改为："), t))
    )


def activity_name(activity_id: Column | str, row_id: Column | str) -> Column:
    return F.coalesce(_either(_col(activity_id)), F.when(_col(row_id) != 0, _col(row_id).cast("string")), F.lit("activity"))


# Axes


def axis_bounds(lo: Column | str, hi: Column | str) -> tuple[Column, Column]:
    """Bounds with a fifth of the range (10 at least) on either side, not below 0."""
    pad = F.greatest(_col(hi) - _col(lo), F.lit(10)) * 0.2
    return F.greatest(F.lit(0.0), _col(lo) - pad), _col(hi) + pad


# Logs


#: Header lines of the four log formats, tried in this order.
LOG_FORMATS = (
    ("custom", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}),\d{3}\s+-\s+(.*?)\s+-\s+([A-Z]+)\s+-\s+(.*)$"),
    ("nonebot", r"^(\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s+\[(.*?)\]\s+nonebot\s*\|\s*(.*)$"),
    ("napcat", r"^(\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s+\[(.*?)\]\s+(.*?)\s*\|\s*(.*)$"),
    ("lyrics", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}),\d{3}\s+-\s+([A-Z]+)\s+-\s+(.*)$"),
)
#: Fixed value: terminal escape sequences.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"


def clean_line(line: Column | str) -> Column:
    """A log line without escapes and line ends."""
    return F.regexp_replace(F.regexp_replace(_col(line), ANSI, ""), r"[\r\n]+$", "")


def log_time(text: Column | str) -> Column:
    """Either time form, with a year or without, as MM-dd HH:mm:ss; others pass through."""
    t, form = _col(text), F.lit("yyyy-MM-dd HH:mm:ss")
    tries = (F.try_to_timestamp(t, form), F.try_to_timestamp(F.concat(F.lit("1900-"), t), form))
    return F.coalesce(*[F.date_format(x, "MM-dd HH:mm:ss") for x in tries], t)


def log_header(line: Column | str) -> Column:
    """struct<timestamp, logger, level, message, type> of a header line, else null."""
    c, out = _col(line), F.lit(None)
    #: Per format: group of the time, logger (or its fixed name), level, message.
    groups = {"custom": (1, 2, 3, 4), "nonebot": (1, "nonebot", 2, 3), "napcat": (1, 3, 2, 4), "lyrics": (1, "lyrics", 2, 3)}
    for name, pattern in reversed(LOG_FORMATS):
        java = "(?Ud)" + pattern
        pick = lambda g, p=java: F.lit(g) if isinstance(g, str) else F.regexp_extract(c, p, g)
        when, logger, level, message = groups[name]
        level_text = F.upper(pick(level)) if name in ("nonebot", "napcat") else pick(level)
        header = F.struct(log_time(pick(when)).alias("timestamp"), pick(logger).alias("logger"), F.regexp_replace(level_text, r"(?U)^\s+|\s+$", "").alias("level"), pick(message).alias("message"), F.lit(name).alias("type"))
        out = F.when(c.rlike(java), header).otherwise(out)
    return out
