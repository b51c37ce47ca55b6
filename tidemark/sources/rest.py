"""REST services as batch data sources, and the envelope their answers come in.

``RestSource`` is a Python data source: one partition per request, so requests run on
executors and a failed one is retried as a task.  The transport is a parameter, a
function from (url, params) to (status, JSON text), for tests and for other clients.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENVELOPE = "ok boolean, url string, params string, code bigint, message string, body string"
ATTEMPTS, PAUSE, TIMEOUT = 5, 3.0, 10.0

Transport = Callable[[str, dict], str]


def http_get(url: str, params: dict, timeout: float = TIMEOUT) -> str:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}" if params else url, timeout=timeout) as answer:
        return answer.read().decode()


def envelope(url: str, params: dict, body: str | None) -> tuple:
    """ok, url, params, code, message, body; the code is -1 where the body has none."""
    try:
        data = json.loads(body) if body is not None else None
    except ValueError:
        data = None
    own = data if isinstance(data, dict) else {}
    code = own.get("code", -1)
    code = code if isinstance(code, int) else -1
    return (code == 0, url, json.dumps(params, sort_keys=True), code, own.get("message") or own.get("msg") or "", body)


def request(url: str, params: dict, transport: Transport = http_get, attempts: int = ATTEMPTS, pause: float = PAUSE) -> tuple:
    """The envelope of an answer; after the last failed attempt one that says why."""
    for k in range(attempts):
        try:
            return envelope(url, params, transport(url, params))
        except OSError as why:
            if k + 1 == attempts:
                return (False, url, json.dumps(params, sort_keys=True), -1, str(why), None)
            time.sleep(pause)
    raise ValueError("at least one attempt is needed")


class _Call(InputPartition):
    def __init__(self, url: str, params: dict):
        self.url, self.params = url, params


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.calls = [_Call(c["url"], c.get("params", {})) for c in json.loads(options.get("calls", "[]"))]
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))

    def partitions(self) -> list[InputPartition]:
        return list(self.calls) or [_Call("", {})]

    def read(self, partition: _Call) -> Iterator[tuple]:
        if partition.url:
            yield request(partition.url, partition.params, attempts=self.attempts, pause=self.pause)


class RestSource(DataSource):
    """``spark.read.format("rest").option("calls", json)``: a list of {url, params}."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return ENVELOPE

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)


def read_rest(spark: SparkSession, calls: list[dict], attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    spark.dataSource.register(RestSource)
    return spark.read.format("rest").option("calls", json.dumps(calls)).option("attempts", attempts).option("pause", pause).load()


# Typed records of the five endpoints.  A path that must be there and isn't is an error.


def _need(path: str, kind: str) -> Column:
    value = F.get_json_object("body", f"$.data.{path}")
    return F.when(value.isNull(), F.raise_error(F.lit(f"the answer lacks {path}"))).otherwise(value.cast(kind))


#: Paths in the answers.
ENDPOINTS: dict[str, dict[str, tuple[str, str]]] = {
    "room": {"room_id": ("room_id", "bigint"), "uid": ("uid", "bigint"), "title": ("title", "string"), "live_status": ("live_status", "bigint")},
    "master": {"uid": ("info.uid", "bigint"), "uname": ("info.uname", "string"), "fans_num": ("follower_num", "bigint")},
    "guard": {"guard_num": ("info.num", "bigint")},
    "medal": {"fan_club_num": ("fans_medal_light_count", "bigint")},
}


def records(answers: DataFrame, endpoint: str, lenient: bool = False) -> DataFrame:
    """Typed fields of good answers.  Lenient gives null for a path that isn't there."""
    pick = (lambda p, k: F.get_json_object("body", f"$.data.{p}").cast(k)) if lenient else _need
    return answers.where("ok").select("params", *[pick(p, k).alias(n) for n, (p, k) in ENDPOINTS[endpoint].items()])


def rejected(answers: DataFrame) -> DataFrame:
    """Answers that are no good, with the reason; they fail no job."""
    return answers.where(~F.col("ok")).select("url", "params", "code", "message")


def posts(answers: DataFrame) -> DataFrame:
    """Posts of history answers, oldest first by ``seq``."""
    card = "array<struct<`desc`:struct<dynamic_id_str:string,type:bigint,orig_type:bigint,timestamp:bigint,user_profile:struct<info:struct<uid:bigint,uname:string>>>,card:string,display:struct<emoji_info:struct<emoji_details:array<struct<emoji_name:string,url:string>>>>>>"
    items = answers.where("ok").select(F.posexplode(F.reverse(F.from_json(F.get_json_object("body", "$.data.cards"), card))).alias("seq", "c"))
    d = "c.desc."
    return items.select(
        "seq",
        F.col(d + "dynamic_id_str").alias("activity_id"),
        F.col(d + "user_profile.info.uid").alias("uid"),
        F.col(d + "user_profile.info.uname").alias("uname"),
        F.col(d + "timestamp").alias("timestamp"),
        F.col(d + "type").alias("dy_type"),
        F.col(d + "orig_type").alias("orig_type"),
        F.col("c.card").alias("card"),
        F.to_json("c.display.emoji_info.emoji_details").alias("emoji_details"),
    )


def samples(rooms: DataFrame, room: DataFrame, master: DataFrame, guard: DataFrame, medal: DataFrame) -> DataFrame:
    """One sample per subscribed room whose four answers are all there.

    ``room`` has room_id and uid, ``guard`` room_id, ``master`` and ``medal`` uid.
    """
    wanted = rooms.select("room_id").distinct()
    joined = wanted.join(room.select("room_id", "uid"), "room_id").join(master.select("uid", "uname", "fans_num"), "uid")
    return joined.join(guard.select("room_id", "guard_num"), "room_id").join(medal.select("uid", "fan_club_num"), "uid").select("room_id", "uid", "uname", "fans_num", "guard_num", "fan_club_num")
