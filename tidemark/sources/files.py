"""Files: sheets, logs, settings and a database's tables; snapshots with retention."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.schemas import REQUIRED, SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table by its explicit schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Append complete rows to a stored table; a committed job is all or nothing."""
    for c in REQUIRED[name]:
        rows = rows.where(F.col(c).isNotNull())
    rows.write.mode("append").parquet(f"{root}/{name}")


def with_missing_columns(df: DataFrame, name: str) -> DataFrame:
    """``df`` with columns that later schemas added, as null, in schema order."""
    fields = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
    return df.select(*[F.col(n).cast(k).alias(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in fields])


def create_missing(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, schema in SCHEMAS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(conf).exists(path):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")


class _Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Slices of a table by row id, so a large table is read in parallel."""

    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", 100_000))
        if not re.fullmatch(r"\w+", self.table):
            raise ValueError(f"no table name: {self.table!r}")
        self.columns = [f.strip().split(" ")[0] for f in SCHEMAS[self.table].split(",")]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=5)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone():
                return [_Slice(0, -1)]
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [_Slice(0, -1)] if low is None else [_Slice(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        if part.high < part.low:
            return
        kinds = [f.strip().split(" ")[1] for f in SCHEMAS[self.table].split(",")]
        with self._open() as db:
            there = {r[1] for r in db.execute(f"PRAGMA table_info({self.table})")}
            names = ", ".join(f'"{c}"' if c in there else "NULL" for c in self.columns)
            for row in db.execute(f"SELECT {names} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (part.low, part.high)):
                yield tuple(None if v is None else str(v) if k == "string" else int(v) for v, k in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table")`` with options path and table; an absent table is empty."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).load()


def read_song_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as text columns; blank cells are empty, a byte-order mark and quoted line ends are handled."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of log files; bytes that are no UTF-8 are dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "�", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def parse_settings(lines: list[str], taken: dict[str, str] | None = None) -> dict[str, str]:
    """``key=value`` lines; blanks, comments and others are skipped, what is set already stays, quotes go."""
    out = dict(taken or {})
    for line in lines:
        text = line.strip()
        if text and not text.startswith("#") and "=" in text:
            key, value = (x.strip() for x in text.split("=", 1))
            out.setdefault(key, value.strip("\"'"))
    return out


def parse_rooms(text: str) -> list[int]:
    """Rooms between commas; anything but digits is an error."""
    parts = [p.strip() for p in text.replace("，", ",").split(",") if p.strip()]
    if bad := [p for p in parts if not p.isdigit()]:
        raise ValueError(f"not a room: {bad[0]!r}")
    return [int(p) for p in parts]


def wanted_rooms(spark: SparkSession, argument: str | None, config: str | None, subscriptions: DataFrame) -> DataFrame:
    """room_id: those of the argument, else of the JSON config's list (bad entries skipped), else those subscribed to."""
    rooms: list[int] = parse_rooms(argument) if argument else []
    if not rooms and config:
        listed = json.loads(config).get("rooms", [])
        rooms = [int(str(r)) for r in listed if str(r).isdigit()]
    if rooms:
        return spark.createDataFrame([(r,) for r in dict.fromkeys(rooms)], "room_id bigint")
    return subscriptions.select("room_id").distinct()


def snapshot(spark: SparkSession, root: str, target: str, stamp: str, keep: int = 2) -> list[str]:
    """Copy all tables to ``target``/snapshot=<stamp>, then remove all but the last ``keep`` snapshots by name.

    A copy that fails is removed.  Keeping 0 removes nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = path(target).getFileSystem(conf)
    made = f"{target}/snapshot={stamp}"
    try:
        for name in SCHEMAS:
            if store.exists(path(f"{root}/{name}")):
                read_table(spark, root, name).write.parquet(f"{made}/{name}")
    except Exception:
        store.delete(path(made), True)
        raise
    names = sorted(s.getPath().getName() for s in store.listStatus(path(target)) if s.getPath().getName().startswith("snapshot="))
    gone = names[:-keep] if keep > 0 else []
    for name in gone:
        store.delete(path(f"{target}/{name}"), True)
    return gone
