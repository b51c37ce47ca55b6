"""Log lines to records, pages and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def records(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """file, n, timestamp, logger, level, message, type: a header line and the lines up to the next.

    Lines before a file's first header and empty lines are dropped.
    """
    clean = lines.select(F.col(file).alias("file"), F.col(pos).alias("pos"), S.clean_line(line).alias("line")).where("line != ''")
    headed = clean.withColumn("h", S.log_header("line"))
    running = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = headed.withColumn("n", F.count("h").over(running)).where("n > 0")
    text = F.coalesce("h.message", "line")
    whole = numbered.groupBy("file", "n").agg(F.max("h").alias("h"), F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"))
    message = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.select("file", "n", "h.timestamp", "h.logger", "h.level", message.alias("message"), "h.type")


def page(rows: DataFrame, order: str, offset: int, limit: int, by: str | None = None) -> DataFrame:
    """``limit`` rows that end ``offset`` before the last; none past the first.

    Over all rows a top-k keeps what the window then numbers to ``offset + limit`` rows.
    """
    rows = rows if by else rows.orderBy(F.desc(order)).limit(offset + limit)
    own = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    back = F.row_number().over(own.orderBy(F.desc(order)))
    return rows.withColumn("_b", back).where((F.col("_b") > offset) & (F.col("_b") <= offset + limit)).drop("_b")


def tail(rows: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    return page(rows, order, 0, n, by)
