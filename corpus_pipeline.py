"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which the caller writes as Parquet and rereads as the next one's
``docs``.  All but the last return the columns of ``docs``.  ``run`` does so in the
cluster's shared folder.

Nulls, empties, repeats: as the operators define them, and each row by its own verdict:
texts that share an id are judged apart, equal rows alike.  A document without id takes
no part in groups of copies by id and is kept unless its quality is rejected or it copies
a benchmark item.  Extra
columns of ``docs`` pass through all stages but the last.  Empty tables give empty
results.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bitmap import may_hold
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.quality import kept_rows
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.scratch import delete, is_empty, materialize, recording, settle, shared_root, small_batches


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch of the stage before, by the thread and the tables a pipeline runs on.
_PAST: dict[tuple[int, str], list[str]] = {}


def _stage(function: Stage) -> Stage:
    """Removes the last stage's scratch tables: by contract its result is written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = threading.get_ident(), sf_dir
        delete(spark, *_PAST.pop(mine, ()))
        settle(spark)
        small_batches(spark)
        with recording() as paths:
            out = function(spark, docs, sf_dir)
        _PAST[mine] = paths
        return out

    return run_stage


def _hash(*columns: str) -> Column:
    """64 bits of a row's values; a null is a value of its own."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def _without(docs: DataFrame, key: Column, dropped: DataFrame, probe: Column | None = None) -> DataFrame:
    """``docs`` less the rows whose key is in ``dropped``, a table written once.

    ``dropped`` has a key and, where a ``probe`` is given, its value for that row: a cheaper
    column that spares most rows the key.  Rows of one key are all that a stage judges
    alike, so each row goes by its own verdict.
    """
    gone = materialize(dropped.toDF("__gone", *["__of"][: len(dropped.columns) - 1]).where("__gone is not null").distinct(), "dropped")
    count = gone.count()
    if not count:
        return docs
    # A bitmap of bounded size tells most rows that stay, so their texts are not moved.
    held = may_hold(gone.select(F.xxhash64(gone.columns[-1]).alias("probe")), count)
    marked = held(docs, F.xxhash64(key if probe is None else probe), "__maybe")
    rest = marked.where("__maybe").withColumn("__key", key).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").select(*docs.columns).union(rest.select(*docs.columns))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return kept_rows(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    gone = exact_dedup(spark, docs).where("not kept and doc_id is not null")
    # A text is hashed only where the bitmap may hold its id.
    key = F.xxhash64("doc_id", F.sha2(normalised(F.col("text")), 256))
    return _without(docs, key, gone.select(F.xxhash64("doc_id", "text_sha256"), "doc_id"), F.col("doc_id"))


def _further_texts(docs: DataFrame) -> DataFrame | None:
    """__id, __text (hash), __own: an id of its own for each further text of an id; None where every id has one text."""
    text = _hash("text")
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    several = materialize(several.where("lo != hi").select("__id", "lo"), "several")
    if is_empty(several):
        return None
    top = docs.agg(F.max("doc_id")).first()[0]
    rows = docs.select(F.col("doc_id").alias("__id"), text.alias("__text")).join(several, "__id").where("__text != lo").select("__id", "__text").distinct()
    return materialize(rows.withColumn("__own", F.monotonically_increasing_id() + F.lit(top + 1)), "further")


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the smallest id."""
    further = _further_texts(docs)
    if further is None:
        return _without(docs, F.col("doc_id"), jaccard_components(spark, docs).where("component_id != doc_id").select("doc_id"))
    # Texts that share an id are judged apart.
    marked = docs.withColumn("__text", _hash("text"))
    joined = marked.join(further.withColumnRenamed("__text", "__other"), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__other")), "left")
    own = joined.select(*docs.columns, F.coalesce("__own", "doc_id").alias("__name"))
    parts = jaccard_components(spark, own, id_col="__name").where("component_id is not null").select(F.col("__name").alias("name"), "component_id")
    parts = parts.join(further, parts["name"] == further["__own"], "left").select("name", "component_id", F.coalesce("__id", "name").alias("id"))
    parts = materialize(parts.distinct(), "parts")
    first = parts.groupBy("component_id").agg(F.min(F.struct("id", "name")).alias("first"))
    gone = parts.join(first, "component_id").where("name != first.name").select("name")
    return _without(own, F.col("__name"), gone).select(*docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    key = _hash("text")
    found = contaminated(spark, docs.withColumn("__name", key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__name")
    return _without(docs, key, found.select("doc_id"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left and their places in sequences of 1024 tokens."""
    rows = pack(spark, docs, tokenizer_path(), payload={"ids_crc32": F.crc32("ids")})
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: Scores, alignment and tokens have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_root(spark)}/tidemark-run-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
    return docs
