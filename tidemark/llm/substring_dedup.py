"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text where it falls below a
threshold, about every ``mean`` bytes, so cuts move with the text and an insertion
changes the chunks next to it only.  The unit that is compared is a chunk with as many
of the next ones as make ``least`` bytes; its digest is a 64-bit hash of its bytes.

1. One pass emits the digests; they are combined map-side to the smallest and largest
   id, and those with two ids or more are repeated.  A common passage is a row per task.
2. A second pass over the texts cuts them again, keeps what may be repeated by a bitmap
   of bounded size, and joins it with the repeated digests.
3. Per document, repeated units that touch are one run.  Runs of ``min_words`` words or
   more are returned; cuts fall inside a passage, so its run is shorter than the
   passage by about a chunk at either end.

A run is cut in spans.  What units cover that occur here first, by id, is kept; what is
left of the run is a repeat that ``remove_spans`` cuts out, if it has ``min_words`` words
itself, and else is kept too.  So the first occurrence of every unit stays, and a kept
span may have fewer words.

Nulls, empties, repeats: null, empty and short texts have no spans; a text of one byte
value is cut at every byte where no other cut is in reach.  Rows that repeat an id are one document, and what
only they share is no repeat across documents.  Rows without id are left out.  Ids are
whole numbers; others are an error.  Texts of any length are read whole.  A passage that
very many documents have is one key of the join with the repeated digests, whose other
side has a row a digest; adaptive execution splits it.  Empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.bitmap import bitmap
from tidemark.llm.scratch import materialize, whole_ids

_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)


_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        p = np.full(n, pow(int(W._BASE), -1, 2**64), dtype=np.uint64)
        p[0] = 1
        _INVERSE = np.multiply.accumulate(p)
    return _INVERSE


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes that end at each byte: sum of table values, each shifted by its distance."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray, mean: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts of a batch of texts and, per chunk, its end; a chunk lies in one text."""
    h = gear(raw)
    edges = np.unique(np.concatenate([np.flatnonzero(h < np.uint32(2**32 // mean)) + 1, offsets]))
    size = np.diff(edges)
    extra = [_long(h, int(edges[i]), int(edges[i + 1]), most) for i in np.flatnonzero(size > most).tolist()]
    if extra:
        edges = np.unique(np.concatenate([edges, *extra]))
    return edges[:-1], edges[1:]


def _long(h: np.ndarray, start: int, end: int, most: int) -> np.ndarray:
    """Cuts of a stretch without any, as in text of one repeated word: wherever the hash has its minimum.

    That depends on the content too: in periodic text it recurs with the period.
    """
    found, todo = [], [(start, end)]
    while todo:
        a, z = todo.pop()
        inner = h[a + 16 : z - 1]
        if z - a <= most or not len(inner):
            continue
        at = np.flatnonzero(inner == inner.min()) + a + 17
        found.append(at)
        edges = np.r_[a, at, z]
        todo += [(int(edges[i]), int(edges[i + 1])) for i in np.flatnonzero(np.diff(edges) > most).tolist()]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def units(raw: np.ndarray, offsets: np.ndarray, mean: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk, with as many of the next ones as ``least`` bytes take: digest, first byte, end, text."""
    start, end = cuts(raw, offsets, mean, most)
    none = np.zeros(0, np.int64)
    if len(start) < 2:
        return np.zeros(0, np.uint64), none, none, none
    last = np.maximum(np.searchsorted(end, start + least), np.arange(len(start)) + 1)
    text = np.searchsorted(offsets, start, side="right") - 1
    good = np.flatnonzero(last < len(start))
    good = good[text[last[good]] == text[good]]
    start, end, text = start[good], end[last[good]], text[good]
    # A polynomial over the bytes from prefix sums; the base is odd, so its powers have inverses.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._BYTE[raw] * W._powers(len(raw))[: len(raw)], dtype=np.uint64)])
    value = (sums[end] - sums[start]) * _inverse_powers(len(raw) + 1)[start]
    return W.mix(W.mix(value) + (end - start).astype(np.uint64)), start, end, text


def _digests(docs: DataFrame, mean: int, most: int, least: int) -> DataFrame:
    """id, digest of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, offsets in W.text_chunks(batch.column(1), 1 << 20):
                digest, _, _, text = units(raw, offsets, mean, most, least)
                if len(digest):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + text]), pa.array(digest.view(np.int64))], names=["id", "digest"])

    return docs.mapInArrow(W.lean(run), "id long, digest long")


def _places(docs: DataFrame, mean: int, most: int, least: int, bits: np.ndarray) -> DataFrame:
    """id, digest, start, end (characters), w0, w1 (words that start before either) of units that may be repeated."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(bits), 64 - int(np.log2(len(bits) * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, offsets in W.text_chunks(batch.column(1), 1 << 20):
                digest, start, end, text = units(raw, offsets, mean, most, least)
                at = (W.mix(digest) >> np.uint64(shift)).astype(np.int64)
                hit = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if not hit.any():
                    continue
                digest, start, end, text = digest[hit], start[hit], end[hit], text[hit]
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                blank = W._SPACE[raw]
                heads = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])
                base = chars[offsets[text]]
                columns = [ids[lo + text], digest.view(np.int64), chars[start] - base, chars[end] - base, heads[start], heads[end]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["id", "digest", "start", "end", "w0", "w1"])

    return docs.mapInArrow(W.lean(run), "id long, digest long, start long, `end` long, w0 long, w1 long")


def _rest(runs: tuple[np.ndarray, ...], parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What disjoint ascending parts leave of disjoint ascending runs: start, end, and the words before either."""
    left, left_w = np.r_[runs[0], parts[1]], np.r_[runs[2], parts[3]]
    right, right_w = np.r_[runs[1], parts[0]], np.r_[runs[3], parts[2]]
    a, z = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    some = left[a] < right[z]
    return left[a][some], right[z][some], left_w[a][some], right_w[z][some]


def _spans(min_words: int):
    """Over rows sorted by id and start: units that touch are a run, cut in spans that occur first and that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], side="left")) if len(now[0]) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield from spans([x[:cut] for x in now])
        if held is not None and len(held[0]):
            yield from spans(held)

    def spans(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, start, end, w0, w1, first = c
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (start[1:] > end[:-1])])
        whole = np.maximum.reduceat(w1, new) - w0[new] >= min_words
        if not whole.any():
            return
        # Edges of all runs on one line: a run's number above its characters.
        line = np.cumsum(np.isin(np.arange(len(ids)), new)) - 1
        base = line * (int(end.max()) + 1)
        runs = base[new] + start[new], base[new] + np.maximum.reduceat(end, new), w0[new], np.maximum.reduceat(w1, new)
        runs = tuple(x[whole] for x in runs)
        # What occurs here first stays; the rest of a run is a repeat, if it is long enough by itself.
        own = np.flatnonzero((first == ids) & whole[line])
        lo, hi = base[own] + start[own], np.maximum.accumulate(base[own] + end[own])
        head = np.flatnonzero(np.r_[len(own) > 0, lo[1:] > hi[:-1]])
        tail = np.r_[head[1:], len(own)][: len(head)] - 1
        again = _rest(runs, (lo[head], hi[tail], w0[own][head], np.maximum.reduceat(w1[own], head) if len(own) else w1[own]))
        again = tuple(x[again[3] - again[2] >= min_words] for x in again)
        kept = _rest(runs, again)
        parts = tuple(np.concatenate(x) for x in zip(again, kept, strict=True))
        flag = np.arange(len(parts[0])) >= len(again[0])
        unit = np.flatnonzero(first != ids)
        at = np.searchsorted(again[1], base[unit] + start[unit], side="right")
        unit, at = unit[at < len(again[0])], at[at < len(again[0])]
        inside = base[unit] + end[unit] > again[0][at]
        source = np.full(len(again[0]), np.iinfo(np.int64).max)
        np.minimum.at(source, at[inside], first[unit[inside]])
        by = np.argsort(parts[0], kind="stable")
        row = new[parts[0] // (int(end.max()) + 1)]
        arrays = [ids[row], parts[0] - base[row], parts[1] - base[row], parts[3] - parts[2], np.r_[source, ids[row[flag]]]]
        yield pa.RecordBatch.from_arrays([*(pa.array(a[by].astype(np.int64)) for a in arrays), pa.array(flag[by])], names=["doc_id", "start", "end", "words", "first_doc_id", "kept"])

    return run


def repeated_spans(
    spark: SparkSession, docs: DataFrame, mean: int = 20, most: int = 128, least: int = 40, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, start, end (characters), words, first_doc_id, kept: every span that another document has too."""
    whole_ids(docs, id_col)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digests = _digests(rows, mean, most, least).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    repeated = materialize(digests.where("first != last").select("digest", "first"), "repeated")

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = W.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["probe"])

    bits = bitmap(repeated.select("digest").mapInArrow(mixed, "probe long"), repeated.count())
    found = _places(rows, mean, most, least, bits).join(repeated, "digest")
    dealt = found.select("id", "start", "end", "w0", "w1", "first").repartition("id").sortWithinPartitions("id", "start")
    return dealt.mapInArrow(_spans(min_words), "doc_id long, start long, `end` long, words long, first_doc_id long, kept boolean")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans that are not kept cut out of the texts; other columns stay as they are."""
    cut = spans.where("not kept").groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    joined = docs.join(cut, docs[id_col] == F.col("__id"), "left")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.col("__cut.end")), F.concat(F.col("__cut.start"), F.array(F.length(text_col).cast("long")))
    kept = F.transform(F.arrays_zip(bounds[0].alias("a"), bounds[1].alias("b")), lambda x: F.substring(F.col(text_col), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
