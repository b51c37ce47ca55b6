"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass counts, over all texts, how often each word and each word n-gram of the
   benchmark occurs.  An item's n-gram is a seed if it occurs once, or in a share of at
   most ``chance`` of all places; or if its words are so rare that it is expected so
   seldom, by the product of their shares.  The second keeps what is rare by itself and
   often only because an item was copied often; an item without any such n-gram keeps all
   of its n-grams.
2. A second pass looks up every n-gram of every text in the seeds.  A hit opens a
   window of the text around the item's place; overlapping windows of an item merge.
3. Words of the window and of the item (lower-cased by Unicode rules) are aligned locally (match 2, mismatch -1,
   gap -1).  The score is the best alignment over that of a verbatim copy; pairs of
   ``threshold`` or more are returned with the span that aligned.

The benchmark goes out in blocks of at most ``block_words`` words; a larger one means
more passes over the texts, never a larger broadcast.  Counts come back as vectors in
parts, summed on the executors: two numbers a word of the block.

Nulls, empties, repeats: texts and items that are null, empty or, for items, shorter
than a seed match nothing.  A text of any length is searched whole.  A document without
id is searched like any other and keeps its null id; a repeated document gives repeated
rows, a repeated item_id its best row, and of equal scores the one found first, by item
and place.  Ids may be of any type.  Empty tables give empty results.  Further columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidemark.llm import wordhash as W

MATCH, MISMATCH, GAP = 2, -1, 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two hash sequences: score, end in item, end in text."""
    steps = np.arange(len(text) + 1) * GAP
    row, best, at = np.zeros(len(text) + 1, np.int64), 0, (0, 0)
    for i, w in enumerate(item):
        now = np.zeros_like(row)
        now[1:] = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        np.maximum(now, row - GAP, out=now)
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + steps) - steps
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, *at


def aligned_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best score and the text's words [start, end) that aligned."""
    best, i, j = align(item, text)
    if not best:
        return 0, 0, 0
    _, _, back = align(item[:i][::-1], text[:j][::-1])
    return best, j - back, j


def _words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.words(raw, np.array([0, len(raw)]))[:3]


def _hash_text(text: str) -> np.ndarray:
    return _words_of(pc.utf8_lower(pa.array([text]))[0].as_py())[0]


def _blocks(bench: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in bench:
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield block


_PART = 1 << 16


def _summed(docs: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all batches of a vector that ``count`` adds to, gathered in parts; a task sends what isn't zero."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            count(own, batch)
        for p in range(0, size, _PART):
            at = np.flatnonzero(own[p : p + _PART])
            if len(at):
                blob = at.astype("<u4").tobytes() + own[p + at].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p // _PART], pa.int32()), pa.array([blob], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in W.slices(batches, 50):
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(blob) // 12
                sums.setdefault(part, np.zeros(_PART, np.int64))[np.frombuffer(blob, "<u4", n)] += np.frombuffer(blob, "<i8", n, 4 * n)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros(-(-size // _PART) * _PART, np.int64)
    parts = docs.mapInArrow(W.lean(local), "part int, counts binary").repartition("part").mapInArrow(W.lean(add), "part int, counts binary")
    for row in parts.collect():  # a few numbers for each word of the block
        out[row.part * _PART : (row.part + 1) * _PART] += np.frombuffer(row.counts, "<i8")
    return out[:size]


def _member(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted table of hashes and a bitmap of their leading bits, for ``_found``."""
    bits = np.zeros(1 << 22, bool)
    bits[(values >> np.uint64(42)).astype(np.int64)] = True
    return values, bits


def _found(h: np.ndarray, table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are in the table, and where."""
    maybe = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
    hit = table[at] == h[maybe]
    return maybe[hit], at[hit]


def frequencies(docs: DataFrame, words: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each of the sorted ``words`` and ``grams`` (of n words) occurs in the texts, and how many words there are."""
    shared = docs.sparkSession.sparkContext.broadcast((_member(words), _member(grams)))

    def count(own: np.ndarray, batch: pa.RecordBatch) -> None:
        of_words, of_grams = shared.value
        for _, _, raw, offsets in W.text_chunks(pc.utf8_lower(batch.column(0))):
            h, _, _, first = W.words(raw, offsets)
            own[-1] += len(h)
            own[: len(words)] += np.bincount(_found(h, *of_words)[1], minlength=len(words))
            place, at = _found(W.ngrams(h, n), *of_grams)
            inside = place + n <= first[np.searchsorted(first, place, side="right")] if len(place) else place > 0
            own[len(words) : -1] += np.bincount(at[inside], minlength=len(grams))

    total = _summed(docs, count, len(words) + len(grams) + 1)
    return total[: len(words)], total[len(words) : -1], int(total[-1])


def _windows(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Document, item and bounds of the windows, those of a pair that overlap merged."""
    if not len(doc):
        return
    by = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[by], item[by], lo[by], hi[by]
    pair = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    wide = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + pair * wide) - pair * wide  # the furthest end so far of the same pair
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (lo[1:] > reach[:-1])])
    yield from zip(doc[new].tolist(), item[new].tolist(), lo[new].tolist(), np.maximum.reduceat(hi, new).tolist(), strict=True)


def _search(docs: DataFrame, block: list[tuple], n: int, chance: float, threshold: float, id_col: str, text_col: str, id_type: str, item_type: DataType) -> DataFrame:
    spark = docs.sparkSession
    own = [W.ngrams(h, n) for _, h in block]
    words, all_grams = np.unique(np.concatenate([h for _, h in block])), np.unique(np.concatenate(own))
    word_n, gram_n, total = frequencies(docs.select(text_col), words, all_grams, n)
    rate = word_n / max(total, 1)
    grams, item_of, place = [], [], []
    for k, (_, h) in enumerate(block):
        r = rate[np.searchsorted(words, h)]
        p = np.prod([r[i : len(h) - n + 1 + i] for i in range(n)], axis=0)
        often = gram_n[np.searchsorted(all_grams, own[k])]
        most = max(1, chance * total)
        rare = np.flatnonzero((p * total <= most) | (often <= most)) if (p * total <= most).any() else np.arange(len(p))
        grams.append(own[k][rare])
        item_of.append(np.full(len(rare), k))
        place.append(rare)
    grams, item_of, place = (np.concatenate(x) for x in (grams, item_of, place))
    order = np.argsort(grams, kind="stable")
    grams, item_of, place = grams[order], item_of[order], place[order]
    shared = spark.sparkContext.broadcast((*_member(grams), item_of, place, [h for _, h in block], [i for i, _ in block]))
    arrow_item = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, bits, item_of, place, items, names = shared.value
        sizes = np.array([len(i) for i in items])
        for batch in batches:
            rows: list[tuple] = []
            for lo, _, raw, offsets in W.text_chunks(pc.utf8_lower(batch.column(1))):
                h, _, _, first = W.words(raw, offsets)
                g = W.ngrams(h, n)
                hit, a = _found(g, grams, bits)
                a, b = np.searchsorted(grams, g[hit], "left"), np.searchsorted(grams, g[hit], "right")
                doc = np.searchsorted(first, hit, side="right") - 1
                inside = hit + n <= first[np.minimum(doc + 1, len(first) - 1)]
                hit, a, b, doc = hit[inside], a[inside], b[inside], doc[inside]
                # Each place with each item that has the n-gram.
                many = b - a
                seed = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                at, doc, k = np.repeat(hit, many), np.repeat(doc, many), item_of[seed]
                pad = sizes[k] // 4 + 2
                low, high = at - place[seed] - pad, at - place[seed] + sizes[k] + pad
                best: dict[tuple, tuple] = {}
                for d, k, x, y in _windows(doc, k, np.maximum(low, first[doc]), np.minimum(high, first[doc + 1])):
                    score, i, j = aligned_span(items[k], h[x:y])
                    share = score / (MATCH * len(items[k]))
                    if share >= threshold and share > best.get((d, names[k]), (0,))[0]:
                        best[d, names[k]] = (share, x + i - int(first[d]), x + j - 1 - int(first[d]))
                for (d, name), (share, x, y) in best.items():
                    text = batch.column(1)[lo + d].as_py()
                    _, begin, end = _words_of(text)  # lower case moves bytes, never words
                    whole, x, y = text.encode(), int(begin[x]), int(end[y])
                    start, span = len(whole[:x].decode()), whole[x:y].decode()
                    rows.append((batch.column(0)[lo + d].as_py(), name, float(share), start, start + len(span), span))
            if rows:
                kinds = [batch.schema.field(0).type, arrow_item, pa.float64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "start", "end", "span"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(W.lean(run), f"doc_id {id_type}, item_id {item_type.simpleString()}, score double, start long, `end` long, span string")


def contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = 3,
    chance: float = 1e-8,
    threshold: float = 0.5,
    block_words: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, start, end (characters), span: a row per document and item that it copies."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType
    found = []
    items = ((r.item_id, _hash_text(r.text)) for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator())
    for block in _blocks((x for x in items if len(x[1]) >= seed_words), block_words):
        found.append(_search(docs, block, seed_words, chance, threshold, id_col, text_col, id_type, item_type))
    if not found:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type.simpleString()}, score double, start long, `end` long, span string")
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out
