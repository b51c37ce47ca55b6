"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

Kernel: two strings share every (possibly gapped) subsequence of three bytes within a
reach of ``REACH`` bytes, weighted by ``DECAY`` to the power of the bytes it spans; so
an inserted or dropped character costs some weight and not the match.  The kernel is
divided by what a string of that length would have with itself.

Training, on the driver and on a bounded sample of labelled documents (at most
``most_labelled``, by a hash of their id), of which executors send the distinct words:

1. Strings are words.  A word of a toxic document is a candidate if it or one of its
   4-byte parts is in several toxic documents and in no other; words of documents that
   aren't toxic are negatives.
2. Landmarks are the most frequent candidates and negatives; strings are mapped to the
   span of the landmarks (Nystroem), and a squared-hinge SVM is trained there.  Twice
   the negatives that score worst are added, and toxic documents without a positive
   word give their best one (multiple-instance learning), and it is trained anew.
3. As the kernel is explicit in subsequences, the SVM over landmarks folds exactly into
   one weight for each hashed subsequence.
4. A document's word scores (largest, second, count above the margin) are computed on
   the executors and calibrated to a probability on a third of the labelled documents,
   which is held out of steps 1 and 2.

Scoring is map-only over whole texts, vectorised over all words of a batch.  Labels,
language, source and id are no inputs of a score.

Nulls, empties, repeats: null and empty texts score as documents without any marked
word; label rows that are null or other than 0 and 1 are left out, repeated ones count
as often, and documents that repeat an id are all labelled by it.  Texts of any length
are scored whole.  Without labels of both classes every score is 0.  A row without id is
scored and counts as not held out; ids may be of any type.  Equal counts are taken in
the order of the words.  Empty tables give empty results; further columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W
from tidemark.llm.quality import drawn, fit_logistic

DECAY, REACH, BITS = 0.7, 5, 18
_OFFSETS = [(j, k) for k in range(2, REACH + 1) for j in range(1, k)]
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _norms(n: int) -> np.ndarray:
    """Of lengths 0..n: the norm of a string whose subsequences all differ (1 at least)."""
    size = np.arange(n + 1)
    square = sum(np.maximum(size - k, 0) * DECAY ** (2 * (k - 2)) for _, k in _OFFSETS)
    return np.sqrt(np.maximum(square, 1.0))


def subsequences(raw: np.ndarray, word: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Per offset pair: the weight, the places where it lies in one word, the features there.

    ``word`` tells which word a byte belongs to, -1 for none.
    """
    a, b, c = (raw.astype(np.uint32) * m for m in (_A, _B, _C))
    b ^= b >> np.uint32(13)
    c ^= c >> np.uint32(11)
    for j, k in _OFFSETS:
        n = len(raw) - k
        if n <= 0:
            continue
        at = np.flatnonzero((word[:n] == word[k:]) & (word[:n] >= 0))
        h = (a[at] ^ b[at + j]) * _C + c[at + k]
        h ^= h >> np.uint32(15)
        yield DECAY ** (k - 2), at, (h * _B) >> np.uint32(32 - BITS)


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, the string each belongs to (single bytes between strings belong to none), lengths."""
    raw = np.frombuffer(b"\x00".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    word = np.full(len(raw), -1, np.int64)
    start = np.cumsum(size + 1) - size - 1
    for i, (s, n) in enumerate(zip(start, size, strict=True)):
        word[s : s + n] = i
    return raw, word, size


class Kernel:
    """Kernel values against landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.n = len(landmarks)
        raw, word, size = _flat(landmarks)
        norms = _norms(int(size.max()))[size]
        table = np.zeros((1 << BITS, self.n), np.float32)
        for weight, at, h in subsequences(raw, word):
            np.add.at(table, (h, word[at]), weight / norms[word[at]])
        used = np.flatnonzero(table.any(axis=1))
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[used] = np.arange(len(used))
        self.table = table[used]

    def __call__(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros((len(strings), self.n), np.float32)
        for lo in range(0, len(strings), 4000):
            part = strings[lo : lo + 4000]
            raw, word, size = _flat(part)
            norms = _norms(int(size.max()))[size]
            for weight, at, h in subsequences(raw, word):
                slot = self.slot[h]
                own, slot = word[at[slot >= 0]], slot[slot >= 0]
                if len(own):  # places ascend, so a word's are together
                    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    out[lo + own[new]] += weight * np.add.reduceat(self.table[slot], new, axis=0)
            out[lo : lo + 4000] /= norms[:, None]
        return out

    def against(self, strings: list[bytes], beta: np.ndarray) -> np.ndarray:
        """Weighted sums of kernel values, a few thousand strings at a time."""
        parts = [self(strings[lo : lo + 4000]) @ beta for lo in range(0, len(strings), 4000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """One weight a feature, for a function with weight beta on each landmark."""
        w = np.zeros(1 << BITS, np.float32)
        used = self.slot >= 0
        w[used] = self.table[self.slot[used]] @ beta.astype(np.float32)
        return w


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Squared hinge by accelerated gradient descent: weights and a bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = weight / weight.sum()
    rate = 0.5 / (float((np.einsum("ij,ij->i", x, x) * weight).sum()) + 1)
    w, look = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for k in range(steps):
        slack = np.maximum(1 - sign * (x @ look[:-1] + look[-1]), 0) * weight * -2 * sign
        new = look - rate * np.append(slack @ x + l2 * look[:-1], slack.sum())
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    calibration: np.ndarray


#: ASCII punctuation, which doesn't count at a word's ends.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True

#: A document's features when it has no word.
_NONE = (-2.0, -2.0, 0.0)


def document_features(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Per text: the largest and second word scores (clipped to [-2, 2]) and log(1 + words above 0)."""
    out = np.tile(np.array(_NONE), (len(offsets) - 1, 1))
    _, begin, end, first = W.words(raw, offsets)
    if not len(begin):
        return out
    body = np.flatnonzero(~_MARK[raw])  # words without the marks around them; one of marks alone stays as it is
    inner, after = np.searchsorted(body, begin), np.searchsorted(body, end)
    some = after > inner
    begin[some], end[some] = body[inner[some]], body[after[some] - 1] + 1
    size = end - begin
    word = np.full(len(raw), -1, np.int64)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    word[at] = np.repeat(np.arange(len(size)), size)
    total = np.zeros(len(raw))
    for weight, place, feature in subsequences(raw, word):
        total[place] += weight * weights[feature]
    norm = _norms(64)
    longest = _norms(int(size.max())) if int(size.max()) > 64 else norm
    score = np.add.reduceat(total[at], np.cumsum(size) - size) / longest[size] + bias
    score = np.clip(score, -2, 2)
    some = np.flatnonzero(first[1:] > first[:-1])
    starts = first[:-1][some]
    top = np.maximum.reduceat(score, starts)
    doc = np.repeat(np.arange(len(some)), (first[1:] - first[:-1])[some])
    lead = np.flatnonzero(score == top[doc])
    rest = score.copy()
    rest[lead[np.unique(doc[lead], return_index=True)[1]]] = -2
    out[some, 0] = top
    out[some, 1] = np.maximum.reduceat(rest, starts)
    out[some, 2] = np.log1p(np.add.reduceat((score > 0).astype(float), starts))
    return out


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _words(text: str) -> set[bytes]:
    words = {w.strip(_MARKS) for w in (_lowered(pa.array([text]))[0].as_py() or "").encode().split()}
    return {w for w in words if 3 <= len(w) <= 40}


def _parts(word: bytes) -> set[bytes]:
    return {word[i : i + 4] for i in range(len(word) - 3)} | {b"=" + word}


def train(vocabulary: list[bytes], doc: np.ndarray, word: np.ndarray, y: np.ndarray, landmarks: int = 128, least: int = 4) -> tuple[np.ndarray, float] | None:
    """Weights of subsequences and a bias from which words (ascending, without repeats) which document has.

    ``doc`` and ``word`` are pairs of numbers, ``y`` the documents' labels.
    """
    if not 0 < y.sum() < len(y):
        return None
    toxic = y[doc] == 1
    bad, good = (np.bincount(word[m], minlength=len(vocabulary)) for m in (toxic, ~toxic))
    # In how many toxic documents a part is, and whether in another.
    parts = [sorted(_parts(w)) for w in vocabulary]
    number = {p: i for i, p in enumerate(dict.fromkeys(p for own in parts for p in own))}
    size = np.array([len(p) for p in parts])
    flat, start = np.array([number[p] for own in parts for p in own]), np.cumsum(size) - size
    of = lambda words: flat[np.repeat(start[words] - (np.cumsum(size[words]) - size[words]), size[words]) + np.arange(int(size[words].sum()))]
    pairs = np.unique(np.repeat(doc[toxic], size[word[toxic]]) * len(number) + of(word[toxic]))
    part_bad = np.bincount(pairs % len(number), minlength=len(number))
    part_bad[of(np.flatnonzero(good > 0))] = 0
    marked = np.add.reduceat(part_bad[flat] >= least, start) > 0
    del pairs, part_bad, flat, parts, number
    often = lambda words, n: words[np.lexsort((words, -n[words]))]
    candidates = often(np.flatnonzero((bad > 0) & (good == 0) & marked), bad)
    if not len(candidates):
        candidates = often(np.flatnonzero((bad > 0) & (good == 0)), bad)[:landmarks]
    negatives = often(np.flatnonzero(good > 0), good)
    if not len(candidates) or not len(negatives):
        return None
    text = lambda words: [vocabulary[i] for i in words]
    positive, hard = set(candidates[:4000].tolist()), negatives[:0]
    words_of = np.split(word[toxic][np.argsort(doc[toxic], kind="stable")], np.cumsum(np.unique(doc[toxic], return_counts=True)[1])[:-1])
    seen = np.flatnonzero(bad > 0)
    for _ in range(3):
        ordered = often(np.array(sorted(positive)), bad)
        marks = text(np.r_[ordered[:landmarks], negatives[: landmarks // 2], hard[: landmarks // 2]])
        kernel = Kernel(marks)
        rest = np.array(list(dict.fromkeys([*hard.tolist(), *negatives[:12000].tolist()])))
        side = np.arange(len(ordered) + len(rest)) < len(ordered)
        k, inner = kernel(text(np.r_[ordered, rest])), kernel(marks)
        value, vector = np.linalg.eigh((inner + inner.T).astype(np.float64) / 2 + 1e-4 * np.eye(kernel.n))
        root = vector / np.sqrt(np.maximum(value, 1e-4))  # Nystroem: K_xl K_ll^(-1/2)
        w = _svm(k @ root, side, np.where(side, 0.5 / side.sum(), 0.5 / (~side).sum()))
        beta, bias = root @ w[:-1], float(w[-1])
        s = kernel.against(text(negatives[:40000]), beta) + bias
        hard = negatives[np.argsort(-s, kind="stable")[:2000]]
        # A toxic document without a positive word gives its best one, if no other document has it.
        s = np.full(len(vocabulary), -np.inf)
        s[seen] = kernel.against(text(seen), beta) + bias
        for own in words_of:
            best = int(own[np.argmax(s[own])])
            if positive.isdisjoint(own.tolist()) and s[best] > 0 and not good[best]:
                positive.add(best)
    return kernel.fold(beta), bias


def _bucket(column: str, modulus: int):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % modulus


def _labelled_words(rows: DataFrame) -> pa.Table:
    """doc (a number), y, held, words (ascending, distinct) of (y, held, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, 200):
            words = pa.array([sorted(_words(t or "")) for t in batch.column(2).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["y", "held", "words"])

    return rows.select("y", "held", "text").mapInArrow(W.lean(run), "y int, held boolean, words array<binary>").toArrow()


def _labelled_features(rows: DataFrame, weights: np.ndarray, bias: float) -> pa.Table:
    """y, held and the features of (y, held, text) rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in W.text_chunks(_lowered(batch.column(2))):
                x = document_features(raw, offsets, *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *(pa.array(c) for c in x.T)], names=["y", "held", "a", "b", "c"])

    return rows.select("y", "held", "text").mapInArrow(W.lean(run), "y int, held boolean, a double, b double, c double").toArrow()


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labelled: int, folds: int, id_col: str) -> Model | None:
    """A model of labelled rows outside fold 0: words from two thirds of them, calibration from the rest."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(_bucket("id", folds) != 0)
    held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 2
    chosen = drawn(known, most_labelled, known.count(), 0, "y").withColumn("held", held).collect()
    kind = known.schema["id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(spark.createDataFrame(chosen, f"id {kind}, y int, held boolean")), "id")
    got = _labelled_words(rows)
    y, out = got["y"].to_numpy(), np.array(got["held"].to_pylist(), bool)
    if not out.any() or not 0 < y[~out].sum() < (~out).sum():  # too few to hold any out
        out = np.zeros(len(y), bool)
    lists = got["words"].combine_chunks()
    sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    coded = lists.flatten().dictionary_encode()
    entries = coded.dictionary.to_pylist()
    by = sorted(range(len(entries)), key=entries.__getitem__)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    doc, word = np.repeat(np.arange(len(y)), sizes), rank[coded.indices.to_numpy()]
    mine = ~out[doc]
    numbers, doc = np.unique(doc[mine], return_inverse=True)
    used, word = np.unique(word[mine], return_inverse=True)
    fitted = train([entries[by[i]] for i in used.tolist()], doc, word, y[numbers]) if len(doc) else None
    if fitted is None:
        return None
    table = _labelled_features(rows, *fitted)
    x, y, out = np.column_stack([table[c].to_numpy() for c in "abc"]), table["y"].to_numpy(), np.array(table["held"].to_pylist(), bool)
    out = out if 0 < y[out].sum() < out.sum() else np.ones(len(y), bool)
    order = np.lexsort((*x[out].T, y[out]))  # the sums of a fit depend on the order
    return Model(*fitted, fit_logistic(x[out][order], y[out][order].astype(np.float64), np.ones(int(out.sum())), 1e-4, 2000))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, word_score (the most toxic word's)."""
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels, most_labelled, folds, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in W.text_chunks(_lowered(batch.column(1)), 1 << 20):
                if own is None:
                    score, word = np.zeros(hi - lo), np.full(hi - lo, _NONE[0])
                else:
                    x = document_features(raw, offsets, own.weights, own.bias)
                    score = np.round(1 / (1 + np.exp(-np.clip(x @ own.calibration[:-1] + own.calibration[-1], -30, 30))), 9)
                    word = np.round(x[:, 0], 6)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(word)], names=["id", "score", "predicted", "word_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col("text")).mapInArrow(W.lean(run), f"id {kind}, score double, predicted int, word_score double")
    held = F.coalesce(_bucket("id", folds) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted", "word_score")
