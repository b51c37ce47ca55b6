"""Quality classifier by co-training of two views.

The text view sees content alone: hashed byte n-grams of the text and its layout (lines,
words, repetition of lines and of words, upper case, punctuation).  The metadata view
sees the page's record alone and never the text: language, source, declared length.
Each view is a logistic regression.  In each round each view labels unlabelled documents
where it is surest by its calibrated probability, and those pseudo-labels train the other view.  A
round has unlabelled documents of its own, drawn from all rows; its labels are taken by a
view if they don't harm it on the rows held out.  Scores are calibrated (Platt) on labelled
rows held out of training, the two calibrated views are combined by a weighting that is
fitted on the same rows, and all documents are scored map-only.

Fitting takes at most ``most_labelled`` labelled rows and ``most_pool`` unlabelled ones a
round, by hashes of their ids; that bounds what the driver holds (features of 4 bytes
times ``TEXT_DIMS`` a row).  A threshold on the hash thins the rows on the executors, so
what is sent does not grow with them.  Scoring reads every whole text.

Nulls, empties, repeats: a null text counts as empty, a null metadata value as a value
of its own; labels that are null or other than 0 and 1 are left out; repeated label
rows count as often as they occur, and documents that repeat an id are all labelled by
it.  Rows are ordered by id, text and record, so ties change nothing.  Without labels of
both classes every document scores 0.5 and none is rejected.  A row without id is scored
like any other and takes no part in fitting.  Empty tables give empty results; further
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash as W

GRAM_DIMS, LAYOUT = 1024, 12
TEXT_DIMS = GRAM_DIMS + LAYOUT
META_DIMS = 64 + 3


def grams_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts of byte 2- and 3-grams, as square roots of shares, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, GRAM_DIMS), np.float32)
    b = raw.astype(np.uint32)
    for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(b) < width:
            continue
        g = np.full(len(b) - width + 1, width, np.uint32)
        for k in range(width):
            g = (g ^ b[k : len(b) - width + 1 + k]) * np.uint32(salt)
            g ^= g >> np.uint32(15)
        g = (g >> np.uint32(7)) % np.uint32(GRAM_DIMS)
        for i in range(n):
            a, z = int(offsets[i]), int(offsets[i + 1]) - width + 1
            if z > a:
                out[i] += np.bincount(g[a:z], minlength=GRAM_DIMS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def _slot(value: object, kind: str) -> int:
    h = np.uint64(len(kind) + 1)
    for c in f"{kind}={value}".encode():
        h = (h ^ np.uint64(c)) * np.uint64(0x100000001B3)
    return int(W.mix(np.array([h]))[0] % np.uint64(32))


def layout_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Figures of lines and words, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, LAYOUT), np.float32)
    h, begin, end, first = W.words(raw, offsets)
    size = end - begin
    for i in range(n):
        a, z = int(first[i]), int(first[i + 1])
        t = raw[offsets[i] : offsets[i + 1]]
        nb, nw = len(t), z - a
        lines = np.diff(np.flatnonzero(np.r_[True, t == 10, True])) if nb else np.zeros(1)
        words = size[a:z]
        repeat = 1 - len(np.unique(h[a:z])) / max(nw, 1)
        twice = float((h[a + 1 : z] == h[a : z - 1]).mean()) if nw > 1 else 0.0
        upper = float(((t >= 65) & (t <= 90)).sum()) / max(nb, 1)
        marks = float((((t >= 33) & (t <= 47)) | ((t >= 58) & (t <= 64)) | (t >= 91) & (t <= 96) | (t >= 123) & (t <= 126)).sum()) / max(nw, 1)
        out[i] = (
            np.log1p(nb) / 10,
            np.log1p(nw) / 10,
            np.log1p(len(lines)) / 5,
            nb / max(len(lines), 1) / 200,
            float(lines.max()) / max(nb, 1),
            float(words.mean()) / 10 if nw else 0.0,
            float(words.std()) / 10 if nw else 0.0,
            repeat,
            twice * 4,
            upper * 4,
            min(marks, 8.0),
            float(nw < 20),
        )
    return out


def text_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.hstack([grams_of(raw, offsets), layout_of(raw, offsets)])


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Hashed language and source, and the declared length, one row per document."""
    out = np.zeros((len(langs), META_DIMS), np.float32)
    with np.errstate(over="ignore"):
        slots = {("lang", v): _slot(v, "lang") for v in set(langs)} | {("source", v): 32 + _slot(v, "source") for v in set(sources)}
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, slots["lang", lang]] = 1
        out[i, slots["source", source]] = 1
        out[i, 64:] = 1.0, np.log1p(max(size or 0, 0)) / 10, float(size is None or size < 0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 150) -> np.ndarray:
    """Weights and a bias by accelerated gradient descent; deterministic."""
    x = np.ascontiguousarray(x, np.float32)
    rate = 4.0 / (float(np.einsum("ij,ij->i", x, x).mean()) + 1)
    w, look = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for k in range(steps):
        err = (_sigmoid(x @ look[:-1].astype(np.float32) + look[-1]) - y) * weight
        grad = np.append(err.astype(np.float32) @ x + l2 * look[:-1], err.sum())
        new = look - rate * grad
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class View:
    """A standardised logistic regression and its Platt calibration."""

    centre: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.w[:-1] + self.w[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] * self.raw(x) + self.platt[1]


#: The few layout figures together weigh as much as all n-grams.
_GAIN = np.r_[np.ones(GRAM_DIMS), np.full(LAYOUT, (GRAM_DIMS / LAYOUT) ** 0.5)].astype(np.float32)


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> View:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    if x.shape[1] == TEXT_DIMS:
        scale = scale / _GAIN
    # Classes weigh the same, whatever their shares.
    balance = np.where(y == 1, 0.5 / max(float((weight * y).sum()), 1e-9), 0.5 / max(float((weight * (1 - y)).sum()), 1e-9))
    return View(centre, scale, fit_logistic((x - centre) / scale, y, weight * balance, l2))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's line on rows that the view was not trained on."""
    if 0 < y.sum() < len(y):
        z = view.raw(x)[:, None]
        s = float(np.abs(z).max()) + 1e-6
        a, b, *_ = fit_logistic(z / s, y, np.ones(len(y)), 1e-4, 500)
        view.platt = (max(float(a), 1e-3) / s, float(b))


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(xt), self.meta.logit(xm)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, pool: list[tuple[np.ndarray, np.ndarray]], sure: float, l2: float = 1e-3) -> CoTrained:
    """Views trained on the rows that are not ``held`` and on each other's surest labels of a round's pool; calibrated on the held."""
    ty, hy = y[~held].astype(np.float64), y[held].astype(np.float64)
    own = {"text": xt, "meta": xm}
    extra = {k: (x[:0], np.zeros(0)) for k, x in own.items()}  # the other view's labels so far
    offered, best = dict(extra), dict.fromkeys(own, np.inf)
    views: dict[str, View] = {}
    for turn in range(len(pool) + 1):
        for k, x in own.items():
            rows, labels = np.vstack([extra[k][0], offered[k][0]]), np.append(extra[k][1], offered[k][1])
            view = fit_view(np.vstack([x[~held], rows]), np.append(ty, labels), np.append(np.ones(len(ty)), np.full(len(labels), 0.5)), l2)
            calibrate(view, x[held], hy)
            p = np.clip(_sigmoid(view.logit(x[held])), 1e-6, 1 - 1e-6)
            loss = -float(np.mean(hy * np.log(p) + (1 - hy) * np.log(1 - p))) if len(hy) else 0.0
            if loss <= best[k]:  # labels that harm on the rows held out are not taken
                views[k], best[k], extra[k] = view, loss, (rows, labels)
        if turn < len(pool):
            unlabelled = dict(zip(own, pool[turn], strict=True))
            for k, other in (("text", "meta"), ("meta", "text")):
                p = _sigmoid(views[k].logit(unlabelled[k])) if len(unlabelled[k]) else np.zeros(0)
                pick = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                offered[other] = unlabelled[other][pick], (p[pick] >= 0.5).astype(np.float64)
    text, meta = views["text"], views["meta"]
    mix = np.array([0.5, 0.5, 0.0])
    if 0 < hy.sum() < len(hy):
        z = np.stack([text.logit(xt[held]), meta.logit(xm[held])], axis=1)
        mix = fit_logistic(z / 4, hy, np.ones(len(hy)), 1e-4, 500) / np.array([4, 4, 1])
        mix[:2] = np.maximum(mix[:2], 0)
    return CoTrained(text, meta, mix)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    langs, sources, sizes = (batch.column(i).to_pylist() for i in (2, 3, 4))
    for lo, hi, raw, offsets in W.text_chunks(batch.column(1)):
        for a in range(0, hi - lo, 512):
            z = min(a + 512, hi - lo)
            part, off = raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            yield lo + a, lo + z, text_view(part, off), meta_view(langs[lo + a : lo + z], sources[lo + a : lo + z], sizes[lo + a : lo + z])


def _scored(model: CoTrained | None, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of rows with the scores of both views and the combined one; 0.5 without a model."""
    for lo, hi, xt, xm in _views(batch):
        scores = model.score(xt, xm) if model else [np.full(hi - lo, 0.5)] * 3
        yield lo, hi, [np.round(s.astype(np.float64), 9) for s in scores]


def _records(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n"))


def _features(rows: DataFrame) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Ids, rounds and features of a bounded number of rows (with a column ``turn``), gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, xt, xm in _views(batch):
                blobs = [[r.tobytes() for r in x.astype(np.float32)] for x in (xt, xm)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(5)[lo:hi], pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=["id", "turn", "t", "m"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(W.lean(run), f"id {kind}, turn int, t binary, m binary").toArrow().sort_by([("id", "ascending"), ("turn", "ascending"), ("t", "ascending"), ("m", "ascending")])
    views = [np.frombuffer(b"".join(got[k].to_pylist()), np.float32).reshape(len(got), d) for k, d in (("t", TEXT_DIMS), ("m", META_DIMS))]
    return got["id"].to_pylist(), got["turn"].to_pylist(), *views


_HASHES = 1 << 40


def drawn(rows: DataFrame, most: int, total: int, salt: int, *ties: str) -> DataFrame:
    """At most ``most`` of ``total`` rows (with ``id``), by a hash of the id; a threshold leaves little more to be sorted."""
    h = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(_HASHES))
    below = min(_HASHES, int(_HASHES * (most + 6 * most**0.5 + 10) / max(total, 1)))
    return rows.where(h < below).orderBy(h, "id", *ties).limit(most)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labelled: int, most_pool: int, rounds: int, sure: float, id_col: str = "doc_id") -> CoTrained | None:
    rows = _records(docs, id_col)
    # Bounded samples; their ids are few enough to broadcast.
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y"))
    chosen = drawn(known, most_labelled, known.count(), 0, "y").collect()
    if len({r.y for r in chosen}) < 2:
        return None
    ys: dict = {}
    for r in chosen:
        ys.setdefault(r.id, []).append(r.y)
    named = rows.where("id is not null").select("id")
    total, turns = named.count(), {i: -1 for i in ys}
    for turn in range(rounds):
        for r in drawn(named, most_pool, total, turn + 1).collect():
            turns.setdefault(r.id, turn)
    kind = rows.schema["id"].dataType.simpleString()
    wanted = spark.createDataFrame(list(turns.items()), f"id {kind}, turn int")
    ids, turn, xt, xm = _features(rows.join(F.broadcast(wanted), "id").select(*rows.columns, "turn"))
    labelled = [(k, y) for k, i in enumerate(ids) for y in ys.get(i, ())]
    if len({y for _, y in labelled}) < 2:
        return None
    at, y = np.array([k for k, _ in labelled]), np.array([v for _, v in labelled])
    held = np.arange(len(y)) % 4 == 3
    pool = [(xt[own], xm[own]) for own in (np.flatnonzero(np.array(turn) == k) for k in range(rounds))]
    return co_train(xt[at], xm[at], y, held, pool, sure)


def quality_scores(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 4000,
    most_pool: int = 2000,
    rounds: int = 3,
    sure: float = 0.95,
    reject_below: float = 0.3,
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good quality), kept."""
    model = fit(spark, docs, labels, most_labelled, most_pool, rounds, sure, id_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, scores in _scored(own, batch):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(s) for s in scores), pa.array(scores[2] >= reject_below)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _records(docs, id_col).mapInArrow(W.lean(run), f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def kept_rows(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 4000,
    most_pool: int = 2000,
    rounds: int = 3,
    sure: float = 0.95,
    reject_below: float = 0.3,
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, with all their columns.

    Each row is judged where it is read, so none is joined or shuffled, and rows that are
    equal or have no id go by their own scores.
    """
    model = fit(spark, docs, labels, most_labelled, most_pool, rounds, sure, id_col)
    shared = spark.sparkContext.broadcast(model)
    width, text = len(docs.columns), [c.lower() for c in docs.columns].index("text")
    # What the metadata view reads comes last, under names that ``docs`` doesn't have.
    free = "_" * (1 + max(map(len, docs.columns)))
    asked = [F.col(c).cast(kind).alias(free + c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            columns = batch.columns
            rows = pa.RecordBatch.from_arrays(columns[:width], names=batch.schema.names[:width])
            judged = pa.RecordBatch.from_arrays([columns[text], columns[text], *columns[width:]], names=["id", "text", "lang", "source", "n"])
            for lo, hi, scores in _scored(own, judged):
                yield rows.slice(lo, hi - lo).filter(pa.array(scores[2] >= reject_below))

    return docs.select("*", *asked).mapInArrow(W.lean(run), docs.schema)
