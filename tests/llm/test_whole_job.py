"""Cases where an operator or the pipeline once did less than the whole job."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import frame, prose
from tests.llm.test_pipeline import tables
from tidemark.llm import queries as own
from tidemark.llm import substring_dedup as sd
from tidemark.llm.quality import kept_rows, quality_scores


def test_lm_query_learns_what_occurs_once(spark, tmp_path):
    """op7 against a brute-force model of all training n-grams, those seen once included."""
    rng = random.Random(4)
    texts = [prose(rng, 40).replace(",", "").replace(".", "") for _ in range(30)]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(30)]
    texts[out.index(True)] = texts[out.index(False)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in own.queries()["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    tokens = [[*t.split(), "\n"] for t in texts]
    c = collections.Counter(tuple(t[i : i + k]) for t, o in zip(tokens, out, strict=True) if not o for k in (1, 2, 3) for i in range(len(t) - k + 1))
    n, v = sum(m for g, m in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    used = collections.Counter()
    for g, m in c.items():
        used[g[:-1]] += m - 0.75

    def p(w, h):
        if not h:
            return (c[w,] + 1) / (n + v + 1)
        if h not in c:
            return p(w, h[1:])
        return max(c[(*h, w)] - 0.75, 0) / c[h] + (1 - used[h] / c[h]) * p(w, h[1:])

    for i, t in enumerate(tokens):
        score = sum(math.log10(p(w, tuple(t[max(0, j - 2) : j]))) for j, w in enumerate(t))
        assert got[i].held_out == out[i] and abs(got[i].score - score) < 0.03 * len(t)


def test_substring_keeps_text_between_passages(spark):
    """A passage, own text and another passage, with an exact copy of the whole: own text stays where it is first."""
    rng = random.Random(8)
    passage, other, text, tail = (prose(rng, n) for n in (80, 60, 90, 40))
    mixed = f"{passage} {text} {other} {tail}"
    docs = [prose(rng, 30) + " " + passage, other + " " + prose(rng, 30), mixed, mixed, prose(rng, 50)]
    spans = sd.repeated_spans(spark, frame(spark, docs)).toPandas().sort_values(["doc_id", "start"])
    cut = {r.doc_id: r.text for r in sd.remove_spans(frame(spark, docs), sd.repeated_spans(spark, frame(spark, docs))).collect()}
    assert (cut[0], cut[1], cut[4]) == (docs[0], docs[1], docs[4])
    assert text in cut[2] and tail in cut[2] and len(cut[2]) < len(mixed) - len(passage) // 2 - len(other) // 2
    assert len(cut[3]) < 150
    two = spans[spans.doc_id == 2]
    assert two.kept.tolist() == [True, False, True, False, True] and two.first_doc_id.tolist() == [2, 0, 2, 1, 2]
    assert (two.start.iloc[1:].to_numpy() == two.end.iloc[:-1].to_numpy()).all()
    assert not spans[spans.doc_id == 3].kept.any() and (spans[~spans.kept].words >= 16).all()
    for r in spans.itertuples():
        assert abs(r.words - len(docs[r.doc_id][r.start : r.end].split())) <= 1


def test_substring_first_units_stay(spark):
    """Of random mosaics of passages, with copies: no unit that occurs first is cut, and every long repeat is."""
    rng = random.Random(15)
    pool = [prose(rng, rng.choice([6, 12, 30, 60])) for _ in range(20)]
    docs = [" ".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 25) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    docs += [docs[k] for k in range(0, 60, 4)]
    docs = [f"{rng.random():.16f} {t}" for t in docs]  # cuts in a text's first bytes may depend on the text before it
    spans = sd.repeated_spans(spark, frame(spark, docs)).collect()
    owner, places = collections.defaultdict(set), []
    for i, t in enumerate(docs):
        raw = np.frombuffer(t.encode(), np.uint8)
        for d, a, z, _ in zip(*(x.tolist() for x in sd.units(raw, np.array([0, len(raw)]), 20, 128, 40)), strict=True):
            owner[d].add(i)
            places.append((i, a, z, d))
    gone = {i: [False] * len(t) for i, t in enumerate(docs)}
    for r in spans:
        if not r.kept:
            assert not any(gone[r.doc_id][r.start : r.end])
            gone[r.doc_id][r.start : r.end] = [True] * (r.end - r.start)
    for i, a, z, d in places:
        if len(owner[d]) > 1 and min(owner[d]) == i:
            assert not any(gone[i][a:z])
    assert sum(map(sum, gone.values())) > sum(len(docs[k]) for k in range(60, 75)) * 0.7


def test_pipeline_judges_rows(spark, tmp_path):
    """Rejected and contaminated rows without id go; of an id with two texts only the text that is a copy goes."""
    rng = random.Random(31)
    good = [prose(rng, 60) for _ in range(90)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60).split()) for _ in range(41)]
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    alone, close, both = (prose(rng, 60) for _ in range(3))
    near = " ".join([*close.split()[:-1], "other"])
    docs = [*enumerate([*good, *bad[:40]]), (None, bad[40]), (None, item), (None, alone)]
    docs += [(200, both), (201, both), (201, prose(rng, 60)), (300, close), (301, near), (301, prose(rng, 60)), (302, alone + " x"), (302, alone + " y")]
    sf = tables(spark, tmp_path, docs, [(i, int(i < 90), 0) for i in range(130) if i % 4], [(1, item)])
    now = spark.read.parquet(f"{sf}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({(r.doc_id, r.text) for r in now.collect()})
    assert (None, bad[40]) not in left[0] and {(None, item), (None, alone), *docs[133:]} <= left[0]
    assert (201, both) not in left[1] and {(200, both), docs[135], *docs[136:]} <= left[1]
    assert (301, near) not in left[2] and {(300, close), docs[138]} <= left[2] and len({docs[139], docs[140]} & left[2]) == 1
    assert (None, item) not in left[3] and left[3] == left[2] - {(None, item)}


def test_kept_rows_are_those_that_scores_keep(spark):
    rng = random.Random(32)
    texts = [prose(rng, 60) for _ in range(60)] + [" ".join(w + "%%%" for w in prose(rng, 60).split()) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t), [i], "z") for i, t in enumerate(texts)]
    rows += [(None, texts[99], "en", "s", None, None, None), (100, None, None, None, -1, [], ""), (101, "", "en", "s", 0, [1, None], "z"), (5, texts[5], "en", "s", len(texts[5]), [5], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, kept array<int>, `_text` string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100) if i % 4], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality_scores(spark, docs, labels).where("kept").collect()}
    out = kept_rows(spark, docs, labels)
    assert out.schema == docs.schema
    key = lambda rs: sorted(map(repr, rs))
    assert 60 <= len(kept) < 70 and 99 not in kept and key(tuple(r) for r in out.collect()) == key(r for r in rows if r[0] in kept)
    assert key(tuple(r) for r in kept_rows(spark, docs, labels.limit(0)).collect()) == key(rows)
    assert kept_rows(spark, docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 700, 40_000])
def test_bitmap_lookup_keeps_every_probe(spark, n):
    from tidemark.llm.bitmap import may_hold

    probes = spark.range(n).select(F.when(F.col("id") != 5, F.xxhash64("id")).alias("probe"))
    rows = spark.range(2 * n + 10).select("id", F.when(F.col("id") != 7, F.xxhash64("id")).alias("h"), F.lit("x").alias("probe"))
    got = may_hold(probes, n)(rows, F.col("h"), "held")
    assert got.columns == ["id", "h", "probe", "held"] and got.count() == 2 * n + 10
    held = {r.id for r in got.where("held").collect()}
    assert set(range(n)) - {5, 7} <= held and 7 not in held
    assert len(held) <= n + max(20, n // 8)
