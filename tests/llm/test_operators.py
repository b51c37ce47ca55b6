"""Each operator against a brute-force version on planted cases: nulls, empties, long texts, ties, repeats, extra columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontaminate as de
from tidemark.llm import exact_dedup as ed
from tidemark.llm import ngram_join as nj
from tidemark.llm import ngram_lm as lm
from tidemark.llm import packing as pk
from tidemark.llm import substring_dedup as sd
from tidemark.llm import toxicity as tx
from tidemark.llm import url_filter as uf
from tidemark.llm import warc as wa
from tidemark.llm import wordhash as W
from tidemark.llm.components import components
from tidemark.llm.decontaminate import aligned_span, contaminated
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.quality import quality_scores
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, norm string, digest string, n bigint, id bigint, start bigint"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "su", "ta", "vo", "zen") for b in ("r", "sh", "nd", "ple", "gom", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with what operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([0, 1, 3, 4, 5, 40, 120])) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        for edits in (1, 2, 4):
            v = list(w)
            for _ in range(min(edits, len(v))):
                v[rng.randrange(len(v))] = rng.choice(WORDS) + "x"
            near.append(" ".join(v))
    return [*base, *near, None, "", " \t\n", base[7], base[7].replace(" ", "\n", 1), base[8].upper(), "a  b", "a b", "a\u00a0b", "word " * 30_000, "É" * 50_000]


# Words


@given(st.lists(st.text(alphabet="aAé \t\n.\u00a0漢", max_size=12), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, begin, end, first = W.words(raw, offsets)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    got = [[lower(raw[b:e].tobytes().decode()) for b, e in zip(begin[x:y], end[x:y], strict=True)] for x, y in zip(first, first[1:], strict=False)]
    assert got == want
    flat = [w for t in want for w in t]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


# 1


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit(sizes):
    bins, offsets, fills = pk.best_fit(np.array(sizes, np.int64), 64)
    inside = collections.defaultdict(list)
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes, strict=True):
        inside[b].append((o, s))
    for b, items in inside.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == fills[b] <= 64
    assert sum(f <= 32 for f in fills) <= 1


def test_encoder(texts):
    own, theirs = pk.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert own.agrees() and own.ids("x <|endoftext|> y") == [87, 220, 50256, 331]
    for t in [t for t in texts if t is not None and len(t) < 5000]:
        assert own.ids(t) == theirs.encode(t, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "a", "'ll", "漢", "\n", "12", "<", "|>", "\u00a0", "🙂"]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_encoder_reads_added_tokens(parts):
    text = "".join(parts)
    assert pk.encoder(tokenizer_path(), True).ids(text) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def brute_rounds(sizes, groups, fan_in, capacity):
    """Sequences if every bin of a group goes up the tree."""
    level = [[s for i, s in enumerate(sizes) if i % groups == g] for g in range(groups)]
    while True:
        level = [pk.best_fit(np.array(g, np.int64), capacity)[2].tolist() for g in level]
        if len(level) == 1:
            return len(level[0])
        level = [sum(level[k : k + fan_in], []) for k in range(0, len(level), fan_in)]


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.integers(2, 20), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_emptiest_bins_are_enough(sizes, groups, fan_in):
    level, done = [[s for i, s in enumerate(sizes) if i % groups == g] for g in range(groups)], 0
    while len(level) > 1:
        bins = [sorted(pk.best_fit(np.array(g, np.int64), 64)[2].tolist()) for g in level]
        done += sum(len(b[fan_in + 1 :]) for b in bins)
        level = [sum((b[: fan_in + 1] for b in bins[k : k + fan_in]), []) for k in range(0, len(bins), fan_in)]
    assert done + len(pk.best_fit(np.array(level[0], np.int64), 64)[2]) == brute_rounds(sizes, groups, fan_in, 64)


@pytest.mark.parametrize("group", [20_000, 7])
def test_packing(spark, texts, group):
    own = pk.Encoder(tokenizer_path())
    docs = frame(spark, [*texts, "twice", "twice"], [*range(len(texts)), 900, 900])
    got = pk.pack(spark, docs, tokenizer_path(), items_per_group=group, fan_in=2).toPandas()
    total = 0
    for i, t in enumerate(texts):
        ids = [*own.ids(t or ""), 2]
        total += len(ids)
        rows = got[got.doc_id == i].sort_values("piece")
        assert [x for b in rows.ids for x in np.frombuffer(b, "<u4").tolist()] == ids
        assert rows.start.tolist() == [0, *np.cumsum(rows.length).tolist()[:-1]] and rows.piece.tolist() == list(range(len(rows)))
        assert len(rows) == math.ceil(len(ids) / 1024) and (rows.length.iloc[1:] == 1024).all()
    assert len(got[got.doc_id == 900]) == 2
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length).tolist()[:-1]] and rows.length.sum() <= 1024
    assert got.sequence_id.nunique() <= math.ceil(total / 1024) + 3
    assert pk.pack(spark, docs.limit(0), tokenizer_path()).count() == 0


# 2


def brute_components(texts, width=5):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for t in texts]
    sets = [frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []) for w in words]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_ngram_join(spark, texts, rows):
    assert rows(jaccard_components(spark, frame(spark, texts))) == sorted(brute_components(texts), key=repr)


def test_ngram_join_edges(spark, rows):
    assert jaccard_components(spark, frame(spark, ["x"]).limit(0)).count() == 0
    same = frame(spark, ["a b c d e f"] * 3 + [None], [5, 5, None, 7])
    assert rows(jaccard_components(spark, same)) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (7, 0, 7)], key=repr)


def test_ngram_join_family(spark, rows):
    """One large family of near copies around a base, with members that link only to each other."""
    rng = random.Random(9)
    base = prose(rng, 90).split()
    family = []
    for _ in range(150):
        v = list(base)
        for _ in range(rng.randrange(6)):
            v[rng.randrange(len(v))] = f"w{rng.randrange(40)}"
        family.append(" ".join(v))
    assert rows(jaccard_components(spark, frame(spark, family))) == sorted(brute_components(family), key=repr)


@pytest.mark.parametrize("cut", [None, [1], [3, 3, 5], [2, 6]])
def test_shared_columns(cut):
    cols = [1, 2, 2, 3, 4, 4, 4, 5, 5]
    cuts = [0, *(cut or []), len(cols)]
    batches = [pa.RecordBatch.from_pydict({"col": np.array(cols[a:b], np.int64), "key": np.arange(a, b), "id": np.arange(a, b)}) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert [i for b in nj.shared_columns(iter(batches)) for i in b.column(2).to_pylist()] == [1, 2, 4, 5, 6, 7, 8]
    assert [x[0].tolist() for x in nj._runs(iter(batches))] and [c for x in nj._runs(iter(batches)) for c in x[0].tolist()] == cols


def test_ngram_join_common_column(spark, rows):
    """Very many different texts of the same common lines, and some near copies among them."""
    rng = random.Random(17)
    lines = [prose(rng, 7) for _ in range(12)]
    texts = [" ".join(rng.sample(lines, 4)) for _ in range(160)]
    texts += [" ".join([*t.split()[:-1], f"e{i}"]) for i, t in enumerate(texts[:20])]
    want = sorted(brute_components(texts), key=repr)
    assert rows(jaccard_components(spark, frame(spark, texts), block=8)) == want
    many = [f"one common line of words w{i} x{i} y{i} z{i} v{i} u{i}" for i in range(20_000)] + ["one common line of words w7 x7 y7 z7 v7 u7 t7"]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark, frame(spark, many)).collect()}
    assert got == {i: i for i in range(20_000)} | {20_000: 7}
    with pytest.raises(TypeError):
        jaccard_components(spark, frame(spark, ["a"]).withColumn("doc_id", F.lit("x")))


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent}


# 3


def test_binary_fuse():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        filter_ = ed.BinaryFuse.from_bytes(ed.BinaryFuse.build(keys).to_bytes())
        assert filter_.contains(keys).all()
        assert filter_.contains(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.001
        assert n < 10_000 or len(filter_.table) < 1.3 * n


def test_exact_dedup(spark, texts):
    got = {r.doc_id: r for r in ed.exact_dedup(spark, frame(spark, texts)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        group = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (group[0], len(group), i == group[0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_edges(spark, rows):
    assert ed.exact_dedup(spark, frame(spark, ["x"]).limit(0)).count() == 0
    got = ed.exact_dedup(spark, frame(spark, ["a", "a", "a", "b", "c"], [4, 4, None, None, 9]))
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == sorted([(4, 4, 3, True), (4, 4, 3, True), (None, 4, 3, False), (None, None, 1, True), (9, 9, 1, True)], key=repr)


def test_screen_against_snapshot(spark, rows):
    group = lambda t: ed.group_batch(ed.digests(frame(spark, t)))
    snapshot = ed.build_snapshot(group(["a", "b", "b"]), 10)
    hits = ed.screen(group(["b", "c", "d"]), snapshot)
    assert rows(hits, "digest") == [(hashlib.sha256(b"b").hexdigest(),)]


# 4


def test_alignment():
    a = np.arange(10, dtype=np.uint64)
    assert aligned_span(a, np.r_[np.uint64(99), a, np.uint64(98)]) == (20, 1, 11)
    edited = np.r_[a[:4], np.uint64(77), a[5:]]
    assert aligned_span(a, edited) == (17, 0, 10)
    assert aligned_span(a, a[:0]) == (0, 0, 0)


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)] + [None, "", "too short"]
    clean = [prose(rng, 80) for _ in range(20)]
    edited = items[1].split()
    for k in range(2, 30, 6):
        edited[k] = "other"
    leaks = [clean[0] + " " + items[0] + " " + clean[1], clean[2] + "\n" + items[2].upper() + " x " * 3000, " ".join(edited)]
    docs = frame(spark, [*clean, *leaks, None, "", leaks[0]], [*range(20), 100, 101, 102, 103, 104, 100])
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    got = contaminated(spark, docs, bench, block_words=40).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(100, 0), (101, 2), (102, 1)] and len(got) == 4
    one = next(r for r in got if r.doc_id == 100)
    assert one.score == 1.0 and leaks[0][one.start : one.end] == one.span == items[0]
    assert contaminated(spark, docs, bench.limit(0)).count() == 0 and contaminated(spark, docs.limit(0), bench).count() == 0


def test_decontaminate_against_all_alignments(spark):
    """Edited leaks among ordinary text that shares words with the items: as aligning every document with every item."""
    rng = random.Random(41)
    items = [prose(rng, rng.randrange(12, 40)) for _ in range(25)]
    docs = [prose(rng, rng.randrange(20, 150)) for _ in range(60)]
    for k in range(80):
        words = rng.choice(items).split()
        for _ in range(rng.randrange(len(words) // 3 + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        docs.append(" ".join([prose(rng, rng.randrange(30)), *words, prose(rng, rng.randrange(30))]))
    docs += [docs[70]] * 30  # an item that is copied often is a seed still
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, int(r.item_id[1:])): r.score for r in contaminated(spark, frame(spark, docs), bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        for k, i in enumerate(items):
            score = aligned_span(de._hash_text(i), de._hash_text(t))[0] / (2 * len(i.split()))
            if score >= 0.5:
                want[d, k] = score
    assert len(want) > 90 and got == want


def test_decontaminate_edges(spark, rows):
    item = " ".join(f"q{i}" for i in range(20))
    docs = frame(spark, [item, item, "w " * 200_000 + item], [None, 1, 2])
    bench = spark.createDataFrame([(1.5, item), (1.5, item + " q20"), (None, item)], "item_id double, text string")
    got = rows(contaminated(spark, docs, bench), "doc_id", "item_id", "score")
    assert got == sorted([(d, i, 1.0) for d in (None, 1, 2) for i in (1.5, None)], key=repr)


# 5


def test_cuts_resist_insertions():
    rng = random.Random(5)
    a = prose(rng, 400)
    b = a[:300] + " inserted" + a[300:]
    units = lambda t: set(sd.units(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 20, 128, 40)[0].tolist())
    assert len(units(a) & units(b)) > 0.9 * len(units(a))


def test_substring_dedup(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    docs = [prose(rng, 100) + " " + passage + " " + prose(rng, 50) for _ in range(6)] + [prose(rng, 150) for _ in range(10)] + ["la " * 400, "ba " * 3 + "la " * 300, None, "", "é" * 3000, "same " + passage]
    got = sd.repeated_spans(spark, frame(spark, docs)).toPandas()
    assert {0, 1, 2, 3, 4, 5, 16, 17, 21} == set(got.doc_id)
    for r in got[got.doc_id < 6].itertuples():
        assert docs[r.doc_id][r.start : r.end] in passage and r.words >= 40 and r.first_doc_id == 0 and r.kept == (r.doc_id == 0)
    cut = {r.doc_id: r.text for r in sd.remove_spans(frame(spark, docs), sd.repeated_spans(spark, frame(spark, docs))).collect()}
    assert cut[0] == docs[0] and len(cut[1]) < len(docs[1]) - 200 and cut[7] == docs[7] and cut[18] is None
    assert sd.repeated_spans(spark, frame(spark, docs).limit(0)).count() == 0


# 6


def pages(spark, items):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in items], "page_id bigint, url string, html string, sha1 string, id bigint")


def test_warc(spark):
    items = [(5, "http://a/", "<p>x</p>"), (3, "http://b/\r\nX: y", "<p>x</p>"), (9, None, None), (4, "u", ""), (6, "u", "é" * 70_000), (8, "u", "<p>x</p>"), (7, "u", "a\r\n\r\nb")]
    index = wa.write_warc(spark, pages(spark, items))
    got = {r.page_id: r for r in wa.read_warc(index).collect()}
    first = {}
    for i, _, h in sorted(items, key=lambda x: x[0]):
        first.setdefault(h or "", i)
    for i, _, h in items:
        payload, own, r = (h or "").encode(), first[h or ""] == i, got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[h or ""]))
        assert r.payload == (payload if own else b"")
    assert len(wa.read_warc(index.where("page_id = 6")).collect()) == 1
    small = wa.read_warc(index, span=100, gap=0, most=1).collect()
    assert sorted(r.page_id for r in small) == sorted(got)
    assert wa.read_warc(wa.write_warc(spark, pages(spark, items).limit(0))).count() == 0


def test_warc_repeats(spark, rows):
    got = wa.read_warc(wa.write_warc(spark, pages(spark, [(1, "a", "x"), (1, "a", "x"), (None, "b", "x")])))
    assert rows(got, "page_id", "record_type", "refers_to") == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1)], key=repr)


def test_warc_text_ids(spark, rows):
    data = spark.createDataFrame([("b\r\nx", "u", "x"), ("a", "u", "x"), ("", "u", "y"), (None, "u", "z")], "page_id string, url string, html string")
    index = wa.write_warc(spark, data)
    got = wa.read_warc(index, span=10)
    assert rows(got, "page_id", "record_type", "refers_to") == sorted([("a", "response", None), ("b\r\nx", "revisit", "a"), ("", "response", None), (None, "response", None)], key=repr)
    with pytest.raises(TypeError):
        wa.write_warc(spark, data.select(F.lit(1.5).alias("page_id"), "url", "html"))


# 7


@given(st.lists(st.integers(0, 10**6), max_size=300), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_elias_fano(values, bits):
    values = np.sort(np.array(values, np.int64))
    top = int(values[-1]) if len(values) else 0
    coded = lm.Monotone.decode(np.frombuffer(lm.Monotone.encode(values, top), np.uint8))
    assert coded.at(np.arange(len(values))).tolist() == values.tolist()
    narrow = values & ((1 << bits) - 1)
    assert lm.unpack(lm.pack(narrow.astype(np.uint64), bits), bits, np.arange(len(narrow))).tolist() == narrow.tolist()


@pytest.mark.parametrize("order,shard_words,shard_tokens", [(2, 10**6, 10**6), (3, 7, 60), (4, 10**6, 700)])
def test_lm(spark, texts, order, shard_words, shard_tokens):
    docs = [t for t in texts if t is None or len(t) < 20_000]
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    got = {r.doc_id: r for r in lm.lm_scores(spark, frame(spark, docs), held, order=order, shard_words=shard_words, shard_tokens=shard_tokens).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "\n"] for t in docs]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(docs))]
    c = {k: collections.Counter(tuple(t[i : i + k]) for t, o in zip(tokens, out, strict=True) if not o for i in range(len(t) - k + 1)) for k in range(1, order + 1)}
    n, v = sum(c[1].values()), len(c[1])
    used = collections.Counter()
    for k in range(2, order + 1):
        for g, m in c[k].items():
            used[g[:-1]] += m - 0.75

    def p(w, h):
        if not h:
            return (c[1][w,] + 1) / (n + v + 1)
        if h not in c[len(h)] or h[-1] == "\n":
            return p(w, h[1:])
        total = c[len(h)][h]
        return max(c[len(h) + 1].get((*h, w), 0.75) - 0.75, 0) / total + (1 - used[h] / total) * p(w, h[1:])

    for i, t in enumerate(tokens):
        r = got[i]
        base = sum(math.log10((c[1][w,] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p(w, tuple(t[max(0, j - order + 1) : j]))) for j, w in enumerate(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[1][w,] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and abs(r.score - score) < 0.03 * len(t)


def test_lm_edges(spark):
    held = F.col("doc_id") >= 0
    nothing = lm.lm_scores(spark, frame(spark, ["a b", None]), held).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in nothing} == {(3, 0, 0), (1, 0, 0)} and all(r.score == 0 for r in nothing)
    assert lm.lm_scores(spark, frame(spark, ["a"]).limit(0), held).count() == 0


# 8


def test_quality(spark):
    rng = random.Random(8)
    good = [prose(rng, rng.randrange(40, 120)) for _ in range(120)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60).split()) if i % 2 else prose(rng, 1).split()[0].join([" "] * 90) for i in range(60)]
    docs = frame(spark, [*good, *bad, None, "", "x" * 200_000])
    labels = spark.createDataFrame([(i, 1 if i < 120 else 0, 7) for i in range(180) if i % 3] + [(None, 1, 1), (5, None, 1), (6, 9, 1)], "doc_id bigint, quality int, text int")
    got = {r.doc_id: r for r in quality_scores(spark, docs, labels).collect()}
    assert len(got) == 183 and all(0 <= r.score <= 1 for r in got.values())
    out = [i for i in range(180) if i % 3 == 0]
    assert sum(got[i].kept == (i < 120) for i in out) >= 0.95 * len(out)
    assert all(r.kept and r.score == 0.5 for r in quality_scores(spark, docs, labels.limit(0)).collect())
    assert quality_scores(spark, docs.limit(0), labels).count() == 0


# 9


RULES = [uf.Rule("block", "net/"), uf.Rule("allow", "example.net/en/"), uf.Rule("block", "example.com/de/"), uf.Rule("allow", "org/fr/")]
URLS = [None, "", "nohost", "http://A.Example.NET/en/1", "http://example.net/en", "http://example.net?x=/en/", "http://net/", "http://internet/", "https://b.org/fr/?q", "ftp://x.org/FR/", "http://m.example.com/de/1#a", "http://xexample.com/de/", "a://b://c/d", "http://é.net/\n?x", "http://x.net#/"]


@pytest.mark.parametrize("extra", [0, 194, 195, 300])
def test_url_rules(spark, extra):
    rules = [uf.Rule("allow", "net/"), uf.Rule("block", "org/fr/"), *RULES] + [uf.Rule("block", f"h{i}.invalid/") for i in range(extra)]
    data = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, path string")
    labelled = spark.createDataFrame([], "url string, blocked boolean")
    got = {r.page_id: r for r in uf.judge_urls(spark, data, rules, labelled).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r.text), r.text, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_url_trees():
    rng = random.Random(10)
    good = [f"http://{rng.choice(WORDS)}{rng.choice(WORDS)}.org/{rng.randrange(99)}" for _ in range(300)]
    bad = [f"http://{rng.choice(WORDS)}-{rng.randrange(10**6)}.biz/a/b?x={i}&y=1" for i in range(300)]
    model = uf.boost(good[:200] + bad[:200], np.array([False] * 200 + [True] * 200))
    assert (model.score(good[200:]) < 0.5).mean() > 0.95 and (model.score(bad[200:]) > 0.5).mean() > 0.95
    assert uf.boost(good, np.zeros(300, bool)) is None
    assert model.score([None, ""]).shape == (2,)


# 10


def test_kernel_folds_exactly():
    kernel = tx.Kernel([b"idiot", b"moron", b"hello"])
    strings = [b"idiot", b"id.iot", b"idi", b"world", b"hel", b"zz"]
    values = kernel(strings)
    assert values[0, 0] > values[1, 0] > values[3, 0] and values[5].max() == 0
    beta, w = np.array([1.0, -0.5, 0.25]), None
    w = kernel.fold(beta)
    raw = np.frombuffer(b" ".join(strings), np.uint8)
    offsets = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1].tolist() + [len(raw)]
    got = tx.document_features(raw, np.array(offsets), w, 0.0)[:, 0]
    assert np.allclose(got, np.clip(values @ beta, -2, 2), atol=1e-4)


def test_kernel_counts_subsequences():
    """The kernel against an enumeration of all gapped subsequences of three bytes."""

    def features(s):
        out = collections.Counter()
        for k in range(2, tx.REACH + 1):
            for j in range(1, k):
                for i in range(len(s) - k):
                    out[s[i], s[i + j], s[i + k]] += tx.DECAY ** (k - 2)
        return out

    norm = lambda s: math.sqrt(max(1.0, sum((len(s) - k) * tx.DECAY ** (2 * (k - 2)) for k in range(2, tx.REACH + 1) for _ in range(1, k) if len(s) > k)))
    rng = random.Random(13)
    words = [bytes(rng.choice(b"abcde") for _ in range(rng.randrange(3, 12))) for _ in range(30)]
    got = tx.Kernel(words)(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = features(a), features(b)
            assert abs(got[i, j] - sum(n * y[f] for f, n in x.items()) / norm(a) / norm(b)) < 1e-3


def test_toxicity_edges(spark):
    rng = random.Random(14)
    texts = [prose(rng, 40) + (" grubbish grubber" if i % 2 else "") for i in range(80)]
    data = frame(spark, texts).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    data = data.unionByName(data.limit(3)).unionByName(data.limit(1).withColumn("doc_id", F.lit(None).cast("string")))
    labels = spark.createDataFrame([(f"k{i}", i % 2) for i in range(80)], "doc_id string, toxic int")
    got = tx.toxicity(spark, data, labels).collect()
    assert len(got) == 84 and sum(r.doc_id is None and not r.held_out for r in got) == 1
    assert all(r.predicted == int(r.doc_id[1:]) % 2 for r in got if r.doc_id)


def test_toxicity(spark):
    rng = random.Random(11)
    stems = ["grub", "snark", "blorp"]
    doc = lambda toxic: " ".join([*prose(rng, 60).split(), *([rng.choice(stems) + rng.choice(["ish", "er", "y", "let"]) for _ in range(3)] if toxic else [])])
    flags = [i % 3 == 0 for i in range(300)]
    docs = [doc(f) for f in flags]
    labels = spark.createDataFrame([(i, int(f), 1) for i, f in enumerate(flags)] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, text int")
    data = frame(spark, [*docs, None, "", "sn.arkish " * 3 + docs[1], "w" * 100_000])
    got = {r.doc_id: r for r in tx.toxicity(spark, data, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == flags[i] for i in held) >= 0.95 * len(held)
    assert got[300].score < 0.5 and got[301].score < 0.5 and got[302].predicted == 1 and got[303].predicted == 0
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.score == 0 for r in tx.toxicity(spark, data, labels.limit(0)).collect())
    assert tx.toxicity(spark, data.limit(0), labels).count() == 0
