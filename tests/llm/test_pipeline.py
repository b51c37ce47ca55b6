"""The pipeline on planted documents, and the registered queries on the smallest tables."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tidemark.llm import queries as own
from tidemark.llm.packing import Encoder
from tests.llm.test_operators import SCHEMA, brute_components, prose

DIR = "/root/testdata/sf0.001"


def tables(spark, tmp_path, docs, labels, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    good = [prose(rng, 60) for _ in range(90)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60).split()) for _ in range(40)]
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    near = [" ".join([*good[k].split()[:-1], "other"]) for k in range(5)]
    same = [good[k].replace(" ", "  ") for k in range(10, 14)]
    leak = [good[20] + " " + item + " " + good[21], item]
    texts = [*good, *bad, *near, *same, *leak]
    labels = [(i, int(i < 90), 0) for i in range(130) if i % 4]
    sf = tables(spark, tmp_path, list(enumerate(texts)), labels, [(1, item), (2, None)])
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    # What is left, by hand: rejected documents go, of copies and near copies the first stays, leaks go.
    after_quality = {r.doc_id for r in cp.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert not after_quality & set(range(90, 130)) and set(range(90)) <= after_quality
    left = sorted(after_quality)
    seen, unique = set(), []
    for i in left:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", texts[i])
        if norm not in seen:
            seen.add(norm)
            unique.append(i)
    firsts = [unique[c] for k, _, c in brute_components([texts[i] for i in unique]) if k == c]
    want = [i for i in firsts if item not in texts[i]]
    got = cp.run(spark, sf).toPandas()
    assert sorted(got.doc_id.unique()) == want
    enc = Encoder(own.tokenizer_path())
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(enc.ids(texts[i])) + 1 for i in want}
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = [(None, "a b c d e f g"), (1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "word " * 20_000)]
    sf = tables(spark, tmp_path, docs, [], [])
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted((r.doc_id or 0) for r in now.collect()) == [0, 1, 3, 3, 4]
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == {None, 1, 3, 4}


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_registered_queries(spark, name):
    df = entry.queries()[name](spark, DIR)
    got = df.toPandas()
    source = "pages" if name.startswith(("op6", "op9")) else "documents"
    ids = duckdb.sql(f"SELECT {'page_id' if source == 'pages' else 'doc_id'} FROM '{DIR}/{source}.parquet'").df().iloc[:, 0]
    if name.startswith(("op4", "op5")):
        assert set(got.doc_id) <= set(ids)
    else:
        assert set(got.iloc[:, 0]) == set(ids)
    if name in own.SQL:
        db = duckdb.connect()
        db.execute(f"CREATE VIEW {source} AS SELECT * FROM '{DIR}/{source}.parquet'")
        want = db.sql(own.SQL[name]).df()
        key = sorted(got.columns)
        assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, want[key].values.tolist()))
