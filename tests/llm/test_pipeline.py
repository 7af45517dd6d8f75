from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm import mixing, simhash
from tests.llm.conftest import DOCS, prose
from tests.llm.test_spans import slow


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = prose(900, 60)
    rows = [(i, prose(i, 60 + i) + (" " + passage if i % 5 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [(300 + i, " ".join(w.upper() + "!!" for w in prose(i, 8).split()) * 8, "en", "s0", 1) for i in range(20)]
    rows += [(400, None, None, None, None), (401, "", "en", "s2", 0), (None, prose(1, 61), "en", "s1", 1), (None, prose(600, 70), "en", None, 1), rows[3]]
    labels = [(i, 1, 0) for i in range(80)] + [(300 + i, 0, 0) for i in range(20)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, corpus).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(80)) <= ids and not ids & set(range(300, 320))
    single = stages["SimHash near-dedup"](spark, kept, corpus).cache()
    count = Counter(r.doc_id for r in single.collect())
    assert set(range(80)) <= set(count) and not set(count) & set(range(200, 210)) and all(n == 1 for i, n in count.items() if i is not None)
    prints = [simhash.fingerprint(r.text) for r in single.collect()]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
    cut = stages["substring dedup"](spark, single, corpus).cache()
    want = slow([(r.doc_id, r.text) for r in single.collect()])
    assert sorted(map(str, (r.text for r in cut.collect()))) == sorted(str(kept) for _, _, kept in want)
    mixed = stages["mixing sources"](spark, cut, corpus).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(cut.where("doc_id is not null"), spark).collect()}
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None).values()) <= 2
    assert len(copies) == cut.where("doc_id is not null").count()
    out = stages["BPE encoding and decoding"](spark, mixed, corpus)
    assert out.count() == mixed.count()


def test_two_texts_under_one_id(spark, corpus, make):
    """Rows of one id with unrelated texts all stay in the near-dedup stage, a copy of one of them goes, and mixing treats them as documents of their own."""
    rows = [(1, prose(50, 60), "en", "s", 1), (1, prose(51, 60), "en", "s", 1), (2, prose(51, 60), "en", "s", 1), (2, prose(52, 60), "en", "s", 1), (1, prose(50, 60), "en", "s", 1)]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["SimHash near-dedup"](spark, make(rows), corpus)
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted([(1, prose(50, 60)), (1, prose(51, 60)), (2, prose(52, 60))])
    mixed = stages["mixing sources"](spark, make(rows[:2] + rows[3:4]), corpus)
    assert {r.text for r in mixed.collect()} <= {prose(k, 60) for k in (50, 51, 52)} and mixed.count() >= 3


def test_stages_leave_columns_alone(spark, corpus, make):
    """Columns named as working columns are, and with odd names, go through every stage but the last."""
    own = {c: F.lit(c) for c in ("row_id_", "text_hash_", "rest_", "group_", "copies_", "copy_", "row_key_", "q_", "k_", "t_", "places_", "component_id", "n_removed", "two words")}
    docs = make([(i, prose(i, 60), "en", "s", 1) for i in range(4)] + [(9, prose(2, 60), "en", "s", 1)]).withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        rows = docs.collect()
        assert rows and all(r[c] == c for r in rows for c in own if c in docs.columns), name
        assert set(docs.columns) >= set(own) - {"n_removed"}


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert rows and all(r.n_tokens == len(r.ids) and len(r.ids_sha256) == 64 for r in rows)
    assert not {r.doc_id for r in rows} & set(range(300, 320))


def test_empty(spark, corpus, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0
