import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strataframe.functions import vocab
from strataframe.operators import index
from strataframe.sources import ledger

TABLES = "array<struct<source_ref:string,sheet_name:string,section_heading:string,headers:array<string>,rows:array<array<string>>>>"
DOCUMENTS = f"document_id long, status string, extraction_status string, raw_text string, tables {TABLES}"
CHUNKS = "chunk_id long, scopes array<string>, content string, section_heading string"


def tokens(text):
    return [w for w in (x.strip(".") for x in re.findall(r"[a-zA-Z0-9_\-.]+", (text or "").lower())) if len(w) > 1 and w not in vocab.RANK_STOP]


def plain_search(chunks, scope, text, top, least=0.1):
    """BM25 of one question by dictionaries over the chunks of its scope."""
    mine, asked = [c for c in chunks if scope in c[1]], tokens(text)
    if not mine or not asked:
        return []
    bags = [tokens(c[2]) + tokens(c[3]) for c in mine]
    avgdl, out = max(1.0, sum(map(len, bags)) / len(bags)), []
    for c, bag in zip(mine, bags):
        score = 0.0
        for t in asked:
            if t in bag:
                df, tf = sum(t in b for b in bags), bag.count(t)
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / avgdl))
        if score > 0:
            score += 0.5 * (" ".join(asked) in (c[2] or "").lower()) + 0.3 * any(t in (c[3] or "").lower() for t in asked)
            out.append((-round(score, 3), c[0]))
    return [(i, -s) for s, i in sorted(out)[:top] if -s >= least]


@pytest.fixture(scope="module")
def corpus():
    r, words = random.Random(4), "coal seam mine output target rail drill core shaft dump haul road wagon siding crusher grade ash moisture band roof".split()
    rows = []
    for i in range(400):
        n = r.choice([0, 3, 10, 40])
        rows.append((i * 7, ["all", f"o:{i % 3}", f"d:{i // 10}"], " ".join(r.choices(words, weights=range(1, 21), k=n)) or None, r.choice([None, "", "Coal output", "The shaft"])))
    return rows


def test_batches_of_questions_as_one_by_one(spark, corpus, tmp_path):
    index.build(spark.createDataFrame(corpus, CHUNKS), spark, str(tmp_path / "i"), block=16)
    r, asked = random.Random(5), []
    for k in range(60):
        words = r.choices("coal seam mine output target rail roof ash unknown the coalfield core".split(), k=r.randint(0, 5))
        asked.append((k, r.choice(["all", "all", "o:1", "d:3", "o:9"]), " ".join(words) if words else r.choice([None, "", "the of"])))
    for top in (1, 5, 99):
        rows = index.search(spark, str(tmp_path / "i"), spark.createDataFrame(asked, "question_id long, scope string, text string"), top=top).collect()
        for k, scope, text in asked:
            got = [(x.chunk_id, x.score) for x in sorted((x for x in rows if x.question_id == k), key=lambda x: x["rank"])]
            want = plain_search(corpus, scope, text, min(top, 20))
            assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=0.0011) and len({i for i, _ in got} ^ {i for i, _ in want}) <= 2, (k, text)


def test_bounds_leave_blocks_out_and_texts_are_looked_up(spark, tmp_path):
    """One short chunk with a rare term: the other blocks' bounds are lower, and only a term's postings and some folders of texts are read."""
    rows = [(i, ["all"], "common " * 30 + f"w{i}", None) for i in range(2000)] + [(5000, ["all"], "rare common", None)]
    path = str(tmp_path / "i")
    index.build(spark.createDataFrame(rows, CHUNKS), spark, path, block=64)
    q = spark.createDataFrame([(1, "all", "rare common")], "question_id long, scope string, text string")
    out = index.search(spark, path, q, top=1)
    assert [(r.chunk_id, r["rank"]) for r in out.collect()] == [(5000, 1)]
    assert "DynamicFileSourceFilter" in (plan := out._jdf.queryExecution().toString()) or "dynamicpruning" in plan
    assert not spark.read.parquet(f"{path}/postings").columns.count("content") and len({f for f in spark.read.parquet(f"{path}/texts").inputFiles()}) > 1


def test_a_row_a_term_and_block(spark, corpus, tmp_path):
    """Words are listed where their block's texts are: no row a word is stored, and the lists hold every chunk once."""
    index.build(spark.createDataFrame(corpus, CHUNKS), spark, str(tmp_path / "i"), block=16)
    rows = spark.read.parquet(str(tmp_path / "i" / "postings")).collect()
    assert len(rows) == len({(r.scope, r.term, r.block) for r in rows}) and all(r.n == len(r.entries) and r.most == max(e.tf for e in r.entries) and r.least == min(e.dl for e in r.entries) for r in rows)
    want = {(s, t, c[0], bag.count(t), len(bag)) for c in corpus for bag in [tokens(c[2]) + tokens(c[3])] for t in bag for s in c[1]}
    assert {(r.scope, r.term, e.chunk_id, e.tf, e.dl) for r in rows for e in r.entries} == want and sum(r.n for r in rows) == len(want)


def test_narrative_context(spark, tmp_path):
    chunks = spark.createDataFrame([(i, ["all"], t, None) for i, t in enumerate(["coal output rose", "coal output of the mine fell and fell again", "rail", "coal"])], CHUNKS).withColumn("source_ref", F.concat(F.lit("c"), "chunk_id"))
    index.build(chunks, spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "all", "coal output"), (2, "all", "nothing here")], "question_id long, scope string, text string")
    rows = index.narrative_context(spark, str(tmp_path / "i"), q, chunks).collect()
    assert [(r.question_id, r.sources[0]) for r in rows] == [(1, "c0")] and rows[0].context.startswith("coal output rose\n\n")


def test_index_by_fingerprint(spark, tmp_path):
    table = [("t1", "S", "Output", ["Subsidiary", "Production in MT"], [["MCL", "204.5"], ["SECL", "180.2"]])]
    docs = [(1, "indexed", "completed", "A text of one sentence that is long enough to be a chunk.", table), (2, "processed", "ocr_unavailable", "short", []), (3, "failed", "completed", "never", []), (4, "indexed", "running", "never", []), (5, "completed", "completed", None, None)]
    path, frame = str(tmp_path / "x"), lambda rows: spark.createDataFrame(rows, DOCUMENTS)
    assert index.current_chunks(spark, path).count() == 0
    assert index.index_documents(spark, frame(docs), path, "run-1") == 3
    chunks = index.current_chunks(spark, path).orderBy("document_id", "chunk_index").collect()
    assert [(c.document_id, c.chunk_index, c.source_ref) for c in chunks] == [(1, 0, None), (1, 1, "t1"), (2, 0, None)] and "Row 1: Subsidiary: SECL" in chunks[1].content
    # nothing new: nothing written
    assert index.index_documents(spark, frame(docs), path, "run-2") == 0 and ledger.commits(spark, path).select("batch").distinct().count() == 1
    docs[1] = (2, "processed", "completed", "another text", [])
    assert index.index_documents(spark, frame(docs), path, "run-3") == 1
    after = {c.document_id: c for c in index.current_chunks(spark, path).where("document_id = 2").collect()}
    assert after[2].content == "another text" and index.current_chunks(spark, path).count() == 3
    assert {r.document_id: r.batch for r in index.current_documents(spark, path).collect()} == {1: "run-1", 2: "run-3", 5: "run-1"}
    assert index.index_documents(spark, frame(docs), path, "run-4", force=True) == 3 and index.current_chunks(spark, path).count() == 3


def test_a_run_that_died_is_not_seen(spark, tmp_path):
    path, schema = str(tmp_path / "l"), "a long, b string"
    rows = spark.createDataFrame([(1, "x"), (2, None), (2, None)], schema)
    rows.write.parquet(f"{path}/r/batch=one")  # files without a marker
    assert ledger.committed(spark, path, "r", schema).count() == 0
    assert ledger.append_once(spark, path, "one", {"r": rows.where("a = 1")})
    assert [(r.a, r.batch) for r in ledger.committed(spark, path, "r", schema).collect()] == [(1, "one")]


def test_append_once(spark, tmp_path):
    path, schema = str(tmp_path / "l"), "a long, b string"
    rows = spark.createDataFrame([(1, "x"), (2, None), (2, None)], schema)
    assert ledger.append_once(spark, path, "one", {"r": rows}) and not ledger.append_once(spark, path, "one", {"r": rows.orderBy("b").repartition(3)})
    for other in (rows.where("a = 1"), rows.withColumn("b", F.lit("x")), rows.distinct(), rows.union(rows)):
        with pytest.raises(ledger.Rewritten):
            ledger.append_once(spark, path, "one", {"r": other})
    with pytest.raises(ledger.Rewritten):
        ledger.append_once(spark, path, "one", {"s": rows})
    assert ledger.append_once(spark, path, "two", {"r": rows, "s": rows.where("false")})
    assert ledger.committed(spark, path, "r", schema).groupBy("batch").count().orderBy("batch").collect() == [("one", 3), ("two", 3)]
    assert ledger.committed(spark, path, "s", schema).count() == 0
    for bad in ("", "a/b", "../x", "a=b"):
        with pytest.raises(ValueError):
            ledger.append_once(spark, path, bad, {"r": rows})
