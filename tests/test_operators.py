import pytest
from pyspark.sql import functions as F

from strataframe.operators import aggregates, answers, catalogue, cleaning, compare, datasets, filters, paging, quality, reports, retrieval, schema, trends

ROWS = [
    (1, "BCCL", "Jharia OC", "2023-24", "Q1", "G6", 40.0, 45.0, 38.0, False, False),
    (2, "BCCL", "Moonidih UG", "2023-24", "Q2", "G8", 20.0, 25.0, 19.0, False, False),
    (3, "ECL", "Raniganj OC", "2023-24", "Q1", "G6", 35.0, 30.0, 34.0, False, False),
    (4, "BCCL", "Jharia OC", "2024-25", "Q1", "G6", 50.0, 48.0, 49.0, False, False),
    (5, "SECL", "Gevra OC", "2024-25", "Q1", "G10", 60.0, 55.0, 58.0, False, False),
    (6, "ECL", "Sonepur UG", "2024-25", "Q2", "G10", 5.0, 10.0, 4.5, False, True),
    (7, "SECL", "Corrupted Mine", "2024-25", "Q2", "G10", -10.0, -5.0, 0.0, True, False),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(r[0], *r) for r in ROWS], "record_id long, row_index int, subsidiary string, mine string, financial_year string, reporting_period string, grade string, production double, target double, dispatch double, is_error boolean, is_warning boolean").cache()


def values(df, key="grp", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_totals(records):
    r = filters.filter_records(records)
    for function, want in {"sum": 210.0, "avg": 35.0, "min": 5.0, "max": 60.0, "count": 6.0}.items():
        got = aggregates.total(r, function, "production").first()
        assert (got["value"], got["record_count"]) == (want, 6)
    assert aggregates.total(r.where("false"), "sum", "production").first()["value"] == 0.0
    with pytest.raises(ValueError):
        aggregates.measure("median", "production")


def test_grouped_and_breakdown(records):
    r = filters.filter_records(records)
    assert values(aggregates.grouped(r, "subsidiary", "sum", "production")) == {"BCCL": 110.0, "ECL": 40.0, "SECL": 60.0}
    assert values(aggregates.breakdown(records, "subsidiary", limit=2), value="share_pct") == {"BCCL": 64.7, "SECL": 35.3}


def test_filters(records):
    n = lambda **f: filters.filter_records(records, f).count()
    assert n(financial_year="FY 2023/24") == 3
    assert n(reporting_period="Q2") == 2
    assert n(subsidiary="ECL") == 2 and n(subsidiary="CL") == 0 and n(mine="oc") == 4
    assert n(subsidiary="all", nothing="x") == 6
    assert filters.filter_records(records, query="jharia oc 2024").count() == 1
    assert filters.by_quality(records, "valid_only").count() == 5
    with pytest.raises(ValueError):
        filters.checked_field("x", records.columns)


def test_indicators_and_growth(records):
    k = aggregates.indicators(records).first()
    assert (k["error_count"], k["warning_count"], k["mine_count"], k["total_production"]) == (1, 1, 5, 210.0)
    g = aggregates.latest_growth(records).first()
    assert (g["metric"], g["previous_fy"], g["current_fy"], g["previous"], g["current"]) == ("production", "2023-24", "2024-25", 95.0, 115.0)
    t = {r["period"]: (r["value"], r["growth_pct"]) for r in trends.trend(records).collect()}
    assert t == {"2023-24": (95.0, None), "2024-25": (115.0, 21.1)}
    s = trends.trend_summary(trends.trend(records)).first()
    assert s["has_sufficient_history"] and s["overall_growth_pct"] == 21.05


def test_pages(records):
    ids = lambda **k: [r["record_id"] for r in paging.page(records, **k).collect()]
    assert ids(size=3, number=2) == [4, 5, 6]
    assert ids(sort="production", kind="numeric", descending=True, size=2) == [5, 4]
    assert paging.page_count(records, 3).first()["pages"] == 3


def test_compare(records):
    past, now = records.where("financial_year = '2023-24'"), records.where("financial_year = '2024-25'")
    m = compare.compare_metrics(past, now, ["production"]).first()
    assert (m["past"], m["current"], m["difference"], m["pct"], m["status"]) == (95.0, 115.0, 20.0, 21.05, "improved")
    g = {r["subsidiary"]: r["status"] for r in compare.compare_groups(past, now, "subsidiary", "production").collect()}
    assert g == {"BCCL": "declined", "ECL": "declined", "SECL": "new"}


def test_reports(records):
    rows = records.withColumns({c: F.lit(None).cast("string") for c in ("coalfield", "state", "coal_type", "block", "project", "seam")})
    assert {r["subsidiary"]: r["production"] for r in reports.report("production", rows).collect()} == {"BCCL": 110.0, "ECL": 40.0, "SECL": 60.0}
    assert reports.report("production", rows, organization="NONE").first()["is_fallback"]
    for kind in reports.REPORTS:
        reports.report(kind, rows).collect()
    with pytest.raises(ValueError):
        reports.report("x", rows)


def test_validation(spark):
    t = spark.createDataFrame([("a", ["Production (MT)", "Latitude", "Longitude", "Latitude"], [["x1,250 MT", "23.5", "200", "1"], ["abc", "north", "86", "2"], ["abc", "north", "86", "2"], ["-4", "95", "1", "2", "9"]]), ("b", [], [])], "source_ref string, headers array<string>, rows array<array<string>>")
    got = {(r["issue_type"], r["severity"]): r["n"] for r in quality.validate(t).groupBy("issue_type", "severity").agg(F.count("*").alias("n")).collect()}
    assert got[("extraction_failure", "WARNING")] == 1 and got[("duplicate", "WARNING")] == 1 and got[("schema_mismatch", "WARNING")] == 1 and got[("duplicate_record", "WARNING")] == 1
    assert got[("invalid_numeric", "ERROR")] == 2 and got[("suspicious_value", "WARNING")] == 1 and got[("coordinate_error", "WARNING")] == 2 and got[("coordinate_error", "ERROR")] == 2
    assert got[("missing_required", "INFO")] == 4


def test_normalized_rows_and_fields(spark):
    t = spark.createDataFrame([("a", ["Mine", "Production (MT)", "Fin Year", "Output", "Note X"], [["  Jharia  OC ", "4.5 MT", "FY 2024-25", "7"], ["K", "x"]])], "source_ref string, headers array<string>, rows array<array<string>>")
    rows = {r["row_index"]: r["data"] for r in schema.normalized_rows(t).collect()}
    assert rows[0]["mine"] == "Jharia OC" and rows[0]["production"] == "7.0" and rows[0]["financial_year"] == "2024-25" and rows[0]["production_unit"] == "MT"
    f = {r["field"]: r["type"] for r in schema.fields(schema.normalized_rows(t)).collect()}
    assert f["production"] == "numeric" and f["mine"] == "categorical" and f["financial_year"] == "categorical"


def test_normalized_rows_keep_order_and_need_no_shuffle(spark):
    t = spark.createDataFrame([("a", ["Zone", "Mine", "Production (MT)", "Alpha", "Output", None], [["z", "K", "1 MT", "", "x"], ["z", " ", "2", "b", "", "n", "over"], []])], "source_ref string, headers array<string>, rows array<array<string>>")
    out = schema.normalized_rows(t)
    rows = {r["row_index"]: r["data"] for r in out.collect()}
    keys = {r["row_index"]: r["k"] for r in out.select("row_index", F.map_keys("data").alias("k")).collect()}
    assert [k for k in keys[0] if "_" not in k] == ["Zone", "mine", "production"] and rows[0]["production"] == "1.0" and rows[0]["Alpha_original"] == "" and "Alpha" not in rows[0]
    assert rows[1]["production"] == "2.0" and rows[1][""] == "n" and rows[1]["mine_original"] == "" and "mine" not in rows[1] and rows[2]["Zone_original"] == ""
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_metadata_evidence(spark):
    tables = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    kv = [(["Parameter", "Value"], [["Operator", "CCL"], ["FY", "2021-22"], [None, "x"], ["Place", None], ["operator ", "BCCL"]]), (["Field", "Value", "Unit"], [["Mine", "never", ""]])]
    docs = [(1, "Mine: Title", None, "Year 2019/20 and FY 2020-21\nMinistry: Coal", {"fy": " 2023-24 ", "district": "Korba"}, kv), (2, None, "mcl_report.pdf", "by MCL, FY2024-25", None, None), (3, "", "", "", {}, [(["company"], [])]), (4, None, None, None, None, None)]
    df = spark.createDataFrame(docs, f"document_id int, title string, filename string, raw_text string, given map<string,string>, tables {tables}")
    got = {(r.document_id, r.field): (r.value, r.origin) for r in schema.document_metadata(df).collect()}
    assert got == {
        (1, "financial_year"): ("2023-24", "given"), (1, "location"): ("Korba", "given"), (1, "organization"): ("BCCL", "table"), (1, "mine"): ("Title", "text"),
        (2, "organization"): ("MCL", "text"), (2, "financial_year"): ("2024-25", "text"), (3, "organization"): ("company", "header"),
    }
    ranks = [(r.source, r.place, r.value) for r in schema.metadata_evidence(df).where("document_id = 1 and field = 'financial_year'").orderBy("source", "place").collect()]
    assert [v for _, _, v in ranks] == ["2023-24", "2021-22", "2019/20", "2019/20"]


def test_union_in_order(spark):
    from strataframe.sources import writers

    a, b = spark.createDataFrame([(1, "x")], "a int, c string"), spark.createDataFrame([(2, 3.5, "y")], "b int, d double, a string").withColumn("a", F.lit(7))
    out = writers.union_in_order([a, b, a])
    assert out.columns == ["a", "c", "b", "d"] and sorted(map(str, out.collect())) == sorted(map(str, [(1, "x", None, None), (7, None, 2, 3.5), (1, "x", None, None)])) or out.count() == 3


def test_flags(spark):
    r = spark.createDataFrame([(1, True, []), (2, False, []), (3, True, [("WARNING",)]), (4, True, [])], "record_id long, is_valid boolean, validation_errors array<struct<severity string>>")
    f = spark.createDataFrame([(4, "ERROR", "open"), (1, "ERROR", "resolved"), (4, "WARNING", "open")], "record_id long, severity string, status string")
    got = {x["record_id"]: (x["is_error"], x["is_warning"]) for x in quality.flagged(r, f).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (True, True)}


@pytest.mark.parametrize("field, value, want", [
    ("a", " x  y ", {"whitespace": "x y"}), ("a", "1,250", {"comma_number": "1250"}), ("a", "85 %", {"percentage": "85%"}), ("a", "85 percent", {"percentage": "85%"}), ("a", "FY2024-25", {"financial_year": "2024-25"}),
    ("a", "15/01/2024", {"date_format": "2024-01-15", "financial_year": "2015-01"}), ("a", "5 mt", {"unit_normalization": "5 MT"}), ("mine_name", "JHARIA OC", {"capitalization": "Jharia Oc"}), ("a", "+12", {"numeric_format": "12"}), ("a", ".5", {"numeric_format": "0.5"}), ("a", "fine", {})])
def test_suggestions(spark, field, value, want):
    df = spark.createDataFrame([(1, field, value)], "record_id long, field string, value string")
    assert {r["issue_type"]: r["suggested_value"] for r in cleaning.suggestions(df).collect()} == want


def test_apply_and_decide(spark):
    cells = spark.createDataFrame([(1, "p", "1,250"), (2, "p", "x")], "record_id long, field string, value string")
    s = spark.createDataFrame([(1, 1, "p", "1,250", "1250", "approved"), (2, 1, "p", "1,250", "1251", "approved"), (3, 2, "p", "y", "z", "approved"), (4, 2, "p", "x", "w", "pending")], "suggestion_id long, record_id long, field_name string, original_value string, suggested_value string, status string")
    after, marked = cleaning.apply_approved(cells, s)
    assert {r["record_id"]: (r["value"], r["before_apply"]) for r in after.collect()} == {1: ("1250", "1,250"), 2: ("x", None)}
    assert {r["suggestion_id"]: r["status"] for r in marked.collect()} == {1: "applied", 2: "failed", 3: "failed", 4: "pending"}
    d = spark.createDataFrame([(4, "approve"), (1, "reject")], "suggestion_id long, decision string")
    assert {r["suggestion_id"]: r["status"] for r in cleaning.decided(s, d).collect()} == {1: "rejected", 2: "approved", 3: "approved", 4: "approved"}


@pytest.mark.parametrize("question, route, subsidiary, metric", [
    ("What was total production of MCL in 2024-25?", "STRUCTURED", "MCL", "production"), ("Explain the exploration services", "DOCUMENT", None, None), ("According to the report, production of SECL?", "HYBRID", "SECL", "production"),
    ("mine name and location", "DOCUMENT", None, None), ("mine name and dispatch", "HYBRID", None, "dispatch"), ("production target and dispatch", "STRUCTURED", None, "production_target"), (None, "DOCUMENT", None, None)])
def test_routes(spark, question, route, subsidiary, metric):
    r = retrieval.routed(spark.createDataFrame([(question,)], "text string")).first()
    assert (r["route"], r["subsidiary"], r["metric"]) == (route, subsidiary, metric)


def test_retrieval(spark):
    c = spark.createDataFrame([(1, "MCL produced 204.5 MT of coal", "Production"), (2, "Geology of the block", ""), (3, "MCL dispatch of coal", None)], "doc_id int, content string, section_heading string")
    got = retrieval.bm25(c, "MCL production coal", top=999).collect()
    assert [r["doc_id"] for r in got] == [1, 3] and got[0]["score"] > got[1]["score"]
    assert retrieval.bm25(c, "the", top=5).count() == 0


def plain_chunks(text, most=600, overlap=80, least=40):
    """The chunks of a text, sentence by sentence: (content, heading)."""
    import re

    out, held, heading = [], [], ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        if len(paragraph) < 80 and "\n" not in paragraph and not paragraph.endswith((".", ":", ";")):
            heading = paragraph
        for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", paragraph))):
            if held and sum(map(len, held)) + len(sentence) > most:
                out.append((" ".join(held), heading))
                tail = [k for k in range(len(held) + 1) if sum(map(len, held[k:])) <= overlap]
                held = held[tail[0]:]
            held.append(sentence)
    long = [c for c in out if len(c[0]) >= least]
    last = " ".join(held)
    return long + ([(last, heading)] if last and (len(last) >= least or not long) else [])


def test_chunks_hold_headings_and_short_documents(spark):
    import random

    r = random.Random(2)
    texts = ["Short title", "short", "Heading\n\n" + "A sentence of some length here. " * 60, None, "", " \n\n ", "Only\n\nHeadings\n\nHere", "x" * 2000, "One. " + "y" * 700 + ". Two."]
    for _ in range(60):
        texts.append("".join(r.choice(["Title %d\n\n" % r.randrange(9), "Word " * r.randint(1, 40) + ". ", "Why so! ", "a" * r.randint(1, 700) + "? ", "\n \n", "two\nlines\n\n", "no end: \n\n"]) for _ in range(r.randint(1, 30))))
    got = retrieval.chunk_texts(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")).collect()
    for i, text in enumerate(texts):
        mine = sorted((c for c in got if c.document_id == i), key=lambda c: c.chunk_index)
        assert [(c.content, c.section_heading) for c in mine] == plain_chunks(text), i
        assert [c.chunk_index for c in mine] == list(range(len(mine))) and all(c.token_count == max(1, len(c.content.split())) for c in mine)
        assert bool(mine) == bool((text or "").strip())


def test_table_chunks(spark):
    schema = "document_id int, source_ref string, sheet_name string, section_heading string, headers array<string>, rows array<array<string>>"
    t = [(1, "a", None, "Output", ["Subsidiary ", None, "FY 2024-25 (MT)"], [[f"S{i}", str(i), "", " x "] for i in range(7)]), (1, "b", "One", None, [], [["1"]]), (1, "c", "One", None, ["H"], []), (1, "d", "S", "", ["Column of some length", "N"], [["", None], ["v", "1"]]), (1, "e", None, None, ["H"], [["1"]])]
    cut = retrieval.chunk_tables(spark.createDataFrame(t, schema)).orderBy("source_ref", "chunk_index").collect()
    assert [(c.source_ref, c.chunk_index, c.row_start, c.row_end) for c in cut] == [("a", 0, 0, 4), ("a", 1, 5, 6), ("d", 0, 0, 1)]
    assert cut[1].content == "Table a [Section: Output]: Columns: Subsidiary, FY 2024-25 (MT)\nRow 5: Subsidiary: S5 | FY 2024-25 (MT): 5 | Col3: x\nRow 6: Subsidiary: S6 | FY 2024-25 (MT): 6 | Col3: x"
    assert cut[2].content == "Table d (Sheet: S): Columns: Column of some length, N\nRow 1: Column of some length: v | N: 1" and cut[1].section_heading == "Output"


def test_catalogue(spark):
    m = spark.createDataFrame([("A", "Jharkhand", "BCCL", 1.2), ("B", "Odisha", "MCL", 1.0), ("C", "Odisha", "MCL", 0.718)], "mine_name string, state string, subsidiary string, production double").withColumn("coalfield", F.col("state"))
    assert catalogue.matching(m, {"subsidiary": "mcl"}, search="odi", search_in=["state"]).count() == 2
    s = catalogue.place_stats(m).first()
    assert (s["mines"], s["total_production"], s["states"]) == (3, 2.92, 2)
    e = spark.createDataFrame([("2024-01-01", "x"), ("2024-01-02", "y")], "timestamp string, event_type string").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert catalogue.audit(e, since="2024-01-02").count() == 1 and catalogue.audit(e, since="nonsense").count() == 2


def test_key_value_datasets(spark):
    """Two datasets of summary rows, the earlier one a reference."""
    rows = [(1, 1, "Total Production", "1,000.00", "2023-24"), (2, 1, "Total Target", "1,100.00", None), (3, 1, "Total Dispatch", "920.00", None), (4, 2, "Total Production", "1,200.00", "FY 2024-25"), (5, 2, "Total Target", "1,250.00", None), (6, 2, "Total Dispatch", "1,100.00", None)]
    kv = spark.createDataFrame([(i, i, d, "CIL", a, v, y) for i, d, a, v, y in rows], "record_id long, row_index int, dataset_id int, subsidiary string, label string, value string, financial_year string")
    assert [(r["period"], r["value"], r["growth_pct"]) for r in datasets.trend_from_datasets(kv).orderBy("period").collect()] == [("2023-24", 1000.0, None), ("2024-25", 1200.0, 20.0)]
    a = datasets.report_aggregates(kv).first()
    assert (a["production"], a["target"], a["dispatch"]) == (2200.0, 2350.0, 2020.0)
    assert {(r["metric"], r["value"]) for r in datasets.source_profile(kv).collect()} == {("production", 1200.0), ("target", 1250.0), ("dispatch", 1100.0)}
    f = spark.createDataFrame([(1, "Production (MT)"), (1, "Fin Year"), (2, "Note")], "dataset_id int, field string")
    assert {r["dataset_id"]: (r["has_production"], r["has_financial_year"]) for r in datasets.listing(f).collect()} == {1: (True, True), 2: (False, False)}
    p = spark.range(10).select(datasets.estimated_page(F.col("id"), F.lit(10), F.lit(3)).alias("p"))
    assert [r["p"] for r in p.collect()] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_answers_by_the_order_of_selection(spark):
    """A named mine first, then a subsidiary's first record, then a whole document's, then the aggregate of all."""
    rows = [(1, 1, "MCL", "Talcher", "2024-25", 204.5), (2, 2, "MCL", "Lajkura", "2024-25", 300.0), (3, 3, "ECL", "Raniganj", "2023-24", 50.0), (4, 4, None, None, "2023-24", 999.0)]
    schema_ = "record_id long, row_index int, subsidiary string, mine string, financial_year string, production double"
    r = spark.createDataFrame(rows, schema_).withColumns({"target": F.lit(None).cast("double"), "dispatch": F.lit(None).cast("double"), "is_reference": F.col("record_id") == 3})
    q = spark.createDataFrame(
        [(1, "lajkura", "MCL", None, "production", "max"), (2, None, "mcl", "2024-25", "production", "sum"), (3, None, None, None, "production", "max"), (4, None, None, "2024-25", "production", "max"), (5, None, None, "2024-25", "production", None), (6, None, "NCL", None, "production", None), (7, None, None, "2024-25", "production", "avg")],
        "question_id int, mine string, subsidiary string, year string, metric string, aggregation string")
    got = {x.question_id: (x.value, x.name, x.calculation) for x in answers.answered(q, r).collect()}
    assert got == {1: (300.0, "Lajkura", "lookup"), 2: (204.5, "Talcher", "lookup"), 3: (999.0, None, "document"), 4: (300.0, "Lajkura", "max"), 5: (504.5, None, "sum"), 6: (None, None, "lookup"), 7: (252.25, None, "avg")}
    assert {x.question_id: x.value for x in answers.reference_answers(q, r).collect()}[3] == 50.0


def test_fields_prefer_their_source(spark):
    t, x = (spark.createDataFrame(rows, "doc_id int, field string, value string") for rows in ([(1, "production", "204.5"), (1, "location", "Odisha")], [(1, "location", "Talcher"), (1, "year", "2024-25"), (1, "production", "200")]))
    got = {r.field: (r.value, r.origin) for r in answers.resolved_fields(t, x, ["location"]).collect()}
    assert got == {"production": ("204.5", "table"), "location": ("Talcher", "text"), "year": ("2024-25", "text")}


def test_citations(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a")], "question_id int, rank int, source_ref string")
    assert sorted((r.question_id, r.rank, r.source_ref, r.n_sources) for r in answers.citations(c).collect()) == [(1, 1, "a", 2), (1, 2, "b", 2), (2, 1, "a", 1)]


def test_sums_keep_small_and_large_values(spark):
    r = spark.createDataFrame([(0.00002,)] * 1000 + [(3e14,)], "production double")
    assert aggregates.total(r, "sum", "production").first()["value"] == 300000000000000.0 + 0.02
    tie = spark.createDataFrame([(1.005,), (1.0,)], "production double")
    assert aggregates.total(tie, "sum", "production").first()["value"] == 2.01


def test_topic_percents(spark):
    """Percents round to the nearest, topics without keywords are left out, keywords go by frequency and then by the list."""
    t = spark.createDataFrame([("exploration borehole drilling coking ash ash railway",)], "text string")
    got = {r.topic: (r.matched, r.pct, r.keywords) for r in retrieval.topic_distribution(t).collect()}
    # 3 of 16 keywords, 2 of 14 and 1 of 13
    assert got["Coal Quality & Grades"] == (2, round(100 * (2 / 14) / (3 / 16 + 2 / 14 + 1 / 13)), "ash,coking") and got["Geological Exploration"][2] == "exploration,borehole,drilling" and len(got) == 3


def test_plain_years_are_the_columns(spark, one):
    for text in ["FY 2024-25", "1999/00", "98-99", "2024-2025", "99/01", "none", "2024-9", "123-45"]:
        r = spark.createDataFrame([(text,)], "c string").select(filters.scalars.financial_year(F.col("c")).alias("y")).first()["y"]
        assert (tuple(r) if r else None) == filters.scalars.financial_year_of(text)
        if r:
            assert spark.createDataFrame([(text,)], "c string").where(filters.same_year(F.col("c"), text)).count() == 1


def test_unknown_functions_and_fields_raise(records):
    for call in (lambda: aggregates.measure("median", "production"), lambda: filters.checked_field("salary", records.columns), lambda: aggregates.total(records, "", "production")):
        with pytest.raises(ValueError):
            call()
    assert filters.checked_field("production", records.columns) == "production"
    assert filters.filter_records(records, {"salary": "9", "subsidiary": "ALL".title(), "mine": None}).count() == filters.filter_records(records).count()


def test_chunks_keep_the_letter_v(spark):
    """White space alone is stripped around sentences: a ``v`` at either end stays."""
    got = retrieval.chunk_texts(spark.createDataFrame([(1, "vequance le v. ve quir rev\n\n\x0bvav\x0b")], "document_id int, text string")).collect()
    assert [(c.content, c.section_heading) for c in got] == [("vequance le v. ve quir rev vav", "vav")]


def test_topics_of_texts_need_no_shuffle(spark):
    words = ["coal", "mine", "coal", "seam", "mine", "ash", "", "coal"]
    rows = [(1, " ".join(words)), (2, None), (3, "the of"), (4, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(5000)))]
    out = retrieval.dominant_topics(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.topic, r.keywords) for r in out.collect()}
    assert got[1][1] == "coal,mine,seam,ash" and got[2] == ("—", "") and got[3] == ("—", "") and got[4][1] == "wordaa,wordba,wordca,wordda,wordea,wordfa"


def test_cells_are_looked_at_once_and_rows_compared_in_their_table(spark):
    t = spark.createDataFrame([("a", ["Mine", "Production (MT)"], [["x", "1,250 MT"], ["y", None], ["x", "1,250 MT"], ["y", None], ["y", ""], ["x", "1,250 MT"]]), ("b", ["Mine"], [["x"]])], "source_ref string, headers array<string>, rows array<array<string>>")
    found = quality.validate(t)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source_ref, r.row_index) for r in found.where("issue_type = 'duplicate_record'").collect()) == [("a", 2), ("a", 3), ("a", 5)]
    data = schema.normalized_rows(t)
    assert data._jdf.queryExecution().optimizedPlan().toString().count("[-+]?[\\d,.]+") == 1
    assert data.first()["data"] == {"mine": "x", "mine_original": "x", "production": "1250.0", "production_original": "1,250 MT", "production_unit": "MT", "production_normalized_unit": "MT"}
