import random
import re

import pytest
from pyspark.sql import functions as F

from strataframe.operators import resolve

QUESTIONS = "question_id long, scope string, text string, subsidiary string, year string, metric string, aggregation string"


def number(text):
    words = (text or "").split()
    try:
        return float(re.sub(r"[^\d.\-]", "", words[0])) if words else None
    except ValueError:
        return None


def plain(q, records):
    """One question over the records of its scope, row by row."""
    _, scope, text, sub, year, metric, how = q
    low, documents, rows = (text or "").lower(), [], []
    for s, rid, index, data in sorted(records, key=lambda r: (r[2], r[1])):
        if s != scope or metric is None:
            continue
        if year and year.lower().replace("fy", "").replace(" ", "").replace("–", "-") not in " ".join(v or "" for v in data.values()).lower().replace("–", "-"):
            continue
        mine = next((data[k].strip() for k in resolve.MINE if data.get(k)), None)
        label = next((data[k].strip() for k in resolve.LABELS if data.get(k)), None)
        if label is not None:
            has, hasnt, shown = resolve.LABELLED[metric]
            if re.search(has, label.lower()) and not (hasnt and re.search(hasnt, label.lower())):
                v = re.sub(r"^[n=\s]+", "", next((data[k] for k in resolve.VALUES if data.get(k)), "").strip()).strip()
                documents.append((rid, shown or label, v, number(v), next((u for w, u in resolve.SAID if w in v.lower()), "MT"), None, mine))
            continue
        names, shown = resolve.COLUMNS.get(metric, ((metric,), metric.replace("_", " ").capitalize()))
        col = next((n for n in names if n in data), None)
        if col:
            v = (data.get(col + "_original") or data.get(col) or "").strip()
            unit = "Tonnes" if "tonne" in v.lower() else data.get(col + "_unit") or "MT"
            of = next((x.strip() for k, x in data.items() if k.lower() in resolve.SUBSIDIARY and x), None)
            rows.append((rid, shown, v, number(data[col]), unit, of, mine))
    names = lambda m: [n for n in {(m or "").lower().strip(), re.sub(r"\(.*?\)", "", (m or "").lower()).strip()} if len(n) >= 3 and n in low]
    one = lambda r, calc: (True, calc, r[1], r[5], r[6], r[3], r[2], r[4], r[0])
    nothing = (False,) + (None,) * 8
    if hit := [r for r in rows if names(r[6])]:
        return one(hit[0], "lookup")
    if sub:
        hit = [r for r in rows if (r[5] or "").upper() == sub.upper()]
        return one(hit[0], how or "lookup") if hit else nothing
    if documents:
        return one(documents[0], how or "lookup")
    counted = [r for r in rows if r[3] is not None]
    if not counted:
        return nothing
    if how in ("max", "min", "avg") and "total" not in low:
        if how == "avg":
            v = sum(r[3] for r in counted) / len(counted)
            return (True, "avg", f"Average {metric}", None, counted[0][6], v, f"{v:,.2f} {counted[0][4]}", counted[0][4], counted[0][0])
        return one((max if how == "max" else min)(counted, key=lambda r: r[3]), how)
    v, first = sum(r[3] for r in counted), rows[0]
    return (True, "sum", f"Total {metric}", None, first[6], v, (f"{v:,.0f} " if v.is_integer() else f"{v:,.2f} ") + first[4], first[4], first[0])


def test_questions_against_a_loop(spark):
    r, records, questions = random.Random(9), [], []
    cell = lambda: r.choice(["10", "1,250.5 tonnes", "n/a", "n = 45 %", "-3", "12 Crore", "", None, "7.25 kt", "G10"])
    for i in range(260):
        scope = r.choice("abc")
        data = {r.choice(["note", "Reporting", "period"]): r.choice(["FY 2023–24", "2024-25", "in 2023", "", "year 12024-256", "2023-2024"])}
        if scope == "a" and r.random() < 0.4:
            data |= {r.choice(resolve.LABELS): r.choice(["Total Production", "Production target", "Coal dispatch", "Offtake", "Net Worth", "PAT (Rs)", "Remarks", ""]), r.choice(resolve.VALUES): cell()}
        else:
            data |= {r.choice(["subsidiary", "Company", "other"]): r.choice(["MCL", " ecl ", "", None]), r.choice(resolve.MINE): r.choice(["Aadocm (UG)", "Gevra", "Ib", "", None])}
            for m in ("production", "target", "dispatch", "offtake", "production_target", "net_worth"):
                if r.random() < 0.5:
                    data[m] = cell()
                    if r.random() < 0.3:
                        data[m + "_unit"] = r.choice(["kt", ""])
                    if r.random() < 0.2:
                        data[m + "_original"] = cell()
        records.append((scope, i * 3 % 1000, r.randint(0, 60), data))
    for k in range(220):
        questions.append((k, r.choice("abcd"), r.choice(["Production of Gevra mine", "total output of aadocm", "how much", "IB and gevra", "", None]), r.choice([None, None, "mcl", "ECL", "NCL"]), r.choice([None, "2024-25", "FY 2023-24", "2023", "2024–25", "2031"]), r.choice(["production", "production_target", "dispatch", "net_worth", "pat", None]), r.choice([None, "sum", "max", "min", "avg"])))
    rows = resolve.resolved(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(records, "scope string, record_id long, row_index int, data map<string,string>")).collect()
    got = {x.question_id: (x.found, x.calculation, x.metric_display, x.subsidiary, x.mine, x.value, x.formatted, x.unit, x.record_id) for x in rows}
    assert len(rows) == len(questions) and sum(x.found for x in rows) > 80 and {x.calculation for x in rows} >= {"lookup", "sum", "max", "min", "avg"}
    for q in questions:
        want = plain(q, records)
        a, b = list(got[q[0]]), list(want)
        assert (a.pop(5) or 0) == pytest.approx(b.pop(5) or 0) and a == b, (q, got[q[0]], want)


def test_year_texts(spark):
    rows = spark.createDataFrame([("FY 2024-25, 1999, 20231",), ("2023–2024",), (None,)], "c string").select(resolve.year_keys(F.col("c")).alias("y")).collect()
    assert sorted(rows[0].y) == ["2023", "2024", "2024-25"] and sorted(rows[1].y) == ["2023", "2023-20", "2023-202", "2023-2024", "2024"]


def slow_answer(text, chunks):
    """One question over its chunks in rank order: (kind, answer)."""
    low, keys = (text or "").lower(), []
    for words, found in resolve.ANSWERED_BY:
        if any(w in low for w in words):
            keys += found
    for _, content, _, _ in chunks:
        hits = []
        for line in filter(None, (x.strip() for x in re.split(r"[\r\n]+", content))):
            m = re.match(resolve.KEY_VALUE, line)
            if m and any(k in m[1].strip().lower() for k in keys):
                hits.append(f"{m[1].strip().title()}: {m[2].strip()}")
        if hits:
            return "fields", f"According to {chunks[0][2]}: {'; '.join(hits)}."
    if not chunks or not chunks[0][1].strip():
        return "none", resolve.NO_EVIDENCE
    _, content, title, page = chunks[0]
    if keys and not any(k in content.lower() for k in keys):
        return "absent", resolve.NOT_THERE
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", content.strip()) if s.strip()]
    tokens = set(re.findall("[a-zA-Z0-9]+", low))
    best = max(sentences, key=lambda s: sum(t in s.lower() for t in tokens))
    return "sentence", f"According to verified project records in {title}{f' (Page {page})' if page else ''}: {best}."


def test_answers_from_chunks(spark):
    r = random.Random(3)
    lines = ["Mine Name: Gevra", "Coal Grade - G10", "production = 52.5 MT", "The mine lies in Chhattisgarh.", "Output rose! It was high.", "Net worth: 12 Crore", "it's state: open", "Nothing of note", "1: 2", ""]
    asked = ["What is the mine name and grade?", "Where is it located", "how much was produced", "net worth of the company", "tell me about open cast rise", "", None]
    questions = [(k, r.choice(asked)) for k in range(120)]
    found = {k: [(i + 1, "\n".join(r.choices(lines, k=r.randint(0, 5))), f"Doc {i}", r.choice([None, 0, 3])) for i in range(r.randint(0, 3))] for k, _ in questions}
    df = spark.createDataFrame([(k, *c) for k, cs in found.items() for c in cs], "question_id long, rank int, content string, document_title string, page_number int")
    rows = {x.question_id: (x.kind, x.answer) for x in resolve.answers_from_chunks(spark.createDataFrame(questions, "question_id long, text string"), df).collect()}
    assert {k for k, _ in rows.values()} == {"fields", "none", "absent", "sentence"}
    for k, text in questions:
        assert rows[k] == slow_answer(text, found[k]), (text, found[k])


def test_comparison_takes_years_from_the_question(spark):
    schema = "scope string, record_id long, row_index int, data map<string,string>"
    now = [("a", 1, 0, {"subsidiary": "MCL", "production": "204.5", "year": "2024-25"}), ("a", 2, 1, {"subsidiary": "SECL", "production": "12345678.25", "year": "2023-24"}), ("a", 3, 2, {"subsidiary": "NCL", "production": "10"})]
    then = [(None, 9, 0, {"subsidiary": "MCL", "production": "190", "year": "2022-23"}), (None, 8, 1, {"subsidiary": "ECL", "production": "0", "year": "2022-23"}), (None, 7, 2, {"subsidiary": "NCL", "production": "0"})]
    q = [(1, "a", "Compare MCL production FY 2024-25 with 2022–23", "MCL", "2024-25", "production", None), (2, "a", "MCL production vs last year", "MCL", "2031-32", "production", None), (3, "a", "compare SECL", "SECL", None, "production", None),
         (4, "a", "compare ECL", "ECL", None, "production", None), (5, "a", "NCL change", "NCL", None, "production", None), (6, "a", "compare XCL", "XCL", None, "production", None), (7, "a", "compare", None, None, None, None)]
    rows = {r.question_id: r for r in resolve.compared_answers(spark.createDataFrame(q, QUESTIONS), spark.createDataFrame(now, schema), spark.createDataFrame(then, schema)).collect()}
    assert rows[1].answer == "MCL Production was 204.5 MT in 2024-25, compared with 190.0 MT in 2022-23. The increase was 14.50 MT (7.6%)." and (rows[1].difference, rows[1].pct) == (14.5, 7.63)
    assert rows[2].answer.startswith("MCL Production was 204.5 MT in current period, compared with 190.0 MT in baseline period.") and rows[2].confidence == "HIGH"
    assert rows[3].kind == "no_baseline" and rows[3].answer.startswith("Current value: 12345678.25 MT. I could not") and rows[3].answer.endswith("(No record found for subsidiary SECL).")
    assert rows[4].kind == "no_current" and rows[4].answer.startswith("Baseline value: 0.0 MT.") and rows[4].confidence == "LOW"
    assert rows[5].answer.endswith("The increase was 10.00 MT.") and rows[5].pct is None
    assert [(rows[k].kind, rows[k].answer, rows[k].confidence) for k in (6, 7)] == [("none", None, None)] * 2


def test_organization_answers(spark):
    records = spark.createDataFrame([(None, 4, 0, {"subsidiary": "MCL", "production": "190", "production_unit": "kt"})], "scope string, record_id long, row_index int, data map<string,string>")
    q = spark.createDataFrame([(1, "a", "MCL production", "MCL", None, "production", None), (2, "a", "drilling", None, None, "borehole", None), (3, "b", "rain", None, None, None, None), (4, "b", "snow", None, None, None, None)], QUESTIONS)
    found = spark.createDataFrame([(2, 2, 0.9, "second", "B"), (2, 1, 1.25, "c" * 300, "A"), (3, 1, 0.5, "wet", "C")], "question_id long, rank int, score double, content string, document_title string")
    titles = spark.createDataFrame([(4, "Report 2022")], "record_id long, document_title string")
    rows = {r.question_id: tuple(r)[1:] for r in resolve.organization_answers(q, records, titles, found).collect()}
    assert rows[1] == ("STRUCTURED", "According to the authorized organization historical report (Report 2022), Production was 190 kt.", "HIGH", 1)
    assert rows[2] == ("DOCUMENT", f"According to authorized organization reference records in A: {'c' * 200}.", "HIGH", 2) and rows[3][2:] == ("MEDIUM", 1)
    assert rows[4] == ("DOCUMENT", resolve.NO_REFERENCE, "LOW", 0)


def test_records_are_grouped_once(spark, tmp_path):
    """What questions join to is made of stored groups, so the records are not read again for each of them."""
    rows = [("s", i, i, {"subsidiary": "MCL", "mine": f"Mine{i % 3}", "production": str(i), "note": "2023-24"}) for i in range(1, 10)]
    spark.createDataFrame(rows, "scope string, record_id long, row_index long, data map<string,string>").write.parquet(str(tmp_path / "records"))
    q = spark.createDataFrame([(1, "s", "how much", None, "2023-24", "production", "max"), (2, "s", "of mine2", None, None, "production", None), (3, "s", "", "mcl", None, "production", None)], QUESTIONS)
    out = resolve.resolved(q, spark.read.parquet(str(tmp_path / "records")))
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    assert {r.question_id: r.value for r in out.collect()} == {1: 9.0, 2: 2.0, 3: 1.0}
