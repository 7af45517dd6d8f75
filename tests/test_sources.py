import io
import zipfile

import pytest

from strataframe.operators import quality
from strataframe.sources import readers, writers
from strataframe.streaming.ingest import ingest


def xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Production" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Mine</t></si><si><t>Production (MT)</t></si><si><t>Jharia</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row/><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row><c r="A3" t="s"><v>2</v></c><c r="B3"><v>4.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def docx() -> bytes:
    out = io.BytesIO()
    row = lambda *c: "<tr>" + "".join(f"<tc><p><r><t>{x}</t></r></p></tc>" for x in c) + "</tr>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<document><body><p><r><t>Heading</t></r></p><p><r><t>Text.</t></r></p><tbl>{row('Mine', 'Target')}{row('K', '2')}</tbl></body></document>")
    return out.getvalue()


def landing(path):
    (path / "a.csv").write_bytes("Mine;Production\n  Jharia ;1.5\n\nX;2;3\n".encode("utf-8-sig"))
    (path / "b.xlsx").write_bytes(xlsx())
    (path / "c.docx").write_bytes(docx())
    (path / "d.txt").write_bytes("caf\xe9".encode("latin-1"))
    (path / "e.xlsx").write_bytes(b"PK\x03\x04broken")
    (path / "f.pdf").write_bytes(b"no pdf")
    return str(path)


def test_read(spark, tmp_path):
    ok, rejected = readers.admitted(readers.files(spark, landing(tmp_path)))
    assert [r["reason"] for r in rejected.collect()] == ["signature"]
    t = {r["source_ref"]: (r["headers"], r["rows"]) for r in readers.tables(ok).collect()}
    assert t["a.csv"] == (["Mine", "Production"], [["Jharia", "1.5"], ["X", "2", "3"]])
    assert t["b.xlsx#Production"] == (["Mine", "Production (MT)"], [["Jharia", "4.5"]])
    assert t["c.docx#table1"] == (["Mine", "Target"], [["K", "2"]])
    assert t["e.xlsx"] == ([], [])
    texts = {r["path"][-5:]: r["raw_text"] for r in readers.texts(ok).collect()}
    assert texts == {"d.txt": "café", ".docx"[-5:]: "Heading\nText."}
    assert quality.document_status(quality.validate(readers.tables(ok))).count() == 4


def test_stream_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ingest(spark, landing(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    records = spark.read.parquet(str(tmp_path / "out/records"))
    assert records.count() == 4
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 4
    assert "mine" in writers.maintained_columns(records)
    writers.write_csv(writers.csv_rows(records, ["mine", "Production"]), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    docs = spark.createDataFrame([(1, False, False), (2, True, False)], "document_id long, is_reference boolean, is_archived boolean")
    assert writers.removed(docs, docs.select("document_id")).count() == 1
    assert [r["is_archived"] for r in writers.archived(docs, docs.select("document_id")).orderBy("document_id").collect()] == [True, False]


def test_workbook(spark):
    df = spark.createDataFrame([("a<b", 1.5, None), ("c", 2.0, "x")], "name string, v double, w string")
    books = writers.workbooks(df, ["name"], "S", most=1).collect()
    assert [readers.xlsx_tables(bytes(b.content)) for b in sorted(books, key=lambda b: b.path)] == [[("S", ["name", "v", "w"], [["a<b", "1.5", ""]])], [("S", ["name", "v", "w"], [["c", "2.0", "x"]])]]
    whole = writers.workbooks(df.coalesce(1), ["name"], "S").agg({"n": "sum"}).first()[0]
    assert whole == 2


def test_docx_in_document_order():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    t = lambda *rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = t(("a",), ("1",)) + p("One", "S1") + p("text", "Normal") + t(("b",), ("2",)) + f"<w:sdt><w:sdtContent>{p('Two', 'Heading2')}</w:sdtContent></w:sdt>" + p(" ") + t() + p("odd", "Heading9")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="S1"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="Normal"><w:name w:val="Normal"/></w:style></w:styles>')
    text, tables = readers.docx_content(out.getvalue())
    assert text == "One\ntext\nTwo\nodd" and tables == [("", ["a"], [["1"]]), ("One", ["b"], [["2"]]), ("Two", [], [])]


def test_maintained_workbooks(spark):
    rows = [(1, 10 + i, i, {"mine": f"M{i}", "production": str(i), **({"late": "x"} if i == 3 else {}), "mine_original_before_apply": "old"}) for i in range(5)] + [(2, 90, 0, {"z": "\x01<&>", "a": None})]
    records = spark.createDataFrame(rows, "dataset_id long, record_id long, row_index int, data map<string,string>")
    applied = spark.createDataFrame([(11, "mine"), (13, "late"), (99, "mine")], "record_id long, field_name string")
    names = spark.createDataFrame([(1, "Output", "a.xlsx"), (2, None, None)], "dataset_id long, name string, source string")
    books = {b.path: b for b in writers.maintained_workbooks(records, applied, names, "2024-04-01T00:00:00", most=4).collect()}
    assert {k: b.n for k, b in books.items()} == {"1-000000-maintained.xlsx": 4, "1-000001-maintained.xlsx": 1, "2-000000-maintained.xlsx": 1}
    (sheet, header, cells), (info, first, more) = readers.xlsx_tables(bytes(books["1-000000-maintained.xlsx"].content))
    assert (sheet, info) == ("Maintained Data", "Maintainer Info") and sorted(header) == ["late", "mine", "production"]
    assert first == ["Dataset", "Output"] and more[:2] == [["Source Document", "a.xlsx"], ["Records", "5"]] and more[2] == ["Exported At", "2024-04-01T00:00:00"]
    at = {h: i for i, h in enumerate(header)}
    assert [r[at["mine"]] for r in cells] == ["M0", "M1", "M2", "M3"] and cells[3][at["late"]] == "x"
    with zipfile.ZipFile(io.BytesIO(bytes(books["1-000000-maintained.xlsx"].content))) as z:
        xml = z.read("xl/worksheets/sheet1.xml").decode()
        assert xml.count('s="1"') == 3 and xml.count('s="2"') == 2 and 's="2" t="inlineStr"><is><t xml:space="preserve">M1<' in xml and "E2EFDA" in z.read("xl/styles.xml").decode()
    assert "&lt;&amp;&gt;" in zipfile.ZipFile(io.BytesIO(bytes(books["2-000000-maintained.xlsx"].content))).read("xl/worksheets/sheet1.xml").decode()


def test_seeds_fill_an_empty_table_once(spark, tmp_path):
    (tmp_path / "seed.json").write_text('[{"mine": "A", "production": 1.5}, {"mine": "B"}]')
    rows, path = readers.seed(spark, str(tmp_path / "seed.json"), "mine string, production double"), str(tmp_path / "t")
    assert [tuple(r) for r in rows.orderBy("mine").collect()] == [("A", 1.5), ("B", None)]
    assert writers.seeded(rows, path) and not writers.seeded(rows.where("mine = 'A'"), path) and spark.read.parquet(path).count() == 2
    assert writers.seeded(rows.where("mine = 'A'"), path, clear=True) and spark.read.parquet(path).count() == 1
    empty = str(tmp_path / "e")
    assert writers.seeded(rows.where("false"), empty) and writers.seeded(rows, empty)


def test_names_stay_below_the_root():
    assert readers.inside("/data/", "a/./b.csv") == "/data/a/b.csv" and readers.inside("s3://x", "a\\b/../c") == "s3://x/a/c"
    for bad in ("", ".", "..", "../x", "a/../../x", "/etc/passwd", "\\x", "C:\\x", "file:/x"):
        with pytest.raises(ValueError):
            readers.inside("/data", bad)
