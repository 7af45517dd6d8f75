import csv
import io
import random

import pytest

from strataframe.sources import readers, split_csv


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_quotes_as_the_reader_sees_them():
    r = random.Random(2)
    for _ in range(3000):
        lines = ["".join(r.choice(['"', '""', ",", "a", " ", 'x"', "b"]) for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 5))]
        inside, records = False, []
        for line in lines:
            records[len(records) - inside :] = ["\n".join([*records[len(records) - inside :], line])]
            inside = split_csv.ends_inside(line, ",", inside)
        assert [next(csv.reader(io.StringIO(x, newline="")), []) for x in records] == list(csv.reader(io.StringIO("\n".join(lines) + ("\n" if not inside else ""), newline="")))[: len(records)], lines


def test_many_splits_read_as_one(spark, small_splits, tmp_path):
    r = random.Random(7)
    cell = lambda: r.choice(["1", "MCL", "a b", "", "x;y", 'say "hi"', "two\nlines", "three\n\n\nlines, \"q\"\n", "é", "1,250", "long " * 30, '5" pipe'])
    files = {}
    for name, delimiter, end, encoding in (("a", ",", "\n", "utf-8"), ("b", ";", "\r\n", "utf-8-sig"), ("c", "\t", "\n", "latin-1"), ("d", "|", "\n", "utf-8")):
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=delimiter, lineterminator=end)
        w.writerow(["Subsidiary", "FY 2024-25", "Note é"])
        for _ in range(120):
            w.writerow([cell() for _ in range(r.randint(1, 4))])
            if r.random() < 0.1:
                out.write(end)
        files[name] = out.getvalue().encode(encoding)
    files |= {"e": b"", "f": b"only,a,header\n", "g": b"h,i\n1,\"never closed\n2,3\n\n4,5", "h": b"a,b\n" + b"\n" * 300 + b"x,y\n"}
    for name, data in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows = split_csv.csv_records(spark, str(tmp_path)).collect()
    assert len(split_csv._lines(spark, str(tmp_path)).select("path", "split").distinct().collect()) > 100
    for name, data in files.items():
        mine = sorted((x for x in rows if x.path.endswith(f"/{name}.csv")), key=lambda x: x.row_index)
        headers, cells = readers.csv_table(data)
        assert [x.cells for x in mine] == cells, name
        assert all(x.headers == headers for x in mine) and [x.row_index for x in mine] == list(range(len(cells)))


def test_delimiters_are_sniffed(spark, tmp_path):
    assert [readers.sniffed(x) for x in ("a;b\n1;2\n", "a\tb,c\n1\t2,3\n", "a|b\n", "", "word")] == [";", readers.sniffed("a\tb,c\n1\t2,3\n"), "|", ",", ","]
    assert readers.csv_table(b"Mine;Output\nA;1,5\nB;2,5\n") == (["Mine", "Output"], [["A", "1,5"], ["B", "2,5"]])


def test_a_split_is_not_held(monkeypatch):
    """Records leave while their split is read: of forty batches of one split a few are taken before the first are handed on."""
    monkeypatch.setattr(split_csv, "ROWS", 64)
    import pyarrow as pa

    lines, taken = [f'{i},"a' if i % 3 == 0 else f'{i}"' if i % 3 == 1 else f"{i},b" for i in range(4000)], []

    def batches():
        for at in range(0, len(lines), 100):
            taken.append(at)
            some = lines[at : at + 100]
            yield pa.RecordBatch.from_pydict({"path": ["p"] * 100, "split": [0] * 100, "value": [x.encode() for x in some], "encoding": ["utf-8"] * 100, "delimiter": [","] * 100, "inside": [False] * 100, "before": [0] * 100})

    cut = split_csv._cut(batches())
    first = next(cut)
    assert len(taken) < 4 and first.num_rows >= 64
    texts = first.column(4).to_pylist() + [t for b in cut for t in b.column(4).to_pylist()]
    assert "\n".join(texts) == "\n".join(lines) and texts[0] == '0,"a\n1"' and len(texts) == 2667
