import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T


def value(spark, expr, /, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in columns.items()))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "want"),
    [("Apple  Inc. | Q3 2022 | 15", "apple inc. | q# # | #"), ("  A B ", "a b"), ("", ""), ("12,345", "#,#")],
)
def test_furniture_key(spark, line, want):
    assert value(spark, T.furniture_key(F.col("x")), x=line) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("PART I — Finance", "part"), ("part I", "subsection"), ("Item 7A. Risk", "item"), ("ITEM 2. x", "item"), ("Note 5 – Debt", "note"),
        ("Note 5", "subsection"), ("Overview", "subsection"),
    ],
)
def test_heading_kind(spark, text, want):
    assert value(spark, T.heading_kind(F.col("x")), x=text) == want


def test_citation_and_location(spark):
    assert value(spark, T.citation(F.col("p"), F.col("d")), p=6, d=9) == "Page 6 (PDF p. 9)"
    assert value(spark, T.citation(F.lit(None).cast("int"), F.col("d")), d=9) == "PDF p. 9"
    cols = [F.col(c) for c in ("note", "section", "item", "part")]
    assert value(spark, T.location(*cols), note="", section="S", item="I", part="P") == "S"
    assert value(spark, T.location(*cols), note=None, section="", item=None, part=None) == "Unattributed"
    assert value(spark, T.breadcrumb(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="P", b="", c="N", d="N") == "P > N"


def tail(text, size):
    window = text[-size:]
    for cut in (". ", "; ", ", ", " "):
        if cut in window:
            window = window[window.index(cut) + len(cut) :]
            break
    return text if len(text) <= size else window


@pytest.mark.parametrize("text", ["short", "One two. Three four five", "aa bb; cc, dd ee ff gg", "x" * 40, "a b c d e f g h i j k, l m"])
@pytest.mark.parametrize("size", [5, 12, 20])
def test_overlap_tail(spark, text, size):
    assert value(spark, T.overlap_tail(F.col("x"), size), x=text) == tail(text, size)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("82,959 Leases", ["82,959", "82959", "leases", "leas"]), ("companies boxes sale glass bus", ["companies", "company", "boxes", "box", "sale", "glass", "bus"]),
        ("für 1.5, ...", ["f", "r", "1.5"]), ("", []), ("Taxes expenses churches", ["taxes", "tax", "expenses", "expens", "churches", "church"]),
    ],
)
def test_tokens(spark, text, want):
    assert value(spark, T.tokens(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("How much revenue?", "table"), ("Explain the chart", "text, figure"), ("Show images", "no preference"), ("see fig.3", "figure"), ("see fig. 3", "no preference"),
        ("Was it 1,234?", "table"), ("hello", "no preference"), ("Why did total cost change", "text, table"),
    ],
)
def test_route(spark, question, want):
    assert value(spark, T.route_name(T.route(F.col("x"))), x=question) == want


@pytest.mark.parametrize(
    ("cell", "cur", "pct", "want"),
    [("(10)", "", "", "-10"), ("(1,234.5)", "", "", "-1,234.5"), ("63,355", "$", "", "$63,355"), ("(10)", "", "%", "-10%"), ("  ", "$", "%", ""), (None, "$", "", ""), ("(10)", "$", "", "$-10"), ("(a)", "", "", "(a)")],
)
def test_cell_value(spark, cell, cur, pct, want):
    assert value(spark, T.cell_value(F.col("x"), F.col("c"), F.col("p")), x=cell, c=cur, p=pct) == want


def test_contains_all(spark):
    c = T.contains_all(F.col("x"), F.col("e"))
    assert value(spark, c, x="It was 63,355 million", e=["63355", "MILLION"]) is True
    assert value(spark, c, x="It was 63,355", e=["64"]) is False
    assert value(spark, c, x="anything", e=[]) is True


def test_markdown(spark):
    df = spark.sql("SELECT array('', 'a|b') h, array(array('x', '1', '2'), array('y')) r, cast(array() as array<string>) none")
    row = df.select(T.markdown(F.col("h"), F.col("r")).alias("m"), T.markdown(F.col("none"), F.col("r")).alias("n")).first()
    assert row["m"] == "|   | a\\|b |\n|---|---|\n| x | 1 |\n| y |  |" and row["n"] == ""


def test_captions_and_units(spark):
    band = "The following table shows a: The following tables show b (in millions): c (Dollars in thousands)"
    assert value(spark, T.last_match(F.col("x"), T.CAPTION), x=band) == "The following tables show b (in millions):"
    assert value(spark, T.last_match(F.col("x"), T.UNITS), x=band) == "(Dollars in thousands)"
    assert value(spark, T.last_match(F.col("x"), T.UNITS), x="none") is None


def test_white_space_of_any_script(spark):
    nb = "\u00a0"
    kinds = {f"Item{nb}2.{nb}Legal": "item", f"PART{nb}IV": "part", f"Note{nb}3{nb}–{nb}Taxes": "note", f"Items{nb}2": "subsection"}
    for text, kind in kinds.items():
        assert value(spark, T.heading_kind(F.col("x")), x=text) == kind
    assert value(spark, T.last_match(F.col("x"), T.UNITS), x=f"Sales ({nb}in{nb}millions)") == f"({nb}in{nb}millions)"
    assert value(spark, T.route(F.col("x")), x=f"how{nb}much was it")["table"] == 1.0
