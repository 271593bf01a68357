import random

from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Config
from pagemill.operators import blocks, chunking, figures, furniture, layout, sections


def lines_of(spark, pages):
    rows = [("d", p, n, t) for p, ls in enumerate(pages, 1) for n, t in enumerate(ls, 1)]
    return spark.createDataFrame(rows, "document_id string, pdf_page int, line_no int, text string")


def report(n=10):
    return [["Report head", f"Body line number {'x' * p} of this page", f"53,{100 + p}", "More text here", f"Co | Form | {p + 3}"] for p in range(1, n + 1)]


def test_furniture_learns_heads_and_footers_and_printed_pages(spark):
    rows = lines_of(spark, report())
    profile = furniture.furniture_profile(rows)
    assert {(r["norm"], r["is_footer"]) for r in profile.collect()} == {("report head", False), ("co | form | #", True), ("more text here", False)}
    printed = {r["pdf_page"]: r["printed_page"] for r in furniture.printed_pages(rows, profile).collect()}
    assert printed == {p: p + 3 for p in range(1, 11)}
    assert furniture.page_offsets(furniture.printed_pages(rows, profile)).first()["page_offset"] == -3


def test_numbers_at_the_edge_are_kept(spark):
    pages = [["Head line", f"text {'y' * p}", "53,325", f"F | {p}"] for p in range(1, 11)]
    rows = lines_of(spark, pages)
    left = furniture.strip_furniture(rows, furniture.furniture_profile(rows)).collect()
    assert {r["text"] for r in left if r["pdf_page"] == 3} == {"text yyy", "53,325"}


def strip(lines, gone):
    edge = min(3, len(lines) // 2) or len(lines)
    head = 0
    while head < min(edge, len(lines)) and lines[head] in gone:
        head += 1
    tail = len(lines)
    while tail > max(head, len(lines) - edge) and lines[tail - 1] in gone:
        tail -= 1
    return lines[head:tail]


def test_strip_matches_a_scalar_form(spark):
    rng = random.Random(3)
    pages = [[rng.choice(["head", "foot", "body a", "body b"]) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    profile = spark.createDataFrame([("d", "head"), ("d", "foot")], "document_id string, norm string")
    got = {}
    for r in furniture.strip_furniture(lines_of(spark, pages), profile).orderBy("pdf_page", "line_no").collect():
        got.setdefault(r["pdf_page"], []).append(r["text"])
    assert got == {p: s for p, ls in enumerate(pages, 1) if (s := strip(ls, {"head", "foot"}))}


def test_a_page_without_a_footer_has_no_printed_page(spark):
    rows = lines_of(spark, [*report(), ["alone"]])
    printed = {r["pdf_page"]: r["printed_page"] for r in furniture.printed_pages(rows, furniture.furniture_profile(rows)).collect()}
    assert printed[11] is None and printed[1] == 4


SPAN = "document_id string, pdf_page int, block_no int, line_no int, span_no int, text string, font string, size double, ly0 double, bx0 double, by0 double, bx1 double, by1 double"


def test_headings_and_resets(spark):
    texts = ["PART I — A", "Item 1. B", "Note 2 – C", "Sub", "Item 3. D", "PART II — E"]
    spans = [("d", 1, i, 0, 0, t, "X-Bold", 9.0, i * 10.0, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(texts)]
    spans += [
        ("d", 1, 20, 0, 0, "Plain", "Regular", 9.0, 500.0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 21, 0, 0, "Small", "Bold", 7.2, 510.0, 0.0, 0.0, 1.0, 1.0),
        ("d", 1, 22, 0, 0, "w " * 26, "Bold", 9.0, 520.0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 23, 0, 0, "Half ", "Bold", 9.0, 530.0, 0.0, 0.0, 1.0, 1.0),
        ("d", 1, 23, 0, 1, "bold", "Roman", 9.0, 530.0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 24, 0, 0, "Running head", "Bold", 9.0, 540.0, 0.0, 0.0, 1.0, 1.0),
    ]
    gone = spark.createDataFrame([("d", "running head")], "document_id string, norm string")
    heads = sections.headings(spark.createDataFrame(spans, SPAN), gone)
    assert [r["text"] for r in heads.orderBy("top").collect()] == texts
    asked = spark.createDataFrame([("d", 1, 0.0, 0), ("d", 1, 15.0, 1), ("d", 1, 20.0, 2), ("d", 1, 35.0, 3), ("d", 1, 49.0, 4), ("d", 1, None, 5), ("d", 2, 1.0, 6), ("e", 1, 1.0, 7)], "document_id string, pdf_page int, top double, n int")
    got = {r["n"]: tuple(r[x] for x in sections.LEVELS) for r in sections.sections_at(asked, heads).collect()}
    assert got == {
        0: ("PART I — A", None, None, None), 1: ("PART I — A", "Item 1. B", None, None), 2: ("PART I — A", "Item 1. B", "Note 2 – C", "Note 2 – C"),
        3: ("PART I — A", "Item 1. B", "Sub", "Note 2 – C"), 4: ("PART I — A", "Item 3. D", None, None), 5: ("PART II — E", None, None, None),
        6: ("PART II — E", None, None, None), 7: (None, None, None, None),
    }


def fold_rows(fragments, tolerance=3.0):
    out = []
    for f in sorted(fragments):
        if out and abs(f[0] - out[-1][0][0]) <= tolerance:
            out[-1].append(f)
        else:
            out.append([f])
    return [sorted(r, key=lambda f: f[1]) for r in out]


def fold_columns(rows):
    rows = [r for r in rows if len(r) >= 2]
    if len(rows) > 1 and len(rows[0]) < max(map(len, rows)):
        rows = rows[1:]
    cols = []
    for f in [f for r in rows for f in r]:
        hit = next((c for c in cols if any(m[1] < f[2] and f[1] < m[2] for m in c)), None)
        cols.append([f]) if hit is None else hit.append(f)
    return sorted((" ".join(f[3] for f in c), min(f[1] for f in c), max(f[2] for f in c)) for c in cols)


def test_header_folds_match_scalar_forms(spark):
    rng = random.Random(9)
    data = {t: [(rng.randrange(14) * 1.0, rng.randrange(90) * 1.0, 0.0, f"t{i}") for i in range(rng.randrange(1, 10))] for t in range(80)}
    data = {t: [(y, x, x + 25.0, s) for y, x, _, s in fs] for t, fs in data.items()}
    df = spark.createDataFrame([(t, *f) for t, fs in data.items() for f in fs], "t int, y double, x0 double, x1 double, text string")
    rows = layout.fragment_rows(df, ["t"]).cache()
    got = {r["t"]: [[f["text"] for f in row] for row in r["rows"]] for r in rows.collect()}
    assert got == {t: [[f[3] for f in row] for row in fold_rows(fs)] for t, fs in data.items()}
    cols = {}
    for r in layout.header_columns(rows, ["t"]).collect():
        cols.setdefault(r["t"], []).append((r["label"], r["x0"], r["x1"]))
    assert {t: sorted(c) for t, c in cols.items()} == {t: c for t, fs in data.items() if (c := fold_columns(fold_rows(fs)))}


def group_of(centre, groups):
    groups = sorted(groups)
    edges = [(groups[i][1] + groups[i + 1][0]) / 2 for i in range(len(groups) - 1)]
    i = 0
    while i < len(edges) and centre > edges[i]:
        i += 1
    return groups[i][2]


def test_group_labels_split_at_midpoints(spark):
    rng = random.Random(4)
    data = [(t, f"g{i}", x := float(rng.randrange(200)), x + rng.randrange(60)) for t in range(40) for i in range(rng.randrange(1, 5))]
    leaves = [(t, f"l{i}", x := float(rng.randrange(260)), x + 10.0) for t in range(40) for i in range(6)]
    got = layout.assign_groups(spark.createDataFrame(leaves, "t int, label string, x0 double, x1 double"), spark.createDataFrame(data, "t int, text string, x0 double, x1 double"), ["t"])
    want = {(t, n): group_of((a + b) / 2, [(x0, x1, g) for u, g, x0, x1 in data if u == t]) for t, n, a, b in leaves}
    assert {(r["t"], r["label"]): r["group"] for r in got.collect()} == want


def test_blocks_leave_tables_and_furniture_out(spark):
    spans = [
        ("d", 1, 0, 0, 0, "Kept ", "R", 9.0, 0.0, 0.0, 0.0, 100.0, 10.0), ("d", 1, 0, 0, 1, "line", "R", 9.0, 0.0, 0.0, 0.0, 100.0, 10.0), ("d", 1, 0, 1, 0, "second", "R", 9.0, 0.0, 0.0, 0.0, 100.0, 10.0),
        ("d", 1, 0, 2, 0, "Footer 9", "R", 9.0, 0.0, 0.0, 0.0, 100.0, 10.0), ("d", 1, 1, 0, 0, "In a table", "R", 9.0, 0.0, 0.0, 50.0, 100.0, 60.0), ("d", 1, 2, 0, 0, "No area", "R", 9.0, 0.0, 0.0, 55.0, 100.0, 55.0),
    ]
    regions = spark.createDataFrame([("d", 1, 0.0, 40.0, 100.0, 80.0)], "document_id string, pdf_page int, x0 double, y0 double, x1 double, y1 double")
    gone = spark.createDataFrame([("d", "footer #")], "document_id string, norm string")
    got = {r["block_no"]: r["text"] for r in blocks.text_blocks(spark.createDataFrame(spans, SPAN), regions, gone).collect()}
    assert got == {0: "Kept line second", 2: "No area"}


def tail(text, size):
    window = text[-size:]
    for cut in (". ", "; ", ", ", " "):
        if cut in window:
            window = window[window.index(cut) + len(cut) :]
            break
    return text if len(text) <= size else window


def pack(items, cfg):
    """(page, ord, key, text) to (page, number, anchor, body)."""
    out, n = [], {}
    buf, length, anchor, at = [], 0, None, None

    def flush():
        nonlocal buf, length, anchor
        body = " ".join(buf).strip()
        if len(body) >= cfg.min_chunk:
            out.append((at[0], n.get(at[0], 0), anchor, body))
            n[at[0]] = n.get(at[0], 0) + 1
        buf, length, anchor = [], 0, None

    for page, ord_, key, text in items:
        if at is not None and (page, key) != at and buf:
            flush()
        at = (page, key) if not buf else at
        if buf and length + len(text) > cfg.chunk_size:
            carried = tail(" ".join(buf), cfg.chunk_overlap)
            flush()
            if carried:
                buf, length = [carried], len(carried)
        anchor = ord_ if anchor is None else anchor
        buf.append(text)
        length += len(text) + 1
    if buf:
        flush()
    return out


def test_packing_matches_a_scalar_form(spark):
    rng = random.Random(6)
    cfg = Config(chunk_size=90, chunk_overlap=25, min_chunk=12)
    items = []
    for page in range(1, 40):
        key = "a"
        for i in range(rng.randrange(1, 14)):
            key = rng.choice([key, key, key, "a", "b", "c"])
            text = " ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", ".", ",", ";"]) for _ in range(rng.choice([1, 3, 8, 30])))
            items.append((page, i, key, text))
    df = spark.createDataFrame([("d", *x) for x in items], "document_id string, pdf_page int, ord int, key string, text string")
    got = sorted((r["pdf_page"], r["chunk_no"], r["anchor"], r["body"]) for r in chunking.pack_blocks(df, cfg).collect())
    assert got == sorted(pack(items, cfg))


def test_figures_and_inventory(spark):
    images = [("d", 1, 0, 46, 56, 0.0, 100.0, 46.0, 156.0), ("d", 1, 1, 20, 20, 0.0, 0.0, 20.0, 20.0), ("d", 2, 2, 400, 300, 0.0, 100.0, 400.0, 400.0), ("d", 3, 3, 20, 400, 0.0, 0.0, 2.0, 2.0)]
    imgs = spark.createDataFrame(images, "document_id string, pdf_page int, img_no int, width int, height int, x0 double, y0 double, x1 double, y1 double")
    near = spark.createDataFrame([("d", 2, 1, "Figure 4: growth", 420.0, 430.0), ("d", 2, 2, "far", 900.0, 910.0), ("d", 1, 1, "beside", 60.0, 70.0)], "document_id string, pdf_page int, line_no int, text string, y0 double, y1 double")
    figs = figures.figures(imgs, near).cache()
    got = {r["img_no"]: (r["caption"], r["surrounding_text"], r["is_decorative"]) for r in figs.collect()}
    assert got == {0: (None, "beside", True), 2: ("Figure 4: growth", "Figure 4: growth", False), 3: (None, "", False)}
    docs = spark.createDataFrame([("d", 5), ("e", 2)], "document_id string, page_count int")
    printed = spark.createDataFrame([("d", 2, 7)], "document_id string, pdf_page int, printed_page int")
    inv = {r["document_id"]: r for r in figures.figure_inventory(docs, figs, printed).collect()}
    assert inv["e"]["text"].startswith("Figure inventory. Embedded images: 0, on none of") and inv["e"]["pdf_page"] == 1
    assert "images: 3, in a document of 5 pages. Found on: PDF page 1, page 7, PDF page 3." in inv["d"]["text"] and inv["d"]["decorative"] == 1


def test_table_floor_and_header_ties(spark):
    t = spark.createDataFrame([("d", 1, 0, 10.0, 50.0), ("d", 1, 1, 60.0, 90.0), ("d", 1, 2, 95.0, 99.0)], "document_id string, pdf_page int, table_no int, y0 double, y1 double")
    assert {r["table_no"]: r["floor"] for r in layout.table_floors(t, ["document_id", "pdf_page"]).collect()} == {0: None, 1: 50.0, 2: 90.0}
    cols = spark.createDataFrame([(1, 0, 0.0, 20.0), (1, 1, 50.0, 70.0), (1, 2, 90.0, 95.0)], "t int, place int, x0 double, x1 double")
    heads = spark.createDataFrame([(1, "left", 40.0, 60.0), (1, "right", 60.0, 80.0), (1, "label", 0.0, 20.0)], "t int, label string, x0 double, x1 double")
    assert {r["place"]: r["label"] for r in layout.assign_headers(cols, heads, ["t"]).collect()} == {0: "", 1: "left", 2: ""}
    assert DEFAULT.limit(0) == 8 and DEFAULT.limit(3) == 3


def test_chunks_reject_mislabelled_payloads(spark):
    import pytest

    from pagemill.schemas import CHUNKS

    where = ("d", 1, None, None, None, None, None, None)
    logo = (None, None, None, "", 10, 10, True)
    good = [("a", "text", "t", "t", where, None, None), ("b", "figure", "t", "t", where, None, logo)]
    assert chunking.checked(spark.createDataFrame(good, CHUNKS)).count() == 2
    bad = spark.createDataFrame([("c", "text", "t", "t", where, None, logo)], CHUNKS)
    with pytest.raises(Exception, match="does not match"):
        chunking.checked(bad).collect()
    assert chunking.checked(spark.createDataFrame(good, CHUNKS)).where(F.col("content_type") == "figure").count() == 1
