"""Geometry on a page. Every join has an equality on document, page or table beside its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERED = 0.5
LABEL_TOLERANCE = 6.0
ROW_TOLERANCE = 3.0
PROSE_SHARE = 0.35
HEADER_BAND = 70.0
BAND_MARGIN, BAND_GAP = 5.0, 1.0


def covered_share(b: str, r: str) -> Column:
    """Share of box ``b`` that box ``r`` covers; 0 for a box without area. Names are column prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    width = F.greatest(F.lit(0.0), F.least(c(b, "x1"), c(r, "x1")) - F.greatest(c(b, "x0"), c(r, "x0")))
    height = F.greatest(F.lit(0.0), F.least(c(b, "y1"), c(r, "y1")) - F.greatest(c(b, "y0"), c(r, "y0")))
    area = (c(b, "x1") - c(b, "x0")) * (c(b, "y1") - c(b, "y0"))
    return F.when(area > 0, width * height / area).otherwise(F.lit(0.0))


def outside_regions(blocks: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, x0..y1, ...) of which no region of the same page covers more than half."""
    box = ("x0", "y0", "x1", "y1")
    r = regions.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in box])
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    return blocks.join(r, [*same, covered_share("", "r_") > COVERED], "left_anti")


def table_numbers(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Tables (keys, x0, y0, ...) with ``table_no``, their number on the page from 0, from top to bottom."""
    order = Window.partitionBy(*keys).orderBy("y0", "x0", "y1", "x1")
    return tables.withColumn("table_no", F.row_number().over(order) - 1)


def table_floors(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Tables (keys, table_no, y0, y1) with ``floor``, the lowest bottom of another table that ends above."""
    above = tables.select(*keys, F.col("table_no").alias("o_no"), F.col("y1").alias("o_y1"))
    pairs = tables.join(above, keys).where("o_no <> table_no and o_y1 <= y0")
    floors = pairs.groupBy(*keys, "table_no").agg(F.max("o_y1").alias("floor"))
    return tables.join(floors, [*keys, "table_no"], "left")


def column_spans(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table, col, place, x0, x1): extent of each column that has a cell; place counts those from 0."""
    spans = cells.where("x0 is not null").groupBy(*table, "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(*table).orderBy("col")) - 1)


def assign_headers(columns: DataFrame, headers: DataFrame, table: list[str]) -> DataFrame:
    """Columns (table, place, x0, x1) with ``label``: the header that overlaps most, the first in a tie.

    Columns that start at the table's left edge hold row labels and get ''. Headers: (table, label, x0, x1).
    """
    left = F.min("x0").over(Window.partitionBy(*table))
    cols = columns.withColumn("is_label", F.col("x0") <= left + LABEL_TOLERANCE)
    h = headers.select(*table, F.col("label").alias("h_label"), F.col("x0").alias("h_x0"), F.col("x1").alias("h_x1"))
    overlap = F.least("x1", "h_x1") - F.greatest("x0", "h_x0")
    found = cols.where("not is_label").join(h, table).withColumn("overlap", overlap).where("overlap > 0")
    best = found.groupBy(*table, "place").agg(F.min_by("h_label", F.struct(-F.col("overlap"), "h_x0", "h_x1", "h_label")).alias("label"))
    out = cols.join(best, [*table, "place"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(""))).drop("is_label")


def assign_groups(leaves: DataFrame, groups: DataFrame, table: list[str]) -> DataFrame:
    """Leaf headers (table, label, x0, x1) with ``group``: split at the midpoints between group headers."""
    order = Window.partitionBy(*table).orderBy("g_x0", "g_x1", "group")
    g = groups.select(*table, F.col("text").alias("group"), F.col("x0").alias("g_x0"), F.col("x1").alias("g_x1"))
    middle = lambda a, b: (a + b) / 2
    g = g.withColumn("low", middle(F.lag("g_x1").over(order), F.col("g_x0"))).withColumn("high", middle(F.col("g_x1"), F.lead("g_x0").over(order)))
    # The first boundary that the centre does not pass decides, also where boundaries do not ascend.
    g = g.withColumn("reach", F.max("low").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    centre = (F.col("x0") + F.col("x1")) / 2
    fits = (F.col("reach").isNull() | (centre > F.col("reach"))) & (F.col("high").isNull() | (centre <= F.col("high")))
    return leaves.join(g, table, "left").where(F.col("group").isNull() | fits).select(*leaves.columns, "group")


FRAGMENT = "struct<y:double,x0:double,x1:double,text:string>"


def fragment_rows(fragments: DataFrame, table: list[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(table, rows): header fragments clustered into rows, array<array<fragment>>.

    A fragment joins the row of the one before if it lies within the tolerance of that row's first
    fragment. A header band holds a few dozen fragments, so the fold runs inside one row.
    """
    listed = fragments.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1", "text"))).alias("f"))
    empty = F.array().cast(f"array<array<{FRAGMENT}>>")

    def step(acc: Column, f: Column) -> Column:
        near = (F.size(acc) > 0) & (F.abs(f["y"] - F.element_at(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), 1)["y"]) <= tolerance)
        grown = F.transform(acc, lambda row, i: F.when(i == F.size(acc) - 1, F.concat(row, F.array(f))).otherwise(row))
        return F.when(near, grown).otherwise(F.concat(acc, F.array(F.array(f))))

    by_x = lambda row: F.array_sort(row, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    return listed.select(*table, F.transform(F.aggregate("f", empty, step), by_x).alias("rows"))


def header_columns(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, label, x0, x1, group): leaf columns of header rows with two or more fragments.

    The top row is a level of groups when there are several rows and it is narrower than the widest.
    Fragments of the other rows, from top to bottom, join the first column that any of their
    members overlaps, else they open one.
    """
    kept = rows.withColumn("rows", F.filter("rows", lambda r: F.size(r) >= 2)).where(F.size("rows") > 0)
    widest = F.array_max(F.transform("rows", F.size))
    has_groups = (F.size("rows") > 1) & (F.size(F.element_at("rows", 1)) < widest)
    kept = kept.withColumn("groups", F.when(has_groups, F.element_at("rows", 1)).otherwise(F.array().cast(f"array<{FRAGMENT}>")))
    body = F.when(has_groups, F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).otherwise(F.col("rows"))
    kept = kept.withColumn("fragments", F.flatten(body))
    empty = F.array().cast(f"array<array<{FRAGMENT}>>")

    def step(acc: Column, f: Column) -> Column:
        touches = lambda c: F.exists(c, lambda m: (m["x0"] < f["x1"]) & (f["x0"] < m["x1"]))
        at = F.array_position(F.transform(acc, touches), F.lit(True))
        grown = F.transform(acc, lambda c, i: F.when(i == at - 1, F.concat(c, F.array(f))).otherwise(c))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.array(f))))

    columns = kept.select(*table, "groups", F.explode(F.aggregate("fragments", empty, step)).alias("c"))
    label = F.trim(F.regexp_replace(F.array_join(F.transform("c", lambda f: f["text"]), " "), r",\s+", ", "))
    leaves = columns.select(
        *table, label.alias("label"), F.array_min(F.transform("c", lambda f: f["x0"])).alias("x0"),
        F.array_max(F.transform("c", lambda f: f["x1"])).alias("x1"),
    )
    groups = kept.select(*table, F.explode("groups").alias("g")).select(*table, "g.text", "g.x0", "g.x1")
    return assign_groups(leaves, groups, table)


def full_label(label: Column, group: Column) -> Column:
    return F.when(F.coalesce(group, F.lit("")) == "", label).otherwise(F.concat(group, F.lit(" | "), label))


def band_above(lines: DataFrame, tables: DataFrame, table: list[str], height: float) -> DataFrame:
    """Lines (page, x0, y0, x1, ...) with the table whose band above they start in.

    The band is ``height`` high, never reaches above the table's floor and is a little wider than the table,
    whose edges come along as ``t_x0`` and ``t_x1``.
    """
    t = tables.select(*table, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1")], F.coalesce("floor", F.lit(0.0)).alias("t_floor"))
    top = F.greatest(F.lit(0.0), F.col("t_y0") - height, F.col("t_floor"))
    near = lines.join(t, [k for k in table if k != "table_no"]).where((F.col("y0") >= top) & (F.col("y0") < F.col("t_y0") - BAND_GAP))
    return near.where((F.col("x1") >= F.col("t_x0") - BAND_MARGIN) & (F.col("x0") <= F.col("t_x1") + BAND_MARGIN)).drop("t_y0", "t_floor")


def header_band(lines: DataFrame, tables: DataFrame, table: list[str], height: float = HEADER_BAND) -> DataFrame:
    """Header fragments (table, text, x0, x1, y): lines near above their table, but for prose (wider than a good third of it)."""
    narrow = (F.col("x1") - F.col("x0")) <= PROSE_SHARE * (F.col("t_x1") - F.col("t_x0"))
    return band_above(lines, tables, table, height).where(narrow).select(*table, "text", "x0", "x1", F.col("y0").alias("y"))
