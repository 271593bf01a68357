"""Scalar expressions on text: all are JVM expressions, none is a UDF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues that route a question to a type of content, and the shapes of headings,
# captions and units.
FIGURE_CUES = r"(?i)\b(figure|fig\.|chart|graph|diagram|image|picture|photo|illustration|logo|visual)\b"
TABLE_CUES = (
    r"(?i)(\b(how\s+much|how\s+many|total|amount|revenue|sales|income|margin|expense|cost|cash|assets?|liabilities|"
    r"equity|earnings|eps|tax|debt|segment|compare|comparison|change|increase|decrease|percentage|percent|quarter|"
    r"quarterly|year[-\s]?over[-\s]?year)\b|\$|%|\b\d{1,3}(,\d{3})+\b)"
)
TEXT_CUES = (
    r"(?i)\b(describe|explain|what\s+does|why|policy|risk|discussion|state[sd]?|disclose[sd]?|mention|say|states?|"
    r"commitment|litigation|proceeding)\b"
)
PART = r"^PART\s+([IVX]+)\b\s*[—–-]?\s*(.*)$"
NOTE = r"(?i)^Note\s+(\d+)\s*[—–-]\s*(.+)$"
ITEM = r"(?i)^Item\s+(\d+[A-Z]?)\.\s*(.*)$"
CAPTION = r"(?i)\bThe following tables?\b[^.:]*[.:]"
UNITS = r"(?i)\(\s*(?:in|dollars in|amounts in)\b[^)]*\)"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
NEGATIVE = r"^\(([\d,]+(?:\.\d+)?)\)$"
OVERLAP_CUTS = (". ", "; ", ", ", " ")
FIGURE_CAPTION = r"(?i)^(figure|chart|exhibit|graph)"


#: Makes white space, digits and word boundaries of any script count; filings are full of no-break spaces.
UNICODE = "(?U)"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(UNICODE + pattern)


def strip(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def furniture_key(line: Column) -> Column:
    """The form under which lines of page furniture repeat: squeezed, lower case, digit runs as ``#``."""
    return F.regexp_replace(F.lower(squeeze(line)), r"(?U)\d+", "#")


def heading_kind(c: Column) -> Column:
    return F.when(matches(c, PART), "part").when(matches(c, NOTE), "note").when(matches(c, ITEM), "item").otherwise("subsection")


def citation(printed: Column, pdf: Column) -> Column:
    plain = F.format_string("PDF p. %d", pdf)
    return F.when(printed.isNotNull(), F.format_string("Page %d (PDF p. %d)", printed, pdf)).otherwise(plain)


def present(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def location(note: Column, section: Column, item: Column, part: Column) -> Column:
    return F.coalesce(*[present(c) for c in (note, section, item, part)], F.lit("Unattributed"))


def join_present(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), separator)


def breadcrumb(part: Column, item: Column, note: Column, section: Column) -> Column:
    named = F.filter(F.array(part, item, note, section), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.array_distinct(named), " > ")


def overlap_tail(text: Column, size: int) -> Column:
    """The last ``size`` characters from after the first cut: sentence before clause before word."""
    window = F.right(text, F.lit(size))
    out = window
    for cut in reversed(OVERLAP_CUTS):
        at = F.locate(cut, window)
        out = F.when(at > 0, F.substr(window, at + len(cut))).otherwise(out)
    return F.when(F.length(text) <= size, text).otherwise(out) if size > 0 else text


def singular(token: Column) -> Column:
    """The singular of a regular plural, null for any other token."""
    cut = lambda n: F.substr(token, F.lit(1), F.length(token) - n)
    ends = lambda *tails: reduce(or_, [token.endswith(x) for x in tails])
    plural = F.when(ends("ies"), F.concat(cut(3), F.lit("y"))).when(ends("ses", "xes", "zes", "ches", "shes"), cut(2)).when(~ends("ss", "us", "is"), cut(1))
    letters = F.translate(token, "abcdefghijklmnopqrstuvwxyz", "") == ""
    return F.when(token.endswith("s") & (F.length(token) >= 4) & letters, plural)


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits with dots and commas, which ``token_forms`` trims and completes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9,\\.]*"), F.lit(0))


def token_forms(raw: Column) -> Column:
    """A trimmed token, its form without commas and its singular; null where there is none."""
    t = F.btrim(raw, F.lit(".,"))
    closed = F.replace(t, F.lit(","), F.lit(""))
    return F.array(present(t), F.when((closed != t) & (closed != ""), closed), singular(t))


def tokens(text: Column) -> Column:
    """Lexical tokens in order: each token, then its form without commas, then its singular."""
    return F.array_compact(F.flatten(F.transform(raw_tokens(text), token_forms)))


def token_rows(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, term): a row for each of ``tokens``. The forms are made row by row in generated code, not in a lambda."""
    raw = rows.select(*keys, F.explode(raw_tokens(F.col(text_col))).alias("raw"))
    return raw.select(*keys, F.explode(token_forms(F.col("raw"))).alias("term")).where("term is not null")


def route(question: Column) -> Column:
    """struct<text,table,figure> of doubles: 1.0 where the question has a cue for the type."""
    hit = lambda cues: matches(question, cues).cast("double")
    return F.struct(hit(TEXT_CUES).alias("text"), hit(TABLE_CUES).alias("table"), hit(FIGURE_CUES).alias("figure"))


def route_name(bias: Column) -> Column:
    names = F.array(*[F.when(bias[t] > 0, F.lit(t)) for t in ("text", "table", "figure")])
    named = F.array_join(F.array_compact(names), ", ")
    return F.when(named == "", "no preference").otherwise(named)


def metric_key(c: Column) -> Column:
    """Lower case without commas and white space."""
    return F.regexp_replace(F.lower(c), r"(?U)[,\s]", "")


def contains_all(text: Column, expected: Column) -> Column:
    key = metric_key(text)
    return F.forall(expected, lambda e: F.contains(key, metric_key(e)))


def cell_value(text: Column, currency: Column, percent: Column) -> Column:
    """A cell with the symbols of its columns; ``(10)`` becomes ``-10``; a blank cell stays blank."""
    bare = squeeze(F.coalesce(text, F.lit("")))
    signed = F.regexp_replace(bare, NEGATIVE, "-$1")
    return F.when(bare == "", "").otherwise(F.concat(currency, signed, percent))


def last_match(text: Column, pattern: str) -> Column:
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(0)), F.lit(-1)))


def markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table of array<string> headers and array<array<string>> rows, padded or cut to the headers."""
    safe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = line(F.transform(headers, lambda h: F.when(h == "", " ").otherwise(safe(h))))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda h: F.lit("---")), "|"), F.lit("|"))
    width = F.size(headers)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
    body = F.transform(rows, lambda r: line(F.transform(fit(r), safe)))
    return F.when(width == 0, "").otherwise(F.array_join(F.concat(F.array(head, rule), body), "\n"))


def prompt(question: Column, evidence: Column) -> Column:
    """What the model is asked; without evidence it is asked to say so."""
    without = F.concat(F.lit("Question: "), question, F.lit("\n\nNothing was retrieved for this question. Say that the documents do not answer it."))
    return F.when(evidence == "", without).otherwise(F.concat(F.lit("Question: "), question, F.lit("\n\n"), evidence))
