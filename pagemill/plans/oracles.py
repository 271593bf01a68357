"""DuckDB SQL for the named queries, written from their meaning and not from the Spark plans."""

from __future__ import annotations

from pagemill.functions.text import CAPTION, FIGURE_CUES, ITEM, NOTE, PART, TABLE_CUES, TEXT_CUES, UNITS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
NORM = r"regexp_replace(lower(" + SQUEEZE + r"), '\d+', '#', 'g')"


def pages(footer: bool) -> str:
    text = "text || chr(10) || 'Report ' || source || ' | ' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) + 2)" if footer else "text"
    return f"""
pages AS (
  SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page, doc_id, {text} AS text
  FROM documents),
stripped AS (
  SELECT document_id, pdf_page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS ls
  FROM pages),
lines AS (
  SELECT document_id, pdf_page, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM stripped)"""


def edges(footer: bool) -> str:
    return pages(footer) + f""",
marked AS (
  SELECT *, {NORM.format("text")} AS norm, count(*) OVER (PARTITION BY document_id, pdf_page) AS n FROM lines),
edge AS (SELECT * FROM marked WHERE line_no <= 3 OR line_no > n - 3),
page_count AS (SELECT document_id, count(DISTINCT pdf_page) AS pages FROM lines GROUP BY 1),
profile AS (
  SELECT e.document_id, norm, count(*) AS occ, regexp_matches(norm, '#\\s*$') AS is_footer
  FROM edge e JOIN page_count USING (document_id)
  WHERE length(norm) >= 4 AND regexp_matches(norm, '[a-z]')
  GROUP BY e.document_id, norm, pages
  HAVING count(*) >= greatest(3, floor(pages * 0.15e0)))"""


PRINTED = f"""
WITH {edges(True)},
footer AS (
  SELECT e.document_id, e.pdf_page, e.line_no, CAST(regexp_extract(e.text, '(\\d+)\\s*$', 1) AS BIGINT) AS number
  FROM edge e JOIN profile p ON p.document_id = e.document_id AND p.norm = e.norm AND p.is_footer),
printed AS (
  SELECT l.document_id, l.pdf_page, any_value(f.number) AS printed_page
  FROM (SELECT DISTINCT document_id, pdf_page FROM lines) l
  LEFT JOIN (SELECT * FROM footer QUALIFY row_number() OVER (PARTITION BY document_id, pdf_page ORDER BY line_no DESC) = 1) f
    ON f.document_id = l.document_id AND f.pdf_page = l.pdf_page
  GROUP BY 1, 2)"""

STRIP_RUNS = """
flagged AS (
  SELECT m.*, (p.norm IS NOT NULL)::INT AS hit, CASE WHEN least(3, n // 2) = 0 THEN n ELSE least(3, n // 2) END AS most
  FROM marked m LEFT JOIN profile p ON p.document_id = m.document_id AND p.norm = m.norm),
runs AS (
  SELECT *, min(hit) OVER (PARTITION BY document_id, pdf_page ORDER BY line_no) AS head, min(hit) OVER (PARTITION BY document_id, pdf_page ORDER BY line_no DESC) AS tail
  FROM flagged)"""
STRIP_KEEPS = "NOT (head = 1 AND line_no <= most) AND NOT (tail = 1 AND n - line_no + 1 <= most)"

HEADS = f"""
raw_heads AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS document_id, n_nationkey // 10 + 1 AS pdf_page, (n_nationkey % 10 * 60)::DOUBLE AS top, n_nationkey AS ord,
         CASE n_nationkey % 7 WHEN 0 THEN 'PART I — ' || n_name WHEN 2 THEN 'Item 2. ' || n_name WHEN 4 THEN 'Note 3 – ' || n_name ELSE n_name END AS text
  FROM nation),
heads AS (
  SELECT *, CASE WHEN regexp_matches(text, {q(PART)}) THEN 'part' WHEN regexp_matches(text, {q(NOTE)}) THEN 'note'
                 WHEN regexp_matches(text, {q(ITEM)}) THEN 'item' ELSE 'subsection' END AS kind
  FROM raw_heads)"""

# A level holds the last heading that set it, unless a later one cleared it.
STATES = """
levels(level, kind, sets) AS (
  VALUES ('part', 'part', true), ('item', 'item', true), ('item', 'part', false), ('section', 'note', true), ('section', 'subsection', true),
         ('section', 'part', false), ('section', 'item', false), ('note', 'note', true), ('note', 'part', false), ('note', 'item', false))"""


def state(level: str, of: str, at: str) -> str:
    return f"""(SELECT CASE WHEN l.sets THEN h.text END FROM heads h JOIN levels l ON l.kind = h.kind AND l.level = '{level}'
     WHERE h.document_id = {of}.document_id AND (h.pdf_page, h.top) <= ({of}.pdf_page, {at}) ORDER BY h.pdf_page DESC, h.top DESC LIMIT 1) AS {level}"""


LEVELS = ("part", "item", "section", "note")
LOOKUPS = """
lookups AS (
  SELECT c_custkey, CAST(c_nationkey % 5 AS VARCHAR) AS document_id, c_custkey % 3 + 1 AS pdf_page,
         CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 10 * 60 + CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END ELSE 1e18 END::DOUBLE AS at
  FROM customer)"""
ASOF = f"WITH {HEADS}, {STATES}, {LOOKUPS}, found AS (SELECT c_custkey, pdf_page, {', '.join(state(x, 'k', 'k.at') for x in LEVELS)} FROM lookups k)"

BOXES = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS line FROM lineitem),
boxes AS (
  SELECT l_orderkey AS document_id, l_suppkey % 3 AS pdf_page, line AS box_no, l_quantity * 4 AS x0, round(l_discount * 2000) AS y0,
         l_quantity * 4 + 30 + round(l_tax * 1000) AS x1, round(l_discount * 2000) + 20 + line * 8 AS y1
  FROM li),
cols AS (SELECT document_id, box_no - 1 AS place, x0, x1 FROM boxes),
hdrs AS (
  SELECT document_id, 'H' || box_no AS label, y0 * 2 + box_no AS x0, y0 * 2 + 80 + box_no AS x1 FROM boxes WHERE box_no % 2 = 0)"""

CELLS = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS line FROM lineitem),
base AS (
  SELECT l_orderkey AS table_id, line AS row, line % 2 = 1 AS odd, CAST(l_quantity AS BIGINT) AS qty,
         CASE WHEN l_returnflag = 'R' THEN '(' || format('{:,}', CAST(trunc(l_extendedprice) AS BIGINT)) || ')' ELSE format('{:,}', CAST(trunc(l_extendedprice) AS BIGINT)) END AS price
  FROM li),
priced AS (SELECT *, CASE WHEN table_id % 11 = 0 THEN price || ' ' || price ELSE price END AS merged FROM base),
listed AS (
  SELECT table_id, row, ['Line ' || row, CASE WHEN odd THEN '$' ELSE merged END, CASE WHEN odd THEN merged ELSE '' END, ' ', '$', CAST(qty AS VARCHAR), '%'] AS ts FROM priced),
cells AS (SELECT table_id, row, unnest(range(0, 7)) AS col, unnest(ts) AS text FROM listed),
kinds AS (
  SELECT table_id, col, CASE WHEN count(*) FILTER (trim(text) <> '') = 0 THEN 'empty'
    WHEN bool_and(trim(text) IN ('', '$')) THEN 'currency' WHEN bool_and(trim(text) IN ('', '%')) THEN 'percent' ELSE 'data' END AS kind
  FROM cells GROUP BY 1, 2),
labels AS (
  SELECT o_orderkey AS table_id, unnest(range(0, 7)) AS col,
         unnest(CASE WHEN o_orderkey % 13 = 0 THEN ['', '', '', '', '', '', ''] WHEN o_orderkey % 7 = 0 THEN ['', 'Sales | 1995', 'Sales | 1995', '', '', 'Sales | 1995', '']
                ELSE ['', 'Sales | 1995', 'Sales | 1995', '', '', 'Units', ''] END) AS label
  FROM orders),
data AS (
  SELECT k.table_id, k.col, coalesce(label, '') AS label, lag(coalesce(label, '')) OVER (PARTITION BY k.table_id ORDER BY k.col) AS before
  FROM kinds k LEFT JOIN labels l ON l.table_id = k.table_id AND l.col = k.col WHERE kind = 'data'),
grouped AS (
  SELECT table_id, col, label, sum(CASE WHEN label = '' OR before IS DISTINCT FROM label THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY col) - 1 AS grp FROM data),
ends AS (SELECT table_id, grp, min(col) AS low, max(col) AS high, any_value(label) AS label FROM grouped GROUP BY 1, 2),
attached AS (
  SELECT k.table_id, k.col, CASE WHEN kind = 'currency' THEN min(grp) FILTER (low > k.col) ELSE max(grp) FILTER (high < k.col) END AS grp
  FROM kinds k JOIN ends e ON e.table_id = k.table_id WHERE kind IN ('currency', 'percent') GROUP BY k.table_id, k.col, kind),
member AS (SELECT table_id, col, grp FROM grouped UNION ALL SELECT table_id, col, grp FROM attached WHERE grp IS NOT NULL),
joined AS (
  SELECT c.table_id, c.row, m.grp, bool_or(trim(text) = '$') AS cur, bool_or(trim(text) = '%') AS pct,
         coalesce(string_agg(trim(text), ' ' ORDER BY c.col) FILTER (trim(text) NOT IN ('', '$', '%')), '') AS v
  FROM cells c JOIN member m ON m.table_id = c.table_id AND m.col = c.col GROUP BY 1, 2, 3),
valued AS (
  SELECT j.table_id, j.row, CAST(j.grp AS BIGINT) AS grp, e.label,
         CASE WHEN v = '' THEN '' ELSE CASE WHEN cur THEN '$' ELSE '' END || regexp_replace(v, '^\\(([\\d,]+(?:\\.\\d+)?)\\)$', '-\\1') || CASE WHEN pct THEN '%' ELSE '' END END AS value
  FROM joined j JOIN ends e ON e.table_id = j.table_id AND e.grp = j.grp),
collapsed AS (SELECT * FROM valued QUALIFY max(length(value)) OVER (PARTITION BY table_id, row) > 0),
rowed AS (SELECT table_id, row, list(value ORDER BY grp) AS vals, list(label ORDER BY grp) AS headers FROM collapsed GROUP BY 1, 2),
grids AS (SELECT table_id, any_value(headers) AS headers, list(vals ORDER BY row) AS rows FROM rowed GROUP BY 1),
checked AS (
  SELECT table_id, headers, rows,
         CASE WHEN len(list_filter(headers[2:], lambda h: h <> '')) = 0 THEN 'headers_unresolved'
              WHEN len(list_distinct(list_filter(headers[2:], lambda h: h <> ''))) <> len(list_filter(headers[2:], lambda h: h <> '')) THEN 'columns_ambiguous'
              WHEN len(list_filter(flatten(list_transform(rows, lambda r: r[2:])), lambda c: len(regexp_extract_all(c, '\\d[\\d,]*(?:\\.\\d+)?')) > 1)) > 0 THEN 'width_mismatch'
              ELSE 'ok' END AS validation
  FROM grids),
shown AS (
  SELECT *, array_to_string(list_concat(
      ['| ' || array_to_string(list_transform(headers, lambda h: CASE WHEN h = '' THEN ' ' ELSE replace(h, '|', '\\|') END), ' | ') || ' |',
       '|' || array_to_string(list_transform(headers, lambda h: '---'), '|') || '|'],
      list_transform(rows, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | ') || ' |')), chr(10)) AS markdown
  FROM checked)"""

TOKENS = """
raw AS (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9,\\.]*')) AS t FROM {table}),
bare AS (SELECT {id}, trim(t, '.,') AS t FROM raw),
bag AS (
  SELECT {id}, t AS term FROM bare WHERE t <> ''
  UNION ALL SELECT {id}, replace(t, ',', '') FROM bare WHERE contains(t, ',') AND replace(t, ',', '') <> ''
  UNION ALL SELECT {id}, CASE WHEN ends_with(t, 'ies') THEN t[:-4] || 'y' WHEN regexp_matches(t, '(s|x|z|ch|sh)es$') THEN t[:-3] ELSE t[:-2] END
  FROM bare WHERE length(t) >= 4 AND regexp_full_match(t, '[a-z]+')
    AND (ends_with(t, 'ies') OR regexp_matches(t, '(s|x|z|ch|sh)es$') OR (ends_with(t, 's') AND NOT regexp_matches(t, '(ss|us|is)$'))))"""
DOC_BAG = TOKENS.format(id="doc_id", text="text", table="documents")
TERMS = f"""{DOC_BAG},
posts AS (SELECT doc_id, term, count(*) AS tf FROM bag GROUP BY 1, 2),
dls AS (SELECT d.doc_id, count(b.doc_id) AS dl FROM documents d LEFT JOIN bag b ON b.doc_id = d.doc_id GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
raws AS (SELECT term, df, ln((n - df + 0.5e0) / (df + 0.5e0)) AS raw FROM dfs, corpus),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
SCORES = TERMS + ", " + TOKENS.format(id="item_id", text="text", table="benchmark").replace("raw AS", "qraw AS").replace("FROM raw)", "FROM qraw)").replace("bare AS", "qbare AS").replace("FROM bare", "FROM qbare").replace("bag AS", "qbag AS") + """,
asked AS (SELECT item_id AS question_id, term, count(*) AS qtf FROM qbag GROUP BY 1, 2),
scored AS (
  SELECT question_id, p.doc_id AS chunk_id,
         round(sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM asked a JOIN posts p ON p.term = a.term JOIN terms t ON t.term = a.term JOIN dls d ON d.doc_id = p.doc_id, corpus
  GROUP BY 1, 2)"""


def top(scores: str, k: int = 20, where: str = "true") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM {scores} WHERE {where} QUALIFY rank <= {k}"


COSINES = """
cosines AS (
  SELECT item_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0e0 AS score
  FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings v)"""
KIND = "CASE chunk_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END"


def routes(question: str) -> str:
    hit = lambda cues: f"regexp_matches({question}, {q(cues)})"
    return f"{hit(TEXT_CUES)}::INT::DOUBLE AS bias_text, {hit(TABLE_CUES)}::INT::DOUBLE AS bias_table, {hit(FIGURE_CUES)}::INT::DOUBLE AS bias_figure"


def fused(boosted: bool) -> str:
    lead = "CASE item_id % 3 WHEN 0 THEN 'Explain ' WHEN 1 THEN 'How much ' ELSE 'Which chart ' END"
    weight = f"CASE WHEN chunk_id NOT IN (SELECT doc_id FROM documents) THEN 0 ELSE CASE {KIND} WHEN 'text' THEN bias_text WHEN 'table' THEN bias_table ELSE bias_figure END END" if boosted else "0.0e0"
    return f"""{SCORES}, {COSINES}, dense AS ({top("cosines")}), lexical AS ({top("scored", where="score > 0")}),
bias AS (SELECT item_id AS question_id, {routes(lead + " || text")} FROM benchmark),
both_sides AS (
  SELECT question_id, chunk_id, d.rank AS dense_rank, x.rank AS lexical_rank,
         coalesce(1e0 / (60 + d.rank), 0) + coalesce(1e0 / (60 + x.rank), 0) AS base
  FROM dense d FULL OUTER JOIN lexical x USING (question_id, chunk_id)),
boosts AS (SELECT s.*, round(base * {weight} * 0.05e0, 12) AS boost FROM both_sides s JOIN bias USING (question_id)),
fused AS (
  SELECT question_id, chunk_id, round(base + boost, 12) AS score, boost, dense_rank, lexical_rank,
         CASE WHEN dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'lexical' END AS found_by,
         row_number() OVER (PARTITION BY question_id ORDER BY round(base + boost, 12) DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST) AS rank
  FROM boosts QUALIFY rank <= 8)"""


CHUNKS = """
chunks AS (
  SELECT d.doc_id AS chunk_id, CASE d.doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END AS content_type, text AS display_text, d.doc_id % 50 + 1 AS pdf_page,
         CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id % 50 - 1 END AS printed_page, CASE WHEN d.doc_id % 2 = 0 THEN 'Item ' || lang END AS item,
         CASE WHEN d.doc_id % 5 = 0 THEN source END AS section, CASE WHEN d.doc_id % 6 = 1 THEN '(in millions)' END AS units,
         CASE WHEN coalesce(quality, 1) = 1 THEN 'ok' ELSE 'width_mismatch' END AS validation, coalesce(toxic, 0) = 1 AS is_decorative, source AS document_id
  FROM documents d LEFT JOIN labels l USING (doc_id)),
cited AS (
  SELECT *, CASE WHEN printed_page IS NULL THEN 'PDF p. ' || pdf_page ELSE 'Page ' || printed_page || ' (PDF p. ' || pdf_page || ')' END AS citation,
         coalesce(section, item, 'Unattributed') AS location
  FROM chunks),
blocks AS (
  SELECT *, '[' || chunk_id || '] type=' || content_type || ' | ' || citation || ' | ' || location
    || coalesce(chr(10) || 'Units: ' || units, '')
    || CASE WHEN content_type = 'table' AND validation <> 'ok'
         THEN chr(10) || 'WARNING: the structure of this table is not verified (' || validation || '). Do not quote single cells as exact.' ELSE '' END
    || CASE WHEN is_decorative THEN chr(10) || 'NOTE: this image is decorative; it has no values to read.' ELSE '' END
    || chr(10) || regexp_replace(display_text, '^\\s+|\\s+$', '', 'g') AS block
  FROM cited)"""
USED = f"""WITH {fused(True)}, {CHUNKS},
hits AS (SELECT f.question_id, f.rank, b.* FROM fused f JOIN blocks b USING (chunk_id)),
uniq AS (
  SELECT * FROM hits
  QUALIFY row_number() OVER (PARTITION BY question_id, regexp_replace(display_text, '^\\s+|\\s+$', '', 'g')[:400] ORDER BY rank) = 1),
placed AS (
  SELECT *, row_number() OVER w AS place, sum(length(block)) OVER w AS chars, count(*) OVER (PARTITION BY question_id) AS n_all FROM uniq
  WINDOW w AS (PARTITION BY question_id ORDER BY list_position(['table', 'text', 'figure'], content_type), rank ROWS UNBOUNDED PRECEDING)),
used AS (SELECT *, n_all - count(*) OVER (PARTITION BY question_id) AS n_dropped FROM placed WHERE place = 1 OR chars <= 12000)"""

FIGURES = """
figs AS (
  SELECT CAST(p_partkey % 40 AS VARCHAR) AS document_id, p_partkey % 6 + 1 AS pdf_page, p_partkey AS img_no, p_size * 4 AS width, p_size * 3 AS height,
         CASE WHEN p_partkey % 4 = 0 THEN 'Figure ' || p_name END AS caption, p_type AS surrounding_text,
         CASE WHEN p_partkey % 6 > 1 THEN p_partkey % 6 - 1 END AS printed_page, p_brand AS breadcrumb
  FROM part WHERE NOT (p_size * 4 < 32 AND p_size * 3 < 32)),
described AS (
  SELECT *, caption IS NULL AND greatest(width, height) <= 120 AS is_decorative,
         CASE WHEN caption IS NULL AND greatest(width, height) <= 120 THEN 'Decorative image' ELSE 'Figure' END || ' on '
           || CASE WHEN printed_page IS NULL THEN 'PDF p. ' || pdf_page ELSE 'Page ' || printed_page || ' (PDF p. ' || pdf_page || ')' END
           || ', ' || width || 'x' || height || ' pixels.' AS descriptor
  FROM figs),
fig_texts AS (
  SELECT *, concat_ws(chr(10), 'Image / figure. ' || descriptor, caption, breadcrumb, surrounding_text[:400]) AS embed_text,
         concat_ws(chr(10) || chr(10), caption, descriptor, surrounding_text) AS display_text
  FROM described)"""
TABLE_TEXTS = f"""{CELLS},
parts AS (
  SELECT s.*, table_id % 90 + 1 AS pdf_page, o_orderpriority AS breadcrumb,
         CASE WHEN table_id % 4 = 0 THEN 'The following table shows sales (in units):' END AS caption, CASE WHEN table_id % 2 = 0 THEN '(in units)' END AS units,
         array_to_string(list_filter(headers, lambda h: h <> ''), ' | ') AS hs,
         array_to_string(list_filter(list_transform(rows, lambda r: r[1]), lambda v: v <> ''), ', ') AS ls
  FROM shown s JOIN orders o ON o.o_orderkey = s.table_id),
table_texts AS (
  SELECT *, format('orders::p{{:03d}}::table::{{}}', pdf_page, table_id) AS chunk_id,
         concat_ws(chr(10), nullif(breadcrumb, ''), caption, units, nullif(hs, ''), nullif(ls, '')) AS embed_text,
         concat_ws(chr(10) || chr(10), caption, CASE WHEN units IS NOT NULL AND NOT contains(coalesce(caption, ''), units) THEN units END, nullif(markdown, ''),
           CASE WHEN validation <> 'ok' THEN '[Structure unreliable: ' || validation || '. Refer to the page image for PDF p. ' || pdf_page || '.]' END) AS display_text
  FROM parts)"""
ALL_CHUNKS = f"""{TABLE_TEXTS}, {FIGURES},
all_chunks AS (
  SELECT source AS document_id, 'text' AS content_type, concat_ws(chr(10) || chr(10), lang, text) AS embed_text FROM documents
  UNION ALL SELECT 'orders', 'table', embed_text FROM table_texts
  UNION ALL SELECT document_id, 'figure', embed_text FROM fig_texts)"""

REPLIES = """
turns AS (SELECT *, regexp_replace(text[:60], '[^A-Za-z0-9 .]', '', 'g') AS safe FROM conversations WHERE role = 'assistant')"""

ANSWERS = """
rows AS (
  SELECT conv_id AS c, turn AS n, conv_id || '-' || turn AS id, text AS answer, conv_id % 5 = 0 AS should, (conv_id + turn) % 7 = 0 AS refused,
         CASE WHEN conv_id % 8 = 1 THEN [] ELSE [(conv_id + turn) % 9 + 1, (conv_id + turn) % 4 + 1] END AS cited,
         CASE WHEN conv_id % 5 = 0 THEN [] ELSE [conv_id % 9 + 1, conv_id % 4 + 1] END AS pages,
         CASE WHEN conv_id % 3 = 0 THEN [] ELSE [substr(text, 2, 3)] END AS expected, length(text) / 100e0 AS seconds
  FROM conversations WHERE role = 'assistant'),
marked AS (
  SELECT *, CASE WHEN should THEN 'unsupported' ELSE ['table', 'text', 'figure'][c % 3 + 1] END AS category,
         len(list_filter(expected, lambda e: NOT contains(regexp_replace(lower(answer), '[,\\s]', '', 'g'), regexp_replace(lower(e), '[,\\s]', '', 'g')))) = 0 AS has_all,
         len(list_intersect(list_distinct(cited), list_distinct(pages))) AS found,
         list_min(list_filter(range(1, len(cited) + 1), lambda i: list_contains(pages, cited[i]))) AS first
  FROM rows),
scores AS (
  SELECT *, CASE WHEN should THEN refused ELSE NOT refused AND has_all END AS correct, refused = should AS refusal_correct, should AND NOT refused AS hallucinated,
         CASE WHEN should THEN true WHEN len(pages) > 0 AND len(cited) > 0 THEN found > 0 ELSE len(pages) = 0 END AS citation_correct,
         len(cited) > 0 AS cited_any, should OR len(expected) > 0 AS graded, len(pages) > 0 AS expects, found > 0 AS hit,
         found / len(list_distinct(pages))::DOUBLE AS recall,
         CASE WHEN len(cited) = 0 THEN 0 ELSE len(list_filter(cited, lambda p: list_contains(pages, p))) / len(cited)::DOUBLE END AS prec, coalesce(1e0 / first, 0) AS rr
  FROM marked)"""


def share(value: str, where: str) -> str:
    return f"round(coalesce(avg({value}::DOUBLE) FILTER ({where}), 0), 6)"


SUMMARY = f"""count(*) AS n, {share("hit::INT", "expects")} AS hit_rate, {share("recall", "expects")} AS recall_at_k, {share("prec", "expects")} AS precision_at_k,
  {share("rr", "expects")} AS mrr, {share("correct::INT", "graded")} AS accuracy, count(*) FILTER (graded) AS n_graded,
  {share("refusal_correct::INT", "true")} AS refusal_accuracy, {share("hallucinated::INT", "should")} AS hallucination_rate,
  {share("refused::INT", "NOT should")} AS false_refusal_rate, {share("citation_correct::INT", "expects")} AS citation_accuracy,
  round(median(seconds), 6) AS median_seconds"""

FUSED_COLUMNS = "SELECT question_id, chunk_id, score, boost, dense_rank, lexical_rank, found_by, rank FROM fused"

SQL: dict[str, str] = {
    "line_normalise": f"WITH {pages(False)} SELECT document_id, pdf_page, line_no, {NORM.format('text')} AS norm FROM lines",
    "furniture_profile": f"WITH {edges(False)} SELECT * FROM profile",
    "furniture_strip": f"WITH {edges(True)}, {STRIP_RUNS} SELECT document_id, pdf_page, line_no, text FROM runs WHERE {STRIP_KEEPS}",
    "printed_page": f"{PRINTED} SELECT * FROM printed",
    "page_offset": f"{PRINTED} SELECT document_id, CASE WHEN count(DISTINCT pdf_page - printed_page) = 1 THEN max(pdf_page - printed_page) END AS page_offset FROM printed GROUP BY 1",
    "heading_classify": f"WITH {HEADS} SELECT ord::BIGINT AS ord, text, kind FROM heads",
    "section_state": f"WITH {HEADS}, {STATES} SELECT k.document_id, k.pdf_page::BIGINT AS pdf_page, k.top, {', '.join(state(x, 'k', 'k.top') for x in LEVELS)} FROM heads k",
    "section_asof": f"{ASOF} SELECT c_custkey, part, item, section, note FROM found",
    "provenance_labels": f"""{ASOF}
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Page ' || (pdf_page + 7) || ' (PDF p. ' || pdf_page || ')' ELSE 'PDF p. ' || pdf_page END AS citation,
       coalesce(note, section, item, part, 'Unattributed') AS location,
       concat_ws(' > ', part, item, note, CASE WHEN section IS DISTINCT FROM note THEN section END) AS breadcrumb
FROM found""",
    "region_antijoin": f"""WITH {BOXES}
SELECT document_id, box_no, x0, y0, x1, y1 FROM boxes b WHERE box_no > 2 AND NOT EXISTS (
  SELECT 1 FROM boxes r WHERE r.box_no <= 2 AND r.document_id = b.document_id AND r.pdf_page = b.pdf_page
    AND greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) > 0.5e0 * (b.x1 - b.x0) * (b.y1 - b.y0))""",
    "table_floor": f"""WITH {BOXES}
SELECT b.document_id, b.box_no AS table_no, max(o.y1) AS floor
FROM boxes b LEFT JOIN boxes o ON o.document_id = b.document_id AND o.pdf_page = b.pdf_page AND o.box_no <> b.box_no AND o.y1 <= b.y0
GROUP BY b.document_id, b.pdf_page, b.box_no""",
    "header_assign": f"""WITH {BOXES},
firsts AS (SELECT *, x0 <= min(x0) OVER (PARTITION BY document_id) + 6 AS is_label FROM cols),
pairs AS (
  SELECT c.document_id, c.place, h.label, least(c.x1, h.x1) - greatest(c.x0, h.x0) AS overlap, h.x0 AS hx
  FROM firsts c JOIN hdrs h ON h.document_id = c.document_id WHERE NOT is_label),
best AS (
  SELECT * FROM pairs WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY document_id, place ORDER BY overlap DESC, hx, label) = 1)
SELECT c.document_id, c.place, coalesce(b.label, '') AS label FROM cols c LEFT JOIN best b ON b.document_id = c.document_id AND b.place = c.place""",
    "header_groups": f"""WITH {BOXES},
bounds AS (
  SELECT *, (x1 + lead(x0) OVER w) / 2 AS high, row_number() OVER w AS i, count(*) OVER (PARTITION BY document_id) AS m FROM hdrs WINDOW w AS (PARTITION BY document_id ORDER BY x0, x1, label)),
firsts AS (
  SELECT c.document_id, c.place, coalesce(min(b.i) FILTER (b.high IS NULL OR (c.x0 + c.x1) / 2 <= b.high), max(m)) AS i
  FROM cols c LEFT JOIN bounds b ON b.document_id = c.document_id GROUP BY 1, 2)
SELECT f.document_id, 'C' || f.place AS label, b.label AS grp, CASE WHEN b.label IS NULL THEN 'C' || f.place ELSE b.label || ' | C' || f.place END AS full_label
FROM firsts f LEFT JOIN bounds b ON b.document_id = f.document_id AND b.i = f.i""",
    "column_classify": f"WITH {CELLS} SELECT * FROM kinds",
    "table_collapse": f"WITH {CELLS} SELECT table_id, row, grp, label, value FROM collapsed",
    "table_validate": f"WITH {CELLS} SELECT table_id, validation, 7::BIGINT AS raw_column_count, len(headers)::BIGINT AS n_columns FROM checked",
    "table_markdown": f"WITH {CELLS} SELECT table_id, markdown FROM shown",
    "table_records": f"""WITH {CELLS},
keyed AS (
  SELECT c.table_id, dense_rank() OVER (PARTITION BY c.table_id ORDER BY row) - 1 AS pos, grp, CASE WHEN grp = 0 THEN 'label' WHEN label = '' THEN 'column_' || grp ELSE label END AS k, value FROM collapsed c),
lasts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY table_id, pos, k ORDER BY grp DESC) = 1)
SELECT table_id, pos, string_agg(k || '=' || value, ';' ORDER BY k) AS record FROM lasts GROUP BY 1, 2""",
    "units_caption": f"""WITH bands AS (
  SELECT doc_id, {SQUEEZE.format("CASE WHEN doc_id % 3 = 0 THEN text ELSE 'The following table shows ' || text[:30] || ': (In Millions, except' || lang || ') ' || text || ' (in units)' END")} AS band
  FROM documents)
SELECT doc_id, regexp_extract_all(band, {q(CAPTION)})[-1] AS caption, regexp_extract_all(band, {q(UNITS)})[-1] AS units FROM bands""",
    "figure_flags": f"WITH {FIGURES} SELECT document_id, img_no, is_decorative, embed_text, display_text FROM fig_texts",
    "figure_inventory": f"""WITH {FIGURES},
docs AS (SELECT CAST(range AS VARCHAR) AS document_id FROM range(60)),
counts AS (
  SELECT document_id, count(*) AS total, count(*) FILTER (is_decorative) AS decorative, min(pdf_page) AS first FROM described GROUP BY 1),
wheres AS (
  SELECT document_id, string_agg(CASE WHEN printed_page IS NULL THEN 'PDF page ' || pdf_page ELSE 'page ' || printed_page END, ', ' ORDER BY pdf_page) AS places
  FROM (SELECT DISTINCT document_id, pdf_page, printed_page FROM described) GROUP BY 1)
SELECT document_id || '::document::figure-inventory' AS chunk_id, coalesce(first, 1)::BIGINT AS pdf_page, coalesce(total, 0) AS total, coalesce(decorative, 0) AS decorative,
  CASE WHEN total IS NULL THEN 'Figure inventory. Embedded images: 0, on none of 6 pages. There is no figure, chart, graph, diagram or picture here.'
  ELSE 'Figure inventory. Embedded images: ' || total || ', in a document of 6 pages. Found on: ' || places || '. Of these, decoration only: ' || decorative || '.'
    || CASE WHEN decorative = total THEN ' No figure, chart, graph or diagram with data is among them.' ELSE '' END END AS text
FROM docs LEFT JOIN counts USING (document_id) LEFT JOIN wheres USING (document_id)""",
    "table_chunk_text": f"WITH {TABLE_TEXTS} SELECT chunk_id, embed_text, display_text FROM table_texts",
    "chunk_order": f"""WITH {FIGURES},
named AS (
  SELECT source AS document_id, doc_id % 50 + 1 AS pdf_page, 'text' AS kind, doc_id AS number FROM documents
  UNION ALL SELECT 'orders', o_orderkey % 90 + 1, 'table', o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT document_id, pdf_page, 'figure', row_number() OVER (PARTITION BY document_id ORDER BY pdf_page, img_no) - 1 FROM described)
SELECT document_id || '::p' || CASE WHEN pdf_page < 100 THEN lpad(pdf_page::VARCHAR, 3, '0') ELSE pdf_page::VARCHAR END || '::' || kind || '::' || number AS chunk_id,
       row_number() OVER (PARTITION BY document_id ORDER BY pdf_page, kind, number) - 1 AS ordinal
FROM named""",
    "table_number": f"""WITH {BOXES}
SELECT document_id, pdf_page::BIGINT AS pdf_page, row_number() OVER (PARTITION BY document_id, pdf_page ORDER BY y0, x0, y1, x1) - 1 AS table_no, x0, y0, x1, y1 FROM boxes""",
    "header_spans": f"""WITH {BOXES}
SELECT document_id AS table_id, box_no AS col, row_number() OVER (PARTITION BY document_id ORDER BY box_no) - 1 AS place, x0, x1 FROM boxes WHERE box_no <> 3""",
    "chunk_union": f"WITH {ALL_CHUNKS} SELECT document_id, content_type, count(*) AS n, sum(length(embed_text))::BIGINT AS chars FROM all_chunks GROUP BY 1, 2",
    "ingest_report": f"""WITH {ALL_CHUNKS},
c AS (
  SELECT document_id, count(*) FILTER (content_type = 'text') AS text_chunks, count(*) FILTER (content_type = 'table') AS table_chunks, count(*) FILTER (content_type = 'figure') AS figure_chunks
  FROM all_chunks GROUP BY 1),
t AS (
  SELECT 'orders' AS document_id, count(*) AS tables, count(*) FILTER (validation = 'ok') AS tables_ok, count(*) * 7 AS raw_columns, sum(len(headers))::BIGINT AS columns,
         count(caption) AS captions, count(units) AS units FROM table_texts),
v AS (SELECT validation, count(*) AS n FROM table_texts WHERE validation <> 'ok' GROUP BY 1),
f AS (SELECT document_id, count(*) AS figures, count(*) FILTER (is_decorative) AS decorative FROM described GROUP BY 1)
SELECT document_id, text_chunks, table_chunks, figure_chunks, coalesce(tables, 0) AS tables, coalesce(tables_ok, 0) AS tables_ok, coalesce(raw_columns, 0) AS raw_columns,
       coalesce(columns, 0) AS columns, coalesce(captions, 0) AS captions, coalesce(units, 0) AS units, coalesce(figures, 0) AS figures, coalesce(decorative, 0) AS decorative,
       CASE WHEN tables IS NULL THEN '{{}}' ELSE (SELECT '{{' || string_agg('"' || validation || '":' || n, ',' ORDER BY validation) || '}}' FROM v) END AS flagged
FROM c LEFT JOIN t USING (document_id) LEFT JOIN f USING (document_id)""",
    "tokenize_stats": f"WITH {DOC_BAG} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, max(term) AS last_term FROM bag GROUP BY 1",
    "term_stats": f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {SCORES} {top('scored', where='score > 0')}",
    "bm25_filtered": f"WITH {SCORES} {top('scored', where='score > 0 AND chunk_id % 3 = 1')}",
    "cosine_topk": f"WITH {COSINES} {top('cosines')}",
    "cosine_filtered": f"WITH {COSINES} {top('cosines', where='chunk_id % 3 = 1')}",
    "route_bias": f"""WITH asked AS (
  SELECT 'b' || item_id AS question_id, text AS question FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'p' || p_partkey, ['How  much did ', 'Explain ', 'Show the chart of ', 'Show charts of ', 'Why did total ', 'Was 1,234,567 '][p_partkey % 6 + 1]
    || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' cost?' ELSE '?' END FROM part),
routed AS (SELECT question_id, {routes("question")} FROM asked)
SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN bias_text > 0 THEN 'text' END, CASE WHEN bias_table > 0 THEN 'table' END, CASE WHEN bias_figure > 0 THEN 'figure' END), ''), 'no preference') AS routed_to
FROM routed""",
    "rrf_fuse": f"WITH {fused(False)} {FUSED_COLUMNS}",
    "rrf_boosted": f"WITH {fused(True)} {FUSED_COLUMNS}",
    "content_mix": f"""WITH {fused(True)},
mix AS (SELECT question_id, {KIND} AS kind, count(*) AS n FROM fused JOIN documents ON doc_id = chunk_id GROUP BY 1, 2)
SELECT question_id, string_agg(kind || '=' || n, ', ' ORDER BY kind) AS mix FROM mix GROUP BY 1""",
    "context_dedup": f"{USED} SELECT question_id, chunk_id, rank FROM uniq",
    "evidence_block": f"WITH {CHUNKS} SELECT chunk_id, block FROM blocks",
    "context_budget": f"{USED} SELECT question_id, chunk_id, place, n_dropped FROM used",
    "cited_evidence": f"{USED} SELECT question_id, chunk_id, place % 2 = 1 AS cited FROM used",
    "context_text": f"""{USED},
texts AS (SELECT question_id, '<<<EVIDENCE' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) || chr(10) || 'EVIDENCE>>>' AS evidence, count(*) AS n_used, max(n_dropped) AS n_dropped FROM used GROUP BY 1)
SELECT question_id, md5(evidence) AS evidence_md5, n_used, n_dropped, length(evidence) AS characters FROM texts""",
    "vision_pick": f"""{USED},
wanted AS (
  SELECT question_id, document_id, pdf_page, min(place) AS place FROM used
  WHERE (content_type = 'figure' AND NOT is_decorative) OR (content_type = 'table' AND validation <> 'ok') GROUP BY 1, 2, 3)
SELECT question_id, document_id, pdf_page, place FROM wanted QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY place) <= 2""",
    "source_list": f"""{USED},
flagged AS (SELECT *, question_id % 2 = 0 AND place % 2 = 1 AS is_cited FROM used),
kept AS (SELECT * FROM flagged QUALIFY is_cited OR NOT bool_or(is_cited) OVER (PARTITION BY question_id)),
listed AS (
  SELECT question_id, 'Sources:' || chr(10) || string_agg('  - ' || citation || ' — ' || content_type || ' — ' || location
    || CASE WHEN content_type = 'table' AND validation <> 'ok' THEN '  [structure unverified]' WHEN content_type = 'figure' AND is_decorative THEN '  [decorative image]' ELSE '' END,
    chr(10) ORDER BY pdf_page, rank) AS sources FROM kept GROUP BY 1)
SELECT item_id AS question_id, coalesce(sources, 'Sources: none — no supporting evidence was retrieved.') AS sources FROM benchmark LEFT JOIN listed ON question_id = item_id""",
    "reply_parse": f"""WITH {REPLIES}
SELECT conv_id, turn,
  CASE WHEN conv_id % 6 IN (3, 4) THEN 'The reply of the model could not be read. Please try again.'
       WHEN conv_id % 6 = 2 OR trim(safe) = '' THEN 'No answer was produced.' ELSE trim(safe) END AS answer,
  conv_id % 6 IN (1, 2, 3, 4) OR trim(safe) = '' AS refused,
  CASE conv_id % 6 WHEN 0 THEN 'a,b' WHEN 2 THEN 'c' ELSE '' END AS cited
FROM turns""",
    "contains_all": """WITH t AS (SELECT *, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS w FROM conversations),
k AS (
  SELECT conv_id, turn, regexp_replace(lower(text), '[,\\s]', '', 'g') AS hay,
         list_transform([w[1], coalesce(w[4], '')], lambda x: regexp_replace(lower(x), '[,\\s]', '', 'g')) AS keys
  FROM t WHERE role = 'assistant' AND w IS NOT NULL)
SELECT conv_id, turn, contains(hay, keys[1]) AND contains(hay, keys[2]) AS has_all FROM k""",
    "retrieval_score": f"""WITH {fused(False)},
truth AS (SELECT item_id AS question_id, list(DISTINCT doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text)) GROUP BY 1),
lists AS (SELECT question_id, list(chunk_id ORDER BY rank) AS retrieved FROM fused GROUP BY 1),
both_lists AS (
  SELECT item_id AS question_id, coalesce(retrieved, []) AS r, coalesce(expected, []) AS e
  FROM benchmark b LEFT JOIN lists l ON l.question_id = b.item_id LEFT JOIN truth t ON t.question_id = b.item_id),
firsts AS (SELECT *, list_min(list_filter(range(1, len(r) + 1), lambda i: list_contains(e, r[i]))) AS first FROM both_lists)
SELECT question_id, len(e) = 0 OR first IS NOT NULL AS hit,
  round(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, r)) / len(e)::DOUBLE END, 6) AS recall,
  round(CASE WHEN len(e) = 0 THEN 1 WHEN len(r) = 0 THEN 0 ELSE len(list_filter(r, lambda x: list_contains(e, x))) / len(r)::DOUBLE END, 6) AS precision,
  round(CASE WHEN len(e) = 0 THEN 1 ELSE coalesce(1e0 / first, 0) END, 6) AS reciprocal_rank, first AS first_rank
FROM firsts""",
    "answer_score": f"WITH {ANSWERS} SELECT c AS conv_id, n AS turn, correct, refusal_correct, hallucinated, citation_correct, cited_any, graded FROM scores",
    "eval_summary": f"WITH {ANSWERS} SELECT {SUMMARY} FROM scores",
    "eval_by_category": f"WITH {ANSWERS} SELECT category, {SUMMARY} FROM scores GROUP BY 1",
    "eval_failures": f"""WITH {ANSWERS}
SELECT id, category, CASE WHEN hallucinated THEN 'hallucinated' WHEN refused THEN 'refused a supported question' ELSE 'wrong or missing value' END AS reason
FROM scores WHERE NOT correct OR NOT refusal_correct""",
    "index_upsert": """WITH merged AS (
  SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'v2 ' || text ELSE text END AS t FROM documents
  UNION ALL SELECT doc_id || '-new', text FROM documents WHERE doc_id % 10 = 3)
SELECT chunk_id, length(t) AS n, md5(t) AS text_md5 FROM merged""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}


def tail_sql(text: str, size: int = 150) -> str:
    window = f"right({text}, {size})"
    cuts = " ".join(f"WHEN contains({window}, {q(c)}) THEN substr({window}, strpos({window}, {q(c)}) + {len(c)})" for c in (". ", "; ", ", ", " "))
    return f"CASE WHEN length({text}) <= {size} THEN {text} {cuts} ELSE {window} END"


# The folds as recursion: one step for each block or fragment of a run, all runs at once.
SQL["chunk_pack"] = f"""
WITH RECURSIVE {pages(False)},
blocks AS (SELECT *, line_no // 7 AS run, row_number() OVER (PARTITION BY document_id, pdf_page, line_no // 7 ORDER BY line_no) AS i FROM lines),
fold AS (
  SELECT DISTINCT document_id, pdf_page, run, 0::BIGINT AS i, ''::VARCHAR AS joined, 0::BIGINT AS n, NULL::BIGINT AS anchor, NULL::BIGINT AS out_anchor, NULL::VARCHAR AS body FROM blocks
  UNION ALL
  SELECT document_id, pdf_page, run, i, CASE WHEN joined = '' THEN text WHEN NOT is_full THEN joined || ' ' || text WHEN carried = '' THEN text ELSE carried || ' ' || text END,
         CASE WHEN is_full THEN length(carried) + length(text) + 1 ELSE n + length(text) + 1 END, CASE WHEN is_full THEN line_no ELSE coalesce(anchor, line_no) END,
         CASE WHEN is_full THEN anchor END, CASE WHEN is_full THEN joined END
  FROM (SELECT f.document_id, f.pdf_page, f.run, b.i, joined, n, anchor, text, line_no, joined <> '' AND n + length(text) > 900 AS is_full, {tail_sql("joined")} AS carried
        FROM fold f JOIN blocks b ON b.document_id = f.document_id AND b.pdf_page = f.pdf_page AND b.run = f.run AND b.i = f.i + 1)),
ended AS (SELECT * FROM fold QUALIFY i = max(i) OVER (PARTITION BY document_id, pdf_page, run)),
packed AS (
  SELECT document_id, pdf_page, out_anchor AS anchor, trim(body) AS body FROM fold WHERE body IS NOT NULL
  UNION ALL SELECT document_id, pdf_page, anchor, trim(joined) FROM ended)
SELECT document_id, pdf_page::INT AS pdf_page, (row_number() OVER (PARTITION BY document_id, pdf_page ORDER BY anchor) - 1)::INT AS chunk_no, anchor, body
FROM packed WHERE length(body) >= 50"""

BOX_FRAGMENTS = f"""{BOXES},
frags AS (SELECT document_id, 'f' || box_no AS text, x0, x0 + 40 AS x1, y0 / 20 AS y FROM boxes)"""
ROW_FOLD = """
seq AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY y, x0, x1, text) AS i FROM frags),
row_fold AS (
  SELECT document_id, i, 0::BIGINT AS row, y AS first, y, x0, x1, text FROM seq WHERE i = 1
  UNION ALL
  SELECT s.document_id, s.i, CASE WHEN abs(s.y - f.first) <= 3 THEN f.row ELSE f.row + 1 END, CASE WHEN abs(s.y - f.first) <= 3 THEN f.first ELSE s.y END, s.y, s.x0, s.x1, s.text
  FROM row_fold f JOIN seq s ON s.document_id = f.document_id AND s.i = f.i + 1)"""
SQL["header_rows"] = f"WITH RECURSIVE {BOX_FRAGMENTS}, {ROW_FOLD} SELECT document_id, row, string_agg(text, ' ' ORDER BY x0, i) AS row_text FROM row_fold GROUP BY 1, 2"
HEADER_COLUMNS = """
sized AS (SELECT *, count(*) OVER (PARTITION BY document_id, row) AS m FROM row_fold),
kept AS (SELECT *, max(m) OVER (PARTITION BY document_id) AS widest, min(row) OVER (PARTITION BY document_id) AS top, max(row) OVER (PARTITION BY document_id) AS bottom FROM sized WHERE m >= 2),
kept2 AS (SELECT *, max(CASE WHEN row = top THEN m END) OVER (PARTITION BY document_id) AS m_top FROM kept),
body AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY row, x0, i) AS k FROM kept2 WHERE NOT (bottom > top AND row = top AND m_top < widest)),
tops AS (SELECT document_id, text AS label, x0, x1 FROM kept2 WHERE bottom > top AND row = top AND m_top < widest),
col_fold AS (
  SELECT document_id, k, [[{'x0': x0, 'x1': x1, 't': text}]] AS cols FROM body WHERE k = 1
  UNION ALL
  SELECT document_id, k, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(cols, [f]) ELSE list_concat(list_concat(cols[1:pos - 1], [list_append(cols[pos], f)]), cols[pos + 1:]) END
  FROM (SELECT c.document_id, b.k, cols, {'x0': b.x0, 'x1': b.x1, 't': b.text} AS f,
               list_position(list_transform(cols, lambda c: len(list_filter(c, lambda e: e.x0 < b.x1 AND b.x0 < e.x1)) > 0), true) AS pos
        FROM col_fold c JOIN body b ON b.document_id = c.document_id AND b.k = c.k + 1)),
done AS (SELECT document_id, unnest(cols) AS c FROM (SELECT * FROM col_fold QUALIFY k = max(k) OVER (PARTITION BY document_id))),
leaves AS (
  SELECT document_id, row_number() OVER () AS leaf, array_to_string(list_transform(c, lambda e: e.t), ' ') AS label,
         list_min(list_transform(c, lambda e: e.x0)) AS x0, list_max(list_transform(c, lambda e: e.x1)) AS x1 FROM done),
bounds AS (
  SELECT *, (x1 + lead(x0) OVER w) / 2 AS high, row_number() OVER w AS i, count(*) OVER (PARTITION BY document_id) AS n FROM tops WINDOW w AS (PARTITION BY document_id ORDER BY x0, x1, label)),
firsts AS (
  SELECT l.leaf, any_value(l.document_id) AS document_id, any_value(l.label) AS label, any_value(l.x0) AS x0, any_value(l.x1) AS x1,
         coalesce(min(b.i) FILTER (b.high IS NULL OR (l.x0 + l.x1) / 2 <= b.high), max(n)) AS i
  FROM leaves l LEFT JOIN bounds b ON b.document_id = l.document_id GROUP BY l.leaf)
SELECT f.document_id, f.label, f.x0, f.x1, b.label AS grp FROM firsts f LEFT JOIN bounds b ON b.document_id = f.document_id AND b.i = f.i"""
SQL["header_columns"] = f"WITH RECURSIVE {BOX_FRAGMENTS}, {ROW_FOLD}, {HEADER_COLUMNS}"

# Orders with one table at 0..360 by 150..180 and lines around it; every third knows a floor at 100.
BAND = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS line FROM lineitem),
around AS (
  SELECT l_orderkey AS document_id, line AS line_no, l_quantity * 8 AS x0, round(l_discount * 2000) AS y0, l_quantity * 8 + CASE WHEN line % 4 = 2 THEN 200 ELSE 40 END AS x1,
         CASE line % 4 WHEN 1 THEN 'h' || line WHEN 2 THEN 'The following table shows lot ' || line || ':' WHEN 3 THEN '(in units)' ELSE 'Figure ' || line || ' of sales' END AS text,
         CASE WHEN l_orderkey % 3 = 0 THEN 100 ELSE 0 END AS floor
  FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
beside AS (SELECT * FROM around WHERE x1 >= -5 AND x0 <= 365 AND y0 < 149),
frags AS (SELECT document_id, text, x0, x1, y0 AS y FROM beside WHERE y0 >= greatest(80, floor) AND x1 - x0 <= 0.35e0 * 360)"""
SQL["header_band"] = f"WITH {BAND} SELECT * FROM frags"
SQL["header_recover"] = f"WITH RECURSIVE {BAND}, {ROW_FOLD}, {HEADER_COLUMNS}"
SQL["table_context"] = f"""WITH {BAND},
joined AS (SELECT document_id, string_agg(text, ' ' ORDER BY line_no) AS band FROM beside WHERE y0 >= floor GROUP BY 1)
SELECT document_id, regexp_extract_all(band, {q(CAPTION)})[-1] AS caption, regexp_extract_all(band, {q(UNITS)})[-1] AS units FROM joined"""
SQL["figure_context"] = f"""WITH {BAND},
images AS (SELECT o_orderkey AS document_id, o_orderkey % 50 * 5 AS width, o_custkey % 30 * 5 AS height FROM orders WHERE NOT (o_orderkey % 50 * 5 < 32 AND o_custkey % 30 * 5 < 32)),
near AS (
  SELECT document_id, string_agg(text, ' ' ORDER BY line_no) AS words, min_by(text, line_no) FILTER (starts_with(text, 'Figure')) AS caption
  FROM around WHERE y0 + 10 >= 40 AND y0 <= 180 GROUP BY 1)
SELECT document_id, caption, coalesce(words, '') AS surrounding_text, caption IS NULL AND greatest(width, height) <= 120 AS is_decorative FROM images LEFT JOIN near USING (document_id)"""

SPANS = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS line FROM lineitem),
lined AS (
  SELECT CAST(l_orderkey % 50 AS VARCHAR) AS document_id, l_orderkey AS pdf_page, (line - 1) // 2 AS block_no, line AS line_no, l_quantity * 4 AS x0, round(l_discount * 2000) AS y0,
         l_quantity * 4 + 30 + round(l_tax * 1000) AS x1, round(l_discount * 2000) + 20 AS y1, line % 3 + 7 AS size, l_returnflag <> 'N' AND l_linestatus = 'F' AS bold,
         CASE line % 5 WHEN 0 THEN 'Item 2. ' WHEN 1 THEN 'Note 3 – ' ELSE 'Lot 4 ' END || l_returnflag || l_linestatus || ' of ' || l_partkey % 7 AS text
  FROM li),
marked AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '#', 'g') IN ('lot # nf of #', 'item #. ro of #') AS gone FROM lined)"""
SQL["heading_scan"] = f"""WITH {SPANS}
SELECT document_id, pdf_page, y0 AS top, text, CASE WHEN starts_with(text, 'Item') THEN 'item' WHEN starts_with(text, 'Note') THEN 'note' ELSE 'subsection' END AS kind, size::DOUBLE AS size
FROM marked WHERE bold AND size >= 8 AND NOT gone"""
SQL["span_lines"] = f"WITH {SPANS} SELECT document_id, pdf_page, block_no, line_no, text, x0, y0, x1, y1 FROM lined"
SQL["text_blocks"] = f"""WITH {SPANS},
boxed AS (
  SELECT document_id, pdf_page, block_no, line_no, text, gone, min(x0) OVER w AS x0, min(y0) OVER w AS y0, max(x1) OVER w AS x1, max(y1) OVER w AS y1
  FROM marked WINDOW w AS (PARTITION BY document_id, pdf_page, block_no)),
free AS (
  SELECT b.* FROM boxed b JOIN lined r ON r.document_id = b.document_id AND r.pdf_page = b.pdf_page AND r.line_no = 1
  WHERE NOT b.gone AND greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) <= 0.5e0 * (b.x1 - b.x0) * (b.y1 - b.y0))
SELECT document_id, pdf_page, block_no, string_agg(text, ' ' ORDER BY line_no) AS text, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1 FROM free GROUP BY 1, 2, 3"""

SQL["page_records"] = f"""{PRINTED}, {STRIP_RUNS},
left_over AS (SELECT document_id, pdf_page, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS body FROM runs WHERE {STRIP_KEEPS} GROUP BY 1, 2),
counted AS (SELECT document_id, pdf_page, count(*) AS raw_line_count FROM lines GROUP BY 1, 2)
SELECT document_id, pdf_page, printed_page, raw_line_count, coalesce(n_lines, 0) AS n_lines, md5(coalesce(body, '')) AS text_md5
FROM counted JOIN printed USING (document_id, pdf_page) LEFT JOIN left_over USING (document_id, pdf_page)"""
SQL["embed_batches"] = "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{v}', '')) AS n_{v}" for v in "aeiou") + " FROM documents"
SQL["prompt_text"] = f"""{USED},
texts AS (SELECT question_id, '<<<EVIDENCE' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) || chr(10) || 'EVIDENCE>>>' AS evidence FROM used WHERE question_id % 2 = 1 GROUP BY 1)
SELECT item_id AS question_id, md5('Question: ' || text || chr(10) || chr(10) || coalesce(evidence, 'Nothing was retrieved for this question. Say that the documents do not answer it.')) AS prompt_md5
FROM benchmark LEFT JOIN texts ON question_id = item_id"""
SQL["answer_flow"] = f"""{USED},
shown AS (SELECT * FROM used WHERE question_id % 5 <> 0),
listed AS (
  SELECT question_id, count(*) AS n, min_by(citation, place) AS first_citation,
         bool_or((content_type = 'figure' AND NOT is_decorative) OR (content_type = 'table' AND validation <> 'ok')) AS vision,
         'Sources:' || chr(10) || string_agg('  - ' || citation || ' — ' || content_type || ' — ' || location
           || CASE WHEN content_type = 'table' AND validation <> 'ok' THEN '  [structure unverified]' WHEN content_type = 'figure' AND is_decorative THEN '  [decorative image]' ELSE '' END,
           chr(10) ORDER BY pdf_page, rank) AS sources
  FROM shown GROUP BY 1),
kinds AS (SELECT question_id, content_type, count(*) AS m FROM hits WHERE question_id % 5 <> 0 GROUP BY 1, 2),
mixes AS (SELECT question_id, sum(m)::BIGINT AS n_hits, string_agg(content_type || '=' || m, ', ' ORDER BY content_type) AS mix FROM kinds GROUP BY 1),
named AS (
  SELECT item_id AS question_id, {routes("text")} FROM benchmark),
parts AS (
  SELECT b.question_id, coalesce(n, 0) AS n, coalesce(vision, false) AS vision, coalesce(n_hits, 0) AS n_hits, coalesce(mix, 'none') AS mix, first_citation,
         coalesce(sources, 'Sources: none — no supporting evidence was retrieved.') AS sources,
         coalesce(nullif(concat_ws(', ', CASE WHEN bias_text > 0 THEN 'text' END, CASE WHEN bias_table > 0 THEN 'table' END, CASE WHEN bias_figure > 0 THEN 'figure' END), ''), 'no preference') AS routed
  FROM named b LEFT JOIN listed USING (question_id) LEFT JOIN mixes USING (question_id))
SELECT question_id, n || ' sources' AS answer, n = 0 AS refused, CASE WHEN vision THEN 'vision' ELSE 'text' END AS model, n_hits, n AS n_cited, first_citation,
       md5(CASE WHEN n = 0 THEN 'No supported answer found.' || chr(10) || chr(10) ELSE '' END || n || ' sources' || chr(10) || chr(10) || sources || chr(10) || chr(10)
         || '[' || CASE WHEN vision THEN 'vision' ELSE 'text' END || ' | routed: ' || routed || ' | vision: ' || vision || ' | ' || n_hits || ' chunks (' || mix || ')]') AS rendered_md5
FROM parts"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
