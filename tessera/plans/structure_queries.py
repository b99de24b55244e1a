"""Queries on the structure of laws, over lines, grids and spans made from the tables. The SQL knows from how a row was made what it is, and follows
the lines one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import structure as s
from tessera.plans.fixtures import NUMBERED, Made
from tessera.plans.registering import Book
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

_NTH = f"SELECT concat('S', CAST(l_suppkey AS STRING)) AS law, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, k) AS BIGINT) AS ord, CAST(l_quantity AS INT) % 9 AS what, CAST(l_partkey % 3 AS INT) + 1 AS r FROM {NUMBERED}"
#: A law for each supplier: headings whose numbers mostly go up, chapters, parts, divisions with and without words, titles, plain lines.
LAW = Made(f"""SELECT law, ord, what, r, num, CAST(floor(ord / 12) AS INT) AS page, what < 5 AS bold, what BETWEEN 1 AND 4 AS centred,
    CASE what WHEN 0 THEN concat(num, '. Heading of ', r, '.—Text') WHEN 1 THEN concat('CHAPTER ', repeat('I', r)) WHEN 2 THEN concat('[PART-', repeat('X', r), ']') WHEN 3 THEN concat('Division ', repeat('V', r), CASE WHEN r = 2 THEN ' OF THE WORDS' ELSE '' END)
      WHEN 4 THEN concat('[TITLE OF ', r, ']') ELSE concat('plain text of line ', ord) END AS text FROM (SELECT *, CAST(greatest(1, ord % 900 - CASE WHEN ord % 7 = 0 THEN 20 ELSE 0 END) AS INT) AS num FROM ({_NTH}) a) b""")
HEADERS = Made(f"""SELECT DISTINCT law, CAST(floor(ord / 12) AS INT) AS page, CASE WHEN CAST(floor(ord / 12) AS INT) % 4 = 3 THEN 'a title that goes on' ELSE concat('CHAPTER ', repeat('I', CAST(floor(ord / 96) AS INT) % 3 + 1)) END AS header FROM ({_NTH}) a""")


@book.query(f"""WITH RECURSIVE x AS (SELECT l.*, CASE WHEN header LIKE 'CHAPTER%' THEN header END AS ch FROM {LAW.duck()} l JOIN {HEADERS.duck()} h USING (law, page)),
    f AS (SELECT DISTINCT law, 0::BIGINT AS ord, NULL::VARCHAR AS chapter, NULL::VARCHAR AS part, NULL::VARCHAR AS division, []::VARCHAR[] AS pt, []::VARCHAR[] AS dt, NULL::VARCHAR AS coll, 0 AS top, NULL::INTEGER AS opened FROM x
      UNION ALL SELECT law, ord, chapter, CASE what WHEN 1 THEN NULL WHEN 2 THEN 'Part ' || repeat('X', r) ELSE part END, CASE WHEN what IN (1, 2) THEN NULL WHEN what = 3 THEN 'Division ' || repeat('V', r) ELSE division END,
        CASE WHEN what IN (1, 2) THEN [] WHEN what = 4 AND coll = 'part' THEN list_append(pt, 'Title of ' || r) ELSE pt END, CASE WHEN what IN (1, 2) THEN [] WHEN what = 3 THEN CASE WHEN r = 2 THEN ['Of the Words'] ELSE [] END WHEN what = 4 AND coll = 'division' THEN list_append(dt, 'Title of ' || r) ELSE dt END,
        CASE WHEN what = 2 THEN 'part' WHEN what = 3 THEN 'division' WHEN what = 1 OR (what = 0 AND num > top) THEN NULL ELSE coll END, CASE WHEN what = 0 AND num > top THEN num ELSE top END, CASE WHEN what = 0 AND num > top THEN num END
      FROM (SELECT x.law, x.ord, what, r, num, top, coalesce(ch, chapter) AS chapter, CASE WHEN n THEN NULL ELSE part END AS part, CASE WHEN n THEN NULL ELSE division END AS division, CASE WHEN n THEN [] ELSE pt END AS pt, CASE WHEN n THEN [] ELSE dt END AS dt, CASE WHEN n THEN NULL ELSE coll END AS coll
        FROM (SELECT x.*, f.chapter, f.part, f.division, f.pt, f.dt, f.coll, f.top, ch IS NOT NULL AND ch IS DISTINCT FROM f.chapter AS n FROM f JOIN x ON x.law = f.law AND x.ord = f.ord + 1) x) y)
    SELECT law, ord, opened::VARCHAR AS section, chapter, part || CASE WHEN len(pt) > 0 THEN ': ' || array_to_string(pt, ' — ') ELSE '' END || CASE WHEN division IS NULL THEN '' ELSE '; ' || division || CASE WHEN len(dt) > 0 THEN ': ' || array_to_string(dt, ' — ') ELSE '' END END AS part FROM f WHERE opened IS NOT NULL""")
def law_levels(spark: SparkSession, d: str) -> DataFrame:
    """Chapter, part and division with their titles of every section."""
    return s.section_levels(LAW.spark(spark, d), HEADERS.spark(spark, d))


#: A law for each order, whose lines are table pieces and text, two a page.
PIECES = Made(f"""SELECT l_orderkey AS law, CAST(k AS BIGINT) AS ord, CAST(floor(k / 2) AS INT) AS page, w, CASE WHEN w < 3 THEN 'table' ELSE 'text' END AS kind,
    CASE WHEN w < 3 THEN concat('| Head ', l_partkey % 2, ' |', chr(10), '|---|', chr(10), '| row ', k, ' |', CASE WHEN w = 1 THEN concat(chr(10), '| more |') ELSE '' END) WHEN w = 3 THEN concat('(', l_linenumber, ') item ', k, '-') WHEN w = 4 THEN 'Provided that it holds' ELSE concat('further words ', k, CASE WHEN l_suppkey % 2 = 0 THEN '-' ELSE '' END) END AS text
    FROM (SELECT *, CAST(l_partkey % 6 AS INT) AS w FROM {NUMBERED}) n""")


@book.query(f"""WITH RECURSIVE x AS (SELECT *, string_split(text, chr(10)) AS rows FROM {PIECES.duck()}),
    f AS (SELECT law, ord, 1 AS para, kind = 'table' AS is_table, page AS page, page AS page_end, text, rows[1] AS head FROM x WHERE ord = 1
      UNION ALL SELECT law, ord, CASE WHEN goes THEN para ELSE para + 1 END, t, CASE WHEN goes THEN page ELSE own END, own,
        CASE WHEN NOT goes THEN xt WHEN t THEN text || coalesce(chr(10) || nullif(array_to_string(CASE WHEN rows[1] = head THEN rows[3:] ELSE list_concat(rows[1:1], rows[3:]) END, chr(10)), ''), '') WHEN text LIKE '%-' AND xt[1:1] BETWEEN 'a' AND 'z' THEN text || xt ELSE text || ' ' || xt END, CASE WHEN goes THEN head ELSE rows[1] END
      FROM (SELECT x.law, x.ord, f.para, x.kind = 'table' AS t, f.page, x.page AS own, f.text, x.text AS xt, x.rows, f.head, CASE WHEN x.kind = 'table' THEN f.is_table AND x.page = f.page_end + 1 ELSE NOT f.is_table AND x.w > 4 END AS goes FROM f JOIN x ON x.law = f.law AND x.ord = f.ord + 1) y)
    SELECT law, CAST(para AS INTEGER) AS para, is_table, arg_max(text, ord) AS text, min(page) AS page, max(page_end) AS page_end FROM f GROUP BY law, para, is_table""")
def tables_over_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines to paragraphs; a table that goes on over the next page is one."""
    return s.paragraphs_and_tables(PIECES.spark(spark, d), ["law"])


#: Grids: a header that repeats, long sentences, short single cells, empty cells, markers before brackets; `plain` is what each row should become.
_SENTENCE = "concat('The table that follows holds the rates of group ', r, ' for all of the persons named in it')"
GRIDS = Made(f"""SELECT l_orderkey AS grid, CAST(k AS BIGINT) AS row_no, CASE w WHEN 0 THEN array('Name', NULL, 'Rate') WHEN 1 THEN array(NULL, {_SENTENCE}) WHEN 2 THEN array('', concat('note ', r)) WHEN 3 THEN array(' ', NULL) ELSE array(concat('a', l_linenumber), '', concat(r, '[', w, '%]'), concat('b', chr(10), '  c')) END AS cells,
    CASE w WHEN 0 THEN array('Name', 'Rate') WHEN 1 THEN array({_SENTENCE}) WHEN 2 THEN array(concat('note ', r)) WHEN 3 THEN array() ELSE array(concat('a', l_linenumber), concat('[', w, '%]'), 'b c') END AS plain
    FROM (SELECT *, CAST(l_partkey % 7 AS INT) AS w, CAST(l_suppkey % 30 AS INT) AS r FROM {NUMBERED}) n""")
_CLOSED = "len(cur) >= 2 AND list_max(list_transform(cur, lambda x: len(x))) >= 2"
_CAPTION = f"CASE WHEN NOT shut OR len(cur) = 0 THEN cap WHEN {_CLOSED} THEN NULL ELSE nullif(trim(coalesce(cap, '') || ' ' || array_to_string(flatten(cur), ' ')), '') END"


@book.query(f"""WITH RECURSIVE x AS (SELECT grid, row_number() OVER (PARTITION BY grid ORDER BY row_no) AS i, plain FROM (SELECT grid, row_no, plain FROM {GRIDS.duck()} WHERE len(plain) > 0 UNION ALL SELECT DISTINCT grid, 1000000, NULL::VARCHAR[] FROM {GRIDS.duck()})),
    f AS (SELECT DISTINCT grid, 0::BIGINT AS i, NULL::VARCHAR AS cap, []::VARCHAR[][] AS cur, NULL::VARCHAR AS caption, NULL::VARCHAR[][] AS rows, 0 AS n FROM x
      UNION ALL SELECT grid, i, CASE WHEN is_cap THEN coalesce(after || ' ', '') || plain[1] ELSE after END, CASE WHEN plain IS NULL OR is_cap THEN []::VARCHAR[][] WHEN shut THEN [plain] ELSE list_append(cur, plain) END, CASE WHEN shut AND {_CLOSED} THEN cap END, CASE WHEN shut AND {_CLOSED} THEN cur END, n + CASE WHEN shut AND {_CLOSED} THEN 1 ELSE 0 END
      FROM (SELECT *, {_CAPTION} AS after FROM (SELECT x.grid, x.i, x.plain, f.cap, f.cur, f.n, coalesce(len(x.plain) = 1 AND length(x.plain[1]) > 60, false) AS is_cap, x.plain IS NULL OR (len(x.plain) = 1 AND length(x.plain[1]) > 60) OR (len(f.cur) > 0 AND x.plain = f.cur[1]) AS shut FROM f JOIN x ON x.grid = f.grid AND x.i = f.i + 1) y) z)
    SELECT grid, CAST(n AS INTEGER) AS n, caption, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' / ')), ' // ') AS rows FROM f WHERE rows IS NOT NULL""")
def grids_to_tables(spark: SparkSession, d: str) -> DataFrame:
    """Grids cleaned, split at repeated headers and captions."""
    found = s.grid_tables(GRIDS.spark(spark, d), "grid", "row_no", "cells")
    return found.select("grid", "n", "caption", F.array_join(F.transform("rows", lambda r: F.array_join(r, " / ")), " // ").alias("rows"))


#: Spans of a line for each order: words, and smaller digits behind or before them.
SPANS = Made(f"""SELECT l_orderkey AS line, k * 10.0 AS x0, k * 10.0 + CASE WHEN l_suppkey % 2 = 0 THEN 9.5 ELSE 7.0 END AS x1, m, CASE WHEN m THEN 6.0 ELSE 10.02 END AS size, l_suppkey % 3 = 0 AS bold, CASE WHEN m THEN concat(' ', l_linenumber) WHEN l_partkey % 4 = 0 THEN concat('[word', l_partkey % 10) ELSE concat('word', l_partkey % 10) END AS text
    FROM (SELECT *, l_partkey % 3 = 0 AS m FROM {NUMBERED}) n""")
_MARKED = f"""ch AS (SELECT line, sum(CASE WHEN m THEN 0 ELSE length(text) END) AS wc, sum(CASE WHEN m THEN length(trim(text)) ELSE 0 END) AS mc, min(CASE WHEN m THEN 1e9 ELSE x0 END) AS wx, min(CASE WHEN m THEN x0 ELSE 1e9 END) AS mx FROM {SPANS.duck()} GROUP BY line),
    sp AS (SELECT s.*, m AND (wc > mc OR (wc = mc AND wx < mx)) AS mark FROM {SPANS.duck()} s JOIN ch USING (line)),
    w AS (SELECT *, coalesce(max(NOT mark) OVER b, false) AS seen, lag(x1) OVER (PARTITION BY line ORDER BY x0) AS px, lead(text) OVER (PARTITION BY line ORDER BY x0) AS nx, last_value(CASE WHEN NOT mark THEN text END IGNORE NULLS) OVER b AS owner FROM sp WINDOW b AS (PARTITION BY line ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@book.query(f"""WITH {_MARKED} SELECT line, trim(regexp_replace(string_agg(CASE WHEN mark THEN '' WHEN seen AND x0 - px > 1.5 THEN ' ' || text ELSE text END, '' ORDER BY x0), ' +', ' ', 'g')) AS text, array_to_string(list_filter(list(CASE WHEN mark THEN trim(text) END ORDER BY x0), lambda r: r IS NOT NULL), ' ') AS fn_refs,
    max(mark AND NOT seen AND NOT coalesce(starts_with(nx, '['), false)) AS footnote_start, arg_min(bold, x0) FILTER (NOT mark) AS bold_start FROM w GROUP BY line""")
def marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines from spans, the footnote markers apart."""
    return s.marker_spans(SPANS.spark(spark, d), ["line"]).withColumn("fn_refs", F.array_join("fn_refs", " "))


NOTES = Made("SELECT o_orderkey AS line, CAST(o_orderkey % 7 + 1 AS STRING) AS marker, concat('note of ', o_custkey) AS note FROM {orders}")


@book.query(f"WITH {_MARKED} SELECT w.line, trim(w.text) AS marker, trim(owner) AS owner, note FROM w JOIN {NOTES.duck()} n ON n.line = w.line AND n.marker = trim(w.text) WHERE mark")
def marker_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """Each marker with the words to its left and its footnote."""
    return s.marker_owners(SPANS.spark(spark, d), ["line"]).join(NOTES.spark(spark, d), ["line", "marker"]).select("line", "marker", "owner", "note")


#: Schedules of a law for each supplier: ten lines a page, parts that go on, an ordinal that is not known.
SCHEDULES = Made(f"""SELECT law, ord, what, r, num, CAST(floor(ord / 10) AS INT) AS page, what < 5 AS bold, what = 3 AS centred,
    CASE WHEN what = 3 THEN concat('Division ', repeat('I', r)) WHEN what < 3 THEN concat('(', num, ') clause of ', r) ELSE concat('plain text of line ', ord) END AS text FROM (SELECT *, CAST(greatest(1, ord % 900 - CASE WHEN ord % 5 = 0 THEN 12 ELSE 0 END) AS INT) AS num FROM ({_NTH}) a) b""")
_PAGE_KIND = "CAST(floor(page / 2) AS INT) % 6"
SCHEDULE_PAGES = Made(f"""SELECT law, page, {_PAGE_KIND} AS pk, CASE {_PAGE_KIND} WHEN 0 THEN 'SECOND SCHEDULE – Part I' WHEN 1 THEN 'Second Schedule' WHEN 2 THEN 'Second Schedule, Part - II' WHEN 3 THEN 'Third Schedule' WHEN 4 THEN 'The Zeroth Schedule' ELSE 'First Schedule Part III' END AS header
    FROM (SELECT DISTINCT law, CAST(floor(ord / 10) AS INT) AS page FROM ({_NTH}) a) b""")


@book.query(f"""WITH RECURSIVE x AS (SELECT l.*, row_number() OVER (PARTITION BY law ORDER BY ord) AS i, CASE pk WHEN 3 THEN 3 WHEN 5 THEN 1 ELSE 2 END AS sn, CASE pk WHEN 3 THEN 'Third' WHEN 5 THEN 'First' ELSE 'Second' END || ' Schedule' AS name, CASE pk WHEN 0 THEN 'I' WHEN 2 THEN 'II' WHEN 5 THEN 'III' END AS hp FROM {SCHEDULES.duck()} l JOIN {SCHEDULE_PAGES.duck()} p USING (law, page) WHERE pk <> 4),
    f AS (SELECT DISTINCT law, 0::BIGINT AS i, 0::BIGINT AS ord, 0 AS sn, NULL::VARCHAR AS name, NULL::VARCHAR AS part, NULL::VARCHAR AS division, NULL::INTEGER AS clause, 0 AS top FROM x
      UNION ALL SELECT law, i, ord, sn, name, part, CASE WHEN opens THEN own ELSE division END, CASE WHEN opens THEN NULL WHEN heads THEN num ELSE clause END, CASE WHEN heads AND NOT opens THEN num ELSE top END
      FROM (SELECT *, what = 3 AND division IS DISTINCT FROM own AS opens, sn = 2 AND what < 3 AND num > top AS heads FROM (SELECT x.law, x.i, x.ord, x.sn, x.name, x.what, x.num, repeat('I', x.r) AS own, CASE WHEN x.sn = f.sn AND x.hp IS NULL THEN f.part ELSE x.hp END AS part,
          CASE WHEN fresh THEN NULL ELSE division END AS division, CASE WHEN fresh THEN NULL ELSE clause END AS clause, CASE WHEN fresh THEN 0 ELSE top END AS top FROM (SELECT f.* RENAME (law AS flaw, i AS fi, sn AS fsn, name AS fname, ord AS ford), x.*, x.sn <> f.sn OR (x.hp IS NOT NULL AND x.hp IS DISTINCT FROM f.part) AS fresh FROM f JOIN x ON x.law = f.law AND x.i = f.i + 1) x JOIN (SELECT 1) ON true, LATERAL (SELECT fsn AS sn, x.part AS part) f) y) z)
    SELECT law, ord, CASE WHEN clause IS NOT NULL THEN law_prefix || '-sch2-p' || coalesce(part, 'I') || '-cl' || clause ELSE law_prefix || '-sch' || sn || coalesce('-p' || part, '') || coalesce('-div' || division, '') END AS unit,
      CASE WHEN clause IS NOT NULL THEN name || ', Part ' || coalesce(part, 'I') || ', clause (' || clause || ')' ELSE name || coalesce(', Part ' || part, '') || coalesce(', Division ' || division, '') END AS title, CASE WHEN clause IS NOT NULL THEN 'schedule_clause' ELSE 'schedule_part' END AS kind FROM (SELECT *, 'L' AS law_prefix FROM f WHERE i > 0)""")
def schedule_lines(spark: SparkSession, d: str) -> DataFrame:
    """The unit of every line of a schedule: part, division or clause."""
    return s.schedule_units(SCHEDULES.spark(spark, d), SCHEDULE_PAGES.spark(spark, d), "L")


@book.query("""WITH RECURSIVE x AS (SELECT conv_id, turn, role, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT conv_id, turn, role, list_filter(string_split(regexp_replace(trim(text), '([.:;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM conversations)),
    f AS (SELECT conv_id, turn, role, i, s AS buf, 0 AS piece FROM x WHERE i = 1
      UNION ALL SELECT x.conv_id, x.turn, x.role, x.i, CASE WHEN ceil(length(f.buf || ' ' || x.s) / 4.0) > 20 THEN x.s ELSE f.buf || ' ' || x.s END, f.piece + CASE WHEN ceil(length(f.buf || ' ' || x.s) / 4.0) > 20 THEN 1 ELSE 0 END FROM f JOIN x ON x.conv_id = f.conv_id AND x.turn = f.turn AND x.i = f.i + 1)
    SELECT conv_id, turn, CAST(piece AS INTEGER) AS piece, CASE WHEN piece > 0 THEN 'Section ' || turn || '. ' || role || ' (continued)' || chr(10) ELSE '' END || arg_max(buf, i) AS text FROM f GROUP BY conv_id, turn, role, piece""".replace("\\\\", "\\"))
def long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Turns packed by sentence into pieces, the later ones headed by a title."""
    turns = table(spark, d, "conversations")
    pieces = s.sentence_pieces(turns, ["conv_id", "turn", "role"], "text", 20).withColumn("section", F.col("turn").cast("string")).withColumn("title", F.col("role"))
    return s.with_titles(pieces, ["conv_id", "turn"], "Section").select("conv_id", "turn", "piece", "text")


TOPS = Made(f"SELECT l_orderkey AS page, k * 12.0 AS y, CASE WHEN l_partkey % 3 = 0 THEN 5.0 ELSE 9.0 END AS size, concat(' _Head ', l_linenumber, '_ ') AS text, l_linenumber AS n FROM {NUMBERED}")


@book.query(f"SELECT page, string_agg('Head ' || n, ' ' ORDER BY y) AS header FROM {TOPS.duck()} WHERE y < 40 AND size >= 8 GROUP BY page")
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header of each page, from the lines of running size at its top."""
    return s.page_headers(TOPS.spark(spark, d), ["page"], 40.0, 8.0)
