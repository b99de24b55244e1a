"""Chunking of laws and bulk answering, end to end, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.plans.answering import ask
from tessera.plans.fixtures import Made
from tessera.plans.registering import Book
from tessera.plans.retrieval_queries import _BM25, _SPARSE
from tessera.plans.summary_queries import _LANG
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

#: Lines of a law for every conversation: a heading for each turn, some of which count down and so open nothing, a
#: sub-section, a proviso in half of the laws, and a line that goes on.
LINES = Made("""SELECT 'c' || conv_id AS law, turn * 10 + j AS ord, j, j = 0 AS bold, CASE WHEN j = 0 THEN (turn * 2 + 3 - CASE WHEN turn % 5 = 4 THEN 6 ELSE 0 END) || CASE WHEN turn % 3 = 2 THEN 'A' ELSE '' END END AS heading, CASE WHEN j = 1 THEN CAST(turn % 4 + 2 AS STRING) END AS sub, CAST(floor(turn / 3) AS INT) AS page,
    CASE j WHEN 0 THEN (turn * 2 + 3 - CASE WHEN turn % 5 = 4 THEN 6 ELSE 0 END) || CASE WHEN turn % 3 = 2 THEN 'A' ELSE '' END || '. Heading of ' || role || '.—(1) The ' || role || ' [ ] opens  turn ' || turn || '.'
      WHEN 1 THEN '(' || (turn % 4 + 2) || ') ' || text || '.' WHEN 2 THEN 'Provided that ' || text || '.' ELSE 'and further words of the ' || role || '.' END AS text
    FROM {conversations} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE text IS NOT NULL AND (j <> 2 OR conv_id % 2 = 0)""")
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '\\[[\\s#*%]*\\]', '', 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_LIMIT = 120
_CHUNKS = f"""l AS (SELECT * FROM {LINES.duck()}), h AS (SELECT law, ord, heading AS num FROM l WHERE j = 0),
    k AS (SELECT *, lpad(regexp_extract(num, '^[0-9]+'), 6, '0') || regexp_extract(num, '[A-Z]*$') AS key FROM h),
    o AS (SELECT law, ord, num FROM (SELECT *, coalesce(key > max(key) OVER (PARTITION BY law ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM k) WHERE up),
    s AS (SELECT l.*, o.num AS opens, last_value(o.num IGNORE NULLS) OVER (PARTITION BY l.law ORDER BY l.ord) AS section FROM l LEFT JOIN o ON o.law = l.law AND o.ord = l.ord),
    b AS (SELECT *, CASE WHEN opens IS NOT NULL OR j IN (1, 2) OR row_number() OVER (PARTITION BY law, section ORDER BY ord) = 1 THEN 1 ELSE 0 END AS begins FROM s WHERE section IS NOT NULL),
    n AS (SELECT *, sum(begins) OVER (PARTITION BY law, section ORDER BY ord) AS para FROM b),
    p AS (SELECT * FROM (SELECT law, section, para, {_CLEAN.format("string_agg(text, ' ' ORDER BY ord)")} AS text, arg_min(coalesce(sub, ''), ord) AS first_sub, min(page) AS page, max(page) AS page_end FROM n GROUP BY ALL) WHERE text <> ''),
    u AS (SELECT *, sum(CASE WHEN sub IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY law, section ORDER BY para) AS unit FROM (SELECT *, nullif(first_sub, '') AS sub, ceil(length(text) / 4.0)::BIGINT AS t FROM p)),
    a AS (SELECT *, unit || '-' || CASE WHEN sum(t) OVER (PARTITION BY law, section, unit) <= {_LIMIT} THEN 'all' ELSE para::VARCHAR END AS atom FROM u),
    g AS (SELECT law, section, atom, sum(t) AS t, row_number() OVER (PARTITION BY law, section ORDER BY min(para), atom) AS i FROM a GROUP BY law, section, atom),
    f AS (SELECT law, section, atom, i, 0 AS piece, t AS size FROM g WHERE i = 1
          UNION ALL SELECT g.law, g.section, g.atom, g.i, f.piece + CASE WHEN f.size > 0 AND f.size + g.t > {_LIMIT} THEN 1 ELSE 0 END, CASE WHEN f.size > 0 AND f.size + g.t > {_LIMIT} THEN g.t ELSE f.size + g.t END FROM f JOIN g ON g.law = f.law AND g.section = f.section AND g.i = f.i + 1),
    c AS (SELECT law, section, piece, string_agg(text, chr(10) ORDER BY para) AS text, min(page) AS page, max(page_end) AS page_end, arg_min(coalesce(sub, ''), para) AS begin_sub, list_filter(list(sub ORDER BY para), lambda x: x IS NOT NULL) AS subs FROM a JOIN f USING (law, section, atom) GROUP BY law, section, piece),
    d AS (SELECT *, count(*) OVER (PARTITION BY law, section) AS n, last_value(subs[len(subs)] IGNORE NULLS) OVER (PARTITION BY law, section ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM c),
    e AS (SELECT *, CASE WHEN begin_sub <> '' OR carried IS NULL THEN subs[1] ELSE carried END AS b, subs[len(subs)] AS e FROM d),
    chunks AS (SELECT e.law, e.section, e.law || '-s' || e.section || CASE WHEN n = 1 THEN '' ELSE '-' || (piece + 1) END AS chunk_id, regexp_extract(s.text, '^[0-9A-Z]+[.] (.*?)[.]—', 1) AS title,
      CASE WHEN len(subs) = 0 THEN '(' || carried || ')' WHEN b = e THEN '(' || b || ')' ELSE '(' || b || ')-(' || e || ')' END AS label, ceil(length(e.text) / 4.0)::BIGINT AS n_tokens, e.page, e.page_end, md5(e.text) AS text_md5 FROM e JOIN s ON s.law = e.law AND s.opens = e.section)"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(LINES.spark(spark, d), max_tokens=_LIMIT + 30)


@book.query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks")
def chunked_laws(spark: SparkSession, d: str) -> DataFrame:
    """Laws from lines to chunks: sections, paragraphs, units, packed pieces, labels and titles."""
    return _chunked(spark, d).select("law", "section", "chunk_id", "title", "label", "n_tokens", "page", "page_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


CONTENTS = Made("SELECT 'c' || conv_id AS law, CAST(turn * 2 + 3 AS STRING) AS section, CASE WHEN turn % 4 = 3 THEN 'Omitted by an act' WHEN turn % 4 = 2 THEN 're-numbered' ELSE role END AS title FROM {conversations}")


@book.query(f"""WITH RECURSIVE {_CHUNKS}, live AS (SELECT DISTINCT law, section FROM {CONTENTS.duck()} WHERE NOT regexp_matches(title, '(?i)omitted|re-?numbered')), have AS (SELECT DISTINCT law, section FROM chunks)
    SELECT law, section, 'no chunk' AS problem FROM live ANTI JOIN have USING (law, section) UNION ALL SELECT law, section, 'not listed' FROM have ANTI JOIN live USING (law, section)""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the table of contents without a chunk, and chunks that it doesn't list."""
    return chunking.coverage(_chunked(spark, d), CONTENTS.spark(spark, d))


QUESTIONS = Made("SELECT item_id AS question_id, text || CASE WHEN item_id % 4 = 0 THEN '' ELSE ' in tax year ' || (2001 + item_id % 25) END AS text FROM {benchmark}")
CHUNKS = Made("SELECT doc_id AS chunk_id, 'L-s' || doc_id AS section_id, text, CAST(2005 + doc_id % 15 AS INT) AS tax_year_from, CASE WHEN doc_id % 3 > 0 THEN CAST(2008 + doc_id % 15 AS INT) END AS tax_year_to FROM {documents}")
_NOW, _FIRST, _LAST, _LEAST = 2016, 2003, 2024, 0.2
_ASK = f"""{(_BM25 + ',' + _SPARSE).replace('FROM benchmark', 'FROM q')},
    y AS (SELECT question_id, text, {_LANG} AS language, coalesce(try_cast(regexp_extract(text, 'tax year (20[0-9][0-9])$', 1) AS INTEGER), {_NOW}) AS tax_year FROM (SELECT item_id AS question_id, text FROM q)),
    v AS ({CHUNKS.duck()[1:-1]}), ok AS (SELECT question_id, chunk_id FROM y JOIN v ON tax_year_from <= tax_year AND (tax_year_to IS NULL OR tax_year_to >= tax_year)),
    s0 AS (SELECT item_id AS q, doc_id AS c, score, 0 AS l FROM sp UNION ALL SELECT item_id, doc_id, score, 1 FROM bm WHERE score > 0),
    s1 AS (SELECT q, c, l, row_number() OVER (PARTITION BY q, l ORDER BY score DESC, c) AS r FROM s0 JOIN ok ON question_id = q AND chunk_id = c),
    s2 AS (SELECT q, c, round(sum(1 / (60 + r)), 9) AS score, min(l * 1000 + r) AS first FROM s1 WHERE r <= 30 GROUP BY q, c),
    s3 AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, first, c) AS n FROM s2),
    w AS (SELECT question_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4)) AS ws FROM y),
    r AS (SELECT q AS question_id, c AS chunk_id, n, CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_filter(ws, lambda x: contains(lower(text), x))) / len(ws), 6) END AS score FROM s3 JOIN w ON question_id = q JOIN documents ON doc_id = c WHERE n <= 15)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sections = spark.createDataFrame([], "kind string, number string, section_id string")
    return ask(QUESTIONS.spark(spark, d), CHUNKS.spark(spark, d), sections, _NOW, _FIRST, _LAST, threshold=_LEAST)


@book.query(f"""WITH q AS (SELECT question_id AS item_id, text FROM {QUESTIONS.duck()}), {_ASK}, t AS (SELECT question_id, max(score) AS top, count(*) AS n FROM r GROUP BY question_id)
    SELECT y.question_id, language, tax_year, CASE WHEN tax_year < {_FIRST} OR tax_year > {_LAST} THEN 'TAX_YEAR_NOT_COVERED' WHEN coalesce(n, 0) = 0 OR top < {_LEAST} THEN 'NO_RELEVANT_SOURCES' END AS reason, top FROM y LEFT JOIN t USING (question_id)""")
def ask_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each question is answered, and why not, over chunks that are valid in its year."""
    return _asked(spark, d)[0]


@book.query(f"""WITH q AS (SELECT question_id AS item_id, text FROM {QUESTIONS.duck()}), {_ASK}
    SELECT * FROM (SELECT question_id, chunk_id, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, chunk_id) AS INTEGER) AS rank FROM r) WHERE rank <= 6""")
def ask_sources(spark: SparkSession, d: str) -> DataFrame:
    """The six sources of each question: both searches within its year, fused, then reranked."""
    return _asked(spark, d)[1].drop("via")


# --- the same with named sections, definitions, glossary sections, rewrites and windows -------------------------------------------

_HALF = "CAST(floor(length(text) / 2) AS INT)"
#: Questions that ask for a term, name a section that is there or one that is not, and a year.
FULL = Made("""SELECT item_id AS question_id, concat(CASE WHEN item_id % 4 = 2 THEN concat('what is notion ', item_id % 9, '? ') ELSE '' END, text, CASE WHEN item_id % 5 = 1 THEN concat(' section ', item_id % 60) WHEN item_id % 7 = 3 THEN ' section 998ZZ' ELSE '' END,
    CASE WHEN item_id % 4 = 0 THEN '' ELSE concat(' in tax year ', 2001 + item_id % 25) END) AS text FROM {benchmark}""")
REWRITES = Made(f"SELECT item_id AS question_id, n, CASE n WHEN 1 THEN substr(text, {_HALF} + 1) ELSE substr(text, 1, {_HALF}) END AS text FROM {{benchmark}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) k WHERE item_id % 2 = 1 AND (n = 1 OR item_id % 3 = 1)")
PARTS = Made("SELECT doc_id AS chunk_id, concat('L-s', CAST(floor(doc_id / 4) AS BIGINT)) AS section_id, text, CAST(2005 + doc_id % 15 AS INT) AS tax_year_from, CASE WHEN doc_id % 3 > 0 THEN CAST(2008 + doc_id % 15 AS INT) END AS tax_year_to FROM {documents}")
SECTIONS = Made("SELECT DISTINCT 'section' AS kind, CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) AS number, concat('L-s', CAST(floor(doc_id / 4) AS BIGINT)) AS section_id FROM {documents}")
#: A definition of each of nine terms, every other one of which only points to a section.
DEFINED = Made("SELECT concat('notion ', doc_id % 9) AS term, concat(doc_id % 9, 'A') AS clause, min(doc_id) AS chunk_id, CASE WHEN doc_id % 9 % 2 = 0 THEN concat('L-s', doc_id % 9 + 20) END AS points_to FROM {documents} GROUP BY doc_id % 9")
MEANT = Made("SELECT item_id AS question_id, ord, concat('L-s', item_id % 40 + ord * 3) AS section_id FROM {benchmark} CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1) k WHERE item_id % 3 = 0")
_WINDOW = 400
_SHARE = "CASE WHEN len({ws}) = 0 THEN 0 ELSE round(len(list_filter({ws}, lambda x: contains(lower(p.text), x))) / len({ws}), 6) END"
_LONG_WORDS = "list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: length(x) > 4))"
_IN_YEAR = "tax_year_from <= tax_year AND (tax_year_to IS NULL OR tax_year_to >= tax_year)"
_FULL = f"""ph AS (SELECT question_id, 0 AS n, text FROM {FULL.duck()} UNION ALL SELECT question_id, n, text FROM {REWRITES.duck()}), q AS (SELECT question_id * 10 + n AS item_id, text FROM ph), {(_BM25 + ',' + _SPARSE).replace('FROM benchmark', 'FROM q')},
    y AS (SELECT question_id, text, {_LANG} AS language, coalesce(try_cast(regexp_extract(text, 'tax year (20[0-9][0-9])$', 1) AS INTEGER), {_NOW}) AS tax_year FROM {FULL.duck()}), v AS (SELECT * FROM {PARTS.duck()}),
    s0 AS (SELECT item_id AS a, doc_id AS c, score, item_id % 10 * 2 AS l FROM sp UNION ALL SELECT item_id, doc_id, score, item_id % 10 * 2 + 1 FROM bm WHERE score > 0),
    s1 AS (SELECT y.question_id, c, l, row_number() OVER (PARTITION BY a, l ORDER BY score DESC, c) AS r FROM s0 JOIN y ON y.question_id = a // 10 JOIN v ON v.chunk_id = c WHERE {_IN_YEAR}),
    s2 AS (SELECT question_id, c, round(sum(1 / (60 + r)), 9) AS score, min(l * 1000 + r) AS first FROM s1 WHERE r <= 30 GROUP BY question_id, c),
    fo AS (SELECT question_id, c AS chunk_id, n FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first, c) AS n FROM s2) WHERE n <= 15),
    named AS (SELECT question_id, 'L-s' || question_id % 60 AS section_id, s.section_id IS NOT NULL AS there FROM y LEFT JOIN {SECTIONS.duck()} s ON s.section_id = 'L-s' || question_id % 60 WHERE question_id % 5 = 1 UNION ALL SELECT question_id, NULL, false FROM y WHERE question_id % 5 <> 1 AND question_id % 7 = 3),
    p1 AS (SELECT question_id, chunk_id, k AS prior FROM (SELECT m.question_id, v.*, row_number() OVER (PARTITION BY m.question_id ORDER BY coalesce(fo.n, 1000000), v.chunk_id) AS k FROM named m JOIN v USING (section_id) LEFT JOIN fo ON fo.question_id = m.question_id AND fo.chunk_id = v.chunk_id) JOIN y USING (question_id) WHERE k <= 3 AND {_IN_YEAR}),
    dq AS (SELECT y.question_id, tax_year, d.chunk_id, points_to FROM y JOIN {DEFINED.duck()} d ON d.term = 'notion ' || question_id % 9 WHERE question_id % 4 = 2),
    p2 AS (SELECT question_id, chunk_id, 100000 AS prior FROM dq JOIN v USING (chunk_id) WHERE tax_year_from <= tax_year UNION ALL SELECT question_id, chunk_id, 101000 + k FROM (SELECT dq.question_id, tax_year, v.chunk_id, tax_year_from, row_number() OVER (PARTITION BY dq.question_id ORDER BY coalesce(fo.n, 1000000), v.chunk_id) AS k FROM dq JOIN v ON v.section_id = points_to LEFT JOIN fo ON fo.question_id = dq.question_id AND fo.chunk_id = v.chunk_id) WHERE k <= 3 AND tax_year_from <= tax_year),
    pins AS (SELECT question_id, chunk_id, min(prior) AS prior FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY ALL), pool0 AS (SELECT question_id, chunk_id, 'lookup' AS via, prior FROM pins UNION ALL SELECT question_id, chunk_id, 'search', n FROM fo ANTI JOIN pins USING (question_id, chunk_id)),
    meant AS (SELECT DISTINCT question_id, ord, section_id, chunk_id, tax_year_from, tax_year_to FROM {MEANT.duck()} JOIN v USING (section_id)),
    add AS (SELECT DISTINCT question_id, chunk_id FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id, section_id ORDER BY chunk_id) AS k FROM meant JOIN y USING (question_id) ANTI JOIN pool0 USING (question_id, chunk_id) WHERE {_IN_YEAR}) WHERE k <= 3),
    pool AS (SELECT * FROM pool0 UNION ALL SELECT question_id, chunk_id, 'search', 1048576 FROM add),
    qw AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM ph), idf AS (SELECT w, ln((SELECT count(*) FROM documents) / count(*)) AS x FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS w FROM documents) GROUP BY w),
    st AS (SELECT chunk_id, text, unnest(range({_WINDOW * 3 // 4}, length(text) - {_WINDOW // 4}, {_WINDOW * 3 // 4})) AS s FROM v WHERE length(text) > {_WINDOW} AND chunk_id IN (SELECT chunk_id FROM pool)),
    wn AS (SELECT DISTINCT chunk_id, text, CASE WHEN strpos(substr(text, s + 1), ' ') > 0 THEN s + strpos(substr(text, s + 1), ' ') ELSE s END AS b FROM st), ww AS (SELECT chunk_id, b, unnest(list_distinct(regexp_extract_all(lower(substr(text, b + 1, {_WINDOW})), '[a-z]{{4,}}'))) AS w FROM wn),
    sc AS (SELECT question_id, chunk_id, b, round(sum(x), 6) AS s FROM pool JOIN ww USING (chunk_id) JOIN qw USING (question_id, w) JOIN idf USING (w) GROUP BY ALL), bw AS (SELECT question_id, chunk_id, b FROM sc WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY s DESC, b) = 1),
    ps AS (SELECT question_id, chunk_id, text FROM pool JOIN v USING (chunk_id) UNION ALL SELECT question_id, chunk_id, substr(text, b + 1, {_WINDOW}) FROM bw JOIN v USING (chunk_id)), hw AS (SELECT question_id, n, {_LONG_WORDS.format(t='text')} AS ws FROM ph),
    sh AS (SELECT p.question_id, p.chunk_id, max({_SHARE.format(ws='hw.ws')}) AS score FROM ps p JOIN hw USING (question_id) WHERE n < 2 OR EXISTS (SELECT 1 FROM meant m WHERE m.question_id = p.question_id AND m.chunk_id = p.chunk_id) GROUP BY ALL),
    rk AS (SELECT pool.question_id, pool.chunk_id, via, coalesce(score, 0)::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY pool.question_id ORDER BY via = 'lookup' DESC, coalesce(score, 0) DESC, prior, pool.chunk_id) AS INTEGER) AS rank FROM pool LEFT JOIN sh USING (question_id, chunk_id))"""


def _asked_in_full(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = {"rewrites": REWRITES, "definitions": DEFINED, "named": MEANT}
    return ask(FULL.spark(spark, d), PARTS.spark(spark, d), SECTIONS.spark(spark, d), _NOW, _FIRST, _LAST, threshold=_LEAST, window=_WINDOW, policy="max", **{k: m.spark(spark, d) for k, m in made.items()})


@book.query(f"""WITH {_FULL}, t AS (SELECT question_id, max(score) AS top, count(*) AS n FROM rk GROUP BY question_id)
    SELECT question_id, language, tax_year, CASE WHEN tax_year < {_FIRST} OR tax_year > {_LAST} THEN 'TAX_YEAR_NOT_COVERED' WHEN question_id IN (SELECT question_id FROM named WHERE NOT there) AND question_id NOT IN (SELECT question_id FROM pins) THEN 'SECTION_NOT_FOUND'
      WHEN coalesce(n, 0) = 0 OR (top < {_LEAST} AND question_id NOT IN (SELECT question_id FROM pins)) THEN 'NO_RELEVANT_SOURCES' END AS reason, top FROM y LEFT JOIN t USING (question_id)""")
def full_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each question is answered, with pinned sections and definitions, rewrites, glossary sections and windows."""
    return _asked_in_full(spark, d)[0]


@book.query(f"WITH {_FULL} SELECT question_id, chunk_id, via, score, rank FROM rk WHERE rank <= 6")
def full_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each question, pinned ones first."""
    return _asked_in_full(spark, d)[1]
