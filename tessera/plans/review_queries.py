"""Queries on layout, evaluation, review and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens
from tessera.functions.scope import filer_question
from tessera.operators import layout, review
from tessera.plans.fixtures import NUMBERED, Made
from tessera.plans.registering import Book
from tessera.sources.shared import shared_folder
from tessera.sources.tables import append_log, cached, read_glossary, read_pages, read_reports, table, to_fetch, write_report, write_snapshot

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

SPANS = Made("SELECT l_orderkey AS page, k + l_quantity / 25 AS y, l_extendedprice AS x, l_discount * 100 AS size, l_linestatus = 'F' AND l_tax > 0.06 AS rule, l_returnflag || k AS text FROM " + NUMBERED)
_BODY = f"(SELECT page, y, x, text FROM (SELECT *, max(CASE WHEN rule THEN y END) OVER (PARTITION BY page) AS sep FROM {SPANS.duck()}) WHERE size < 9.5 AND (sep IS NULL OR y < sep - 1))"


@book.query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, text) AS i FROM {_BODY}),
    f AS (SELECT page, i, y, x, text, y AS anchor FROM s WHERE i = 1
          UNION ALL SELECT s.page, s.i, s.y, s.x, s.text, CASE WHEN s.y - f.anchor > 1.5 THEN s.y ELSE f.anchor END FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1)
    SELECT page, anchor AS y, string_agg(text, ' ' ORDER BY x, text) AS text FROM f GROUP BY page, anchor""")
def baseline_lines(spark: SparkSession, d: str) -> DataFrame:
    """Spans to lines: junk and footnotes left out, what shares a baseline joined from left to right."""
    body = layout.body_spans(SPANS.spark(spark, d), "page", "y", F.col("rule"), F.col("size") >= 9.5)
    return layout.baselines(body, "page", "y", "x", "text", 1.5)


@book.query("""SELECT conv_id, turn, state FROM (SELECT *, CASE WHEN max(turn % 4 = 3) OVER w THEN 'schedule' WHEN max(turn % 4 = 1) OVER w THEN 'body' ELSE 'before' END AS state FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE state = 'body' OR state = 'schedule' AND role = 'user'""")
def body_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a law's body, and of its schedules after that."""
    turn = F.col("turn") % 4
    return layout.page_states(table(spark, d, "conversations"), ["conv_id"], "turn", turn == 1, turn == 3, F.col("role") == "user").select("conv_id", "turn", "state")


@book.query("""WITH RECURSIVE r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, ceil(length(text) / 4.0)::BIGINT AS t FROM conversations), h AS (SELECT conv_id, text AS header, 300 - t AS room FROM r WHERE i = 1),
    f AS (SELECT r.conv_id, i, text, 0 AS piece, t AS size FROM r WHERE i = 2
          UNION ALL SELECT r.conv_id, r.i, r.text, f.piece + CASE WHEN f.size > 0 AND f.size + r.t > room THEN 1 ELSE 0 END, CASE WHEN f.size > 0 AND f.size + r.t > room THEN r.t ELSE f.size + r.t END FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1 JOIN h ON h.conv_id = f.conv_id)
    SELECT conv_id, CAST(piece AS INTEGER) AS piece, md5(any_value(header) || chr(10) || string_agg(text, chr(10) ORDER BY i)) AS text_md5 FROM f JOIN h USING (conv_id) GROUP BY conv_id, piece""")
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables too long for a chunk, cut between rows, the header on every piece."""
    return layout.split_tables(table(spark, d, "conversations"), "conv_id", "turn", "text", 300).select("conv_id", "piece", F.md5(F.col("text").cast("binary")).alias("text_md5"))


NUMBERS = Made("SELECT l_orderkey AS law, LIST(CAST(k * 9 + l_suppkey % 60 - 10 AS INT) BY k) AS ns FROM " + NUMBERED + " GROUP BY l_orderkey")


@book.query(f"""WITH RECURSIVE f AS (SELECT law, ns, 1 AS i, 0 AS last, []::INTEGER[] AS found FROM {NUMBERS.duck()} UNION ALL SELECT law, ns, i + 1, CASE WHEN ns[i] > last AND ns[i] <= last + 50 THEN ns[i] ELSE last END, CASE WHEN ns[i] > last AND ns[i] <= last + 50 THEN list_append(found, ns[i]) ELSE found END FROM f WHERE i <= len(ns))
    SELECT law, found AS sections FROM f WHERE i = len(ns) + 1""")
def contents_entries(spark: SparkSession, d: str) -> DataFrame:
    """The section numbers of a table of contents, stray page numbers passed over."""
    return NUMBERS.spark(spark, d).select("law", layout.listed_numbers(F.col("ns")).alias("sections"))


ANSWERS = Made("""SELECT o_orderkey AS id, substring(o_orderpriority, 1, 1) AS grp, o_orderstatus = 'P' OR o_custkey % 7 = 0 AS refused, array('s' || o_custkey % 5, 's' || o_orderkey % 3) AS cited, CASE WHEN o_custkey % 11 = 0 THEN 'yes.' WHEN o_custkey % 11 < 6 THEN 'Correct' WHEN o_custkey % 11 < 9 THEN 'no' END AS judge_a,
    CASE WHEN o_orderkey % 5 = 0 THEN 'no' WHEN o_orderkey % 5 < 4 THEN ' TRUE ' END AS judge_b FROM {orders} WHERE o_orderkey % 10 <> 3""")
TESTSET = Made("SELECT o_orderkey AS id, array('s' || o_orderkey % 4) AS gold, array('s' || o_custkey % 9) AS acceptable, CASE WHEN o_orderkey % 3 = 0 THEN 'q' || (o_orderkey - 1) END AS source_id, 'q' || o_orderkey AS name FROM {orders} WHERE o_orderkey % 10 <> 7")
_E2E = f"(SELECT a.*, NOT refused AND len(list_intersect(cited, list_concat(gold, acceptable))) > 0 AS correct FROM {ANSWERS.duck()} a JOIN {TESTSET.duck()} USING (id))"


def _e2e(spark: SparkSession, d: str) -> DataFrame:
    rows = ANSWERS.spark(spark, d).join(TESTSET.spark(spark, d), "id")
    return rows.withColumn("correct", review.citation_correct(F.col("refused"), F.col("cited"), F.col("gold"), F.col("acceptable")))


@book.query(f"""SELECT grp, count(*) AS n, round(avg((NOT refused)::INT), 4) AS answered, round(avg(correct::INT), 4) AS correct, round(avg(CASE WHEN NOT refused THEN correct::INT END), 4) AS correct_answered
    FROM (SELECT unnest(list_filter([grp, CASE WHEN grp <> '5' THEN 'in_scope' END, 'all'], lambda x: x IS NOT NULL)) AS grp, refused, correct FROM {_E2E}) GROUP BY grp""")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answered and rightly cited, by group, in scope and over all: answers joined with the test set by id."""
    return review.answer_rates(_e2e(spark, d), "grp", "5")


_YES = "lower(regexp_replace({0}, '[\\s.!]', '', 'g')) IN ('yes', 'true', 'ok', 'correct')"


@book.query(f"""SELECT count(*) FILTER (a = b) AS agreed, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS checked, round(count(*) FILTER (a = b) / count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 4) AS rate FROM (SELECT {_YES.format('judge_a')} AS a, {_YES.format('judge_b')} AS b FROM {ANSWERS.duck()})""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two judges agree, their words read as yes or no."""
    rows = ANSWERS.spark(spark, d).select(review.verdict(F.col("judge_a")).alias("a"), review.verdict(F.col("judge_b")).alias("b"))
    return review.agreement(rows, "a", "b")


ITEMS = Made("SELECT o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'machine' ELSE 'open' END AS status, o_custkey % 3 > 0 AS ok FROM {orders}")
REVIEWS = Made("SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'fixed' ELSE 'wrong' END AS answer FROM {orders} WHERE o_orderkey % 4 = 0")


@book.query(f"SELECT id, CASE WHEN status = 'human' THEN 'human' WHEN ok AND coalesce(answer IN ('correct', 'fixed'), false) THEN 'reviewed' WHEN ok THEN 'machine' ELSE 'open' END AS status, ok FROM {ITEMS.duck()} LEFT JOIN {REVIEWS.duck()} USING (id)")
def reviewed_items(spark: SparkSession, d: str) -> DataFrame:
    """The review status of each item; what a person has set stays."""
    return review.reviewed_status(ITEMS.spark(spark, d), REVIEWS.spark(spark, d), "id")


@book.query(f"SELECT p.name, coalesce(list_sort(list(c.name) FILTER (c.name IS NOT NULL)), []) AS children FROM {TESTSET.duck()} p LEFT JOIN {TESTSET.duck()} c ON c.source_id = p.name WHERE p.source_id IS NULL GROUP BY p.name")
def translations_of(spark: SparkSession, d: str) -> DataFrame:
    """Each source question with its translations."""
    return review.with_children(TESTSET.spark(spark, d).select("name", "source_id"), "name", "source_id").select("name", "children")


POOL = Made("SELECT DISTINCT user_id AS question_id, event_id % 50 AS chunk_id FROM {events} WHERE event_type = 'purchase'")
NAMED = Made("SELECT DISTINCT user_id AS question_id, CAST(2010 + user_id % 10 AS INT) AS tax_year, event_id % 12 AS ord, event_id % 12 AS section_id FROM {events}")
PIECES = Made("SELECT doc_id % 12 AS section_id, doc_id % 50 AS chunk_id, min(CAST(2005 + doc_id % 8 AS INT)) AS tax_year_from, CASE WHEN doc_id % 50 % 2 = 0 THEN 2014 END AS tax_year_to FROM {documents} GROUP BY doc_id % 12, doc_id % 50")


@book.query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ord, section_id) AS n FROM {NAMED.duck()}), f AS (SELECT question_id, section_id, chunk_id FROM n JOIN {PIECES.duck()} USING (section_id) WHERE n <= 6 AND tax_year_from <= tax_year AND (tax_year_to IS NULL OR tax_year_to >= tax_year))
    SELECT question_id, section_id, chunk_id FROM f ANTI JOIN {POOL.duck()} USING (question_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY question_id, section_id ORDER BY chunk_id) <= 3""")
def glossary_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that the sections of glossary terms add to a question's pool."""
    return review.more_pieces(POOL.spark(spark, d), NAMED.spark(spark, d), PIECES.spark(spark, d))


PASSAGES = Made("SELECT l_orderkey AS question_id, CASE l_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ur' ELSE 'roman_ur' END AS language, l_partkey % 4 AS chunk_id, k AS passage_no, l_discount - 0.04 AS to_question, l_tax - 0.02 AS to_rewrite FROM " + NUMBERED)


@book.query(f"SELECT question_id, chunk_id, greatest(coalesce(max(CASE WHEN language <> 'en' THEN greatest(to_question, to_rewrite) ELSE to_question END), 0), 0)::DOUBLE AS score FROM {PASSAGES.duck()} GROUP BY question_id, chunk_id")
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's score: its best passage, against the rewrite too where the question is not English."""
    return review.policy_scores(PASSAGES.spark(spark, d))


SOURCES = Made("SELECT l_orderkey AS question_id, k AS rank, 'Ordinance' AS law, CASE l_suppkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'schedule' WHEN 2 THEN 'rule' ELSE 'section' END AS kind, CAST(l_partkey AS STRING) AS section, CASE WHEN l_suppkey % 3 > 0 THEN l_returnflag ELSE '' END AS title, CASE WHEN l_suppkey % 5 = 0 THEN '(' || k || ')' END AS subs, l_linestatus || k AS text FROM " + NUMBERED)


@book.query(f"""SELECT question_id, string_agg('[' || rank || '] ' || law || ', ' || CASE kind WHEN 'table' THEN 'Table' WHEN 'schedule' THEN 'Schedule' WHEN 'rule' THEN 'Rule' ELSE 'Section' END || ' ' || section || coalesce(subs, '') || CASE WHEN title <> '' THEN ', ' || title ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS prompt FROM {SOURCES.duck()} GROUP BY question_id""")
def source_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The numbered sources of a prompt, each under its label."""
    label = review.source_label(F.col("law"), F.col("kind"), F.col("section"), F.col("title"), F.col("subs"))
    return review.source_blocks(SOURCES.spark(spark, d).withColumn("label", label), "question_id", "rank", "label", "text")


ERRORS = Made("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 500 END AS INT) AS status, CASE event_id % 5 WHEN 0 THEN 'Quota: requests PER DAY reached' WHEN 1 THEN 'Rate limit: try again in ' || user_id % 60 || '.5s' ELSE 'failed; retry after ' || user_id || ' s' END AS message, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 30 AS STRING) WHEN event_id % 7 = 1 THEN 'soon' END AS header FROM {events}")


@book.query(f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'daily_limit' WHEN event_id % 5 = 1 THEN 'rate_limit' WHEN event_id % 5 < 4 THEN 'unavailable' ELSE 'other' END AS kind,
    coalesce(try_cast(header AS DOUBLE), CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN (regexp_extract(message, 'in ([0-9.]+)s', 1))::DOUBLE ELSE regexp_extract(message, 'after ([0-9]+) s', 1)::DOUBLE END) AS wait FROM {ERRORS.duck()}""")
def call_errors(spark: SparkSession, d: str) -> DataFrame:
    """Why model calls failed, and how long to wait."""
    return ERRORS.spark(spark, d).select("event_id", review.error_kind(F.col("status"), F.col("message")).alias("kind"), review.retry_seconds(F.col("header"), F.col("message")).alias("wait"))


_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@book.query(f"""SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT page_id, sha1(unhex('{_NAMESPACE.replace('-', '')}') || encode(url)) AS h FROM pages)""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of pages."""
    return table(spark, d, "pages").select("page_id", review.uuid5(_NAMESPACE, F.col("url")).alias("point_id"))


@book.query("""SELECT conv_id, turn, CASE WHEN length(f) <= 300 THEN f ELSE substr(f, 1, 299) || '…' END AS preview FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS f FROM conversations)""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    """Texts in one line of at most 300 characters."""
    return table(spark, d, "conversations").select("conv_id", "turn", review.preview(F.col("text")).alias("preview"))


REQUESTS = Made("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'hi' ELSE 'question ' || event_id END AS question, CAST(1998 + event_id % 45 AS INT) AS tax_year, CASE event_id % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'sideways' END AS rating, CAST(event_id % 1200 AS INT) AS comment_length FROM {events}")


@book.query(f"""SELECT event_id, list_filter([CASE WHEN length(question) NOT BETWEEN 3 AND 1000 THEN 'question' END, CASE WHEN tax_year NOT BETWEEN 2003 AND 2035 THEN 'tax_year' END, CASE WHEN rating NOT IN ('up', 'down') THEN 'rating' END, CASE WHEN comment_length > 1000 THEN 'comment' END], lambda x: x IS NOT NULL) AS broken FROM {REQUESTS.duck()}""")
def request_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits that each request breaks."""
    rules = F.array(
        F.when(~F.length("question").between(3, 1000), "question"), F.when(~F.col("tax_year").between(2003, 2035), "tax_year"),
        F.when(~F.col("rating").isin("up", "down"), "rating"), F.when(F.col("comment_length") > 1000, "comment"))
    return REQUESTS.spark(spark, d).select("event_id", F.array_compact(rules).alias("broken"))


QUESTIONS = Made("""SELECT 'q' || (o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS id, CASE WHEN o_custkey % 40 = 0 THEN '' ELSE 'q ' || o_custkey END AS question, CASE o_custkey % 30 WHEN 0 THEN 'fr' WHEN 1 THEN 'ur' ELSE 'en' END AS language, CASE o_custkey % 25 WHEN 0 THEN 'out_of_scope' ELSE 'fbr' END AS grp,
    CASE WHEN o_custkey % 6 = 0 THEN array('s999') WHEN o_custkey % 7 = 0 THEN array('WHT-1') ELSE array('s' || o_custkey % 5) END AS gold, CASE WHEN o_custkey % 20 = 0 THEN '' ELSE 'answer for a non-filer' END AS reference, CAST(2000 + o_custkey % 40 AS INT) AS tax_year, CASE WHEN o_custkey % 33 = 0 THEN 'train' ELSE 'dev' END AS split FROM {orders}""")
_KNOWN = "'s0', 's1', 's2', 's3', 'WHT-1'"


@book.query(f"""WITH t AS (SELECT * FROM {QUESTIONS.duck()}) SELECT 'duplicate id' AS rule, id FROM t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'empty question', id FROM t WHERE question = '' UNION ALL SELECT 'language', id FROM t WHERE language NOT IN ('en', 'ur', 'roman_ur')
    UNION ALL SELECT 'unknown section', id FROM t WHERE len(list_filter(gold, lambda g: g NOT IN ({_KNOWN}))) > 0 UNION ALL SELECT 'no reference', id FROM t WHERE reference = '' AND grp <> 'out_of_scope' UNION ALL SELECT 'tax year', id FROM t WHERE tax_year NOT BETWEEN 2003 AND 2035
    UNION ALL SELECT 'split', id FROM t WHERE split NOT IN ('dev', 'test') UNION ALL SELECT 'gold out of scope', id FROM t WHERE grp = 'out_of_scope' AND len(gold) > 0 UNION ALL SELECT 'needs list check', id FROM t WHERE len(list_filter(gold, lambda g: starts_with(g, 'WHT'))) > 0 OR contains(question, 'filer')""")
def testset_violations(spark: SparkSession, d: str) -> DataFrame:
    """The integrity rules that items of a test set break, one row each, and the items that need the list of taxpayers."""
    t = QUESTIONS.spark(spark, d)
    known = F.array(F.lit("s0"), F.lit("s1"), F.lit("s2"), F.lit("s3"), F.lit("WHT-1"))
    rules = {
        "empty question": F.col("question") == "", "language": ~F.col("language").isin("en", "ur", "roman_ur"), "unknown section": F.size(F.array_except("gold", known)) > 0,
        "no reference": (F.col("reference") == "") & (F.col("grp") != "out_of_scope"), "tax year": ~F.col("tax_year").between(2003, 2035), "split": ~F.col("split").isin("dev", "test"),
        "gold out of scope": (F.col("grp") == "out_of_scope") & (F.size("gold") > 0), "needs list check": F.exists("gold", lambda g: g.startswith("WHT")) | filer_question(F.col("question")),
    }
    broken = t.select("id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("rule")).select("rule", "id")
    twice = t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("rule"), "id")
    return broken.unionByName(twice)


@book.query("SELECT max(t) AS most, sum(t)::BIGINT AS tokens, max(t) <= 800 AS fits, min(y)::INTEGER AS first_year FROM (SELECT ceil(length(text) / 4.0)::BIGINT AS t, 2005 + doc_id % 15 AS y FROM documents)")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """The largest chunk, the tokens of all, whether each fits, and the first year covered."""
    rows = table(spark, d, "documents").select(estimate_tokens(F.col("text")).alias("t"), (F.col("doc_id") % 15 + 2005).alias("y"))
    return rows.agg(F.max("t").alias("most"), F.sum("t").alias("tokens"), (F.max("t") <= 800).alias("fits"), F.min("y").cast("int").alias("first_year"))


FILES = Made("SELECT page_id, sha2(html, 256) AS sha256, CASE WHEN page_id % 11 = 0 THEN 'x' ELSE sha2(html, 256) END AS on_disk, 'e' || page_id % 5 AS etag, CASE WHEN page_id % 4 > 0 THEN 'Mon' END AS modified, length(html) AS length FROM {pages} WHERE page_id % 6 > 0".replace("sha2(html, 256)", "md5(html)"))
OFFERED = Made("SELECT page_id, 'e' || (page_id % 5 + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END) AS etag, CASE WHEN page_id % 4 > 0 AND page_id % 17 > 0 THEN 'Mon' END AS modified, length(html) AS length FROM {pages}")


@book.query(f"""SELECT page_id, reason FROM (SELECT o.page_id, CASE WHEN f.page_id IS NULL THEN 'new' WHEN f.sha256 <> f.on_disk THEN 'damaged' WHEN o.etag IS DISTINCT FROM f.etag OR o.modified IS DISTINCT FROM f.modified OR o.length IS DISTINCT FROM f.length THEN 'changed' END AS reason FROM {OFFERED.duck()} o LEFT JOIN {FILES.duck()} f USING (page_id)) WHERE reason IS NOT NULL""")
def files_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The files that a conditional download loads again, and why."""
    return to_fetch(FILES.spark(spark, d), OFFERED.spark(spark, d), "page_id")


_RUNS = {"2026-09-26": "o_orderkey % 2 = 0", "2026-10-02": "o_orderkey % 2 = 1"}


@book.query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2026-09-26-e2e' ELSE '2026-10-02-e2e' END AS report, o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'llm ' || o_custkey ELSE 'plain ' || o_orderkey END AS answer FROM orders WHERE o_orderstatus <> 'P'""")
def report_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of all dated reports: written as reports, read again as one scan, the model's answer before the plain one."""
    folder = shared_folder(spark, "reports")
    o = table(spark, d, "orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("llm "), "o_custkey")).alias("answer_llm"), F.concat(F.lit("plain "), "o_orderkey").alias("answer"), (F.col("o_orderstatus") == "P").alias("refused"))
    for date, own in _RUNS.items():
        write_report(o.filter(own).groupBy((F.col("o_custkey") % 64).alias("part")).agg(F.collect_list(row).alias("rows")).select("rows"), folder, "e2e", date)
    rows = read_reports(spark, folder, "rows array<struct<id:bigint,answer_llm:string,answer:string,refused:boolean>>").select("report", F.explode("rows").alias("r"))
    return rows.filter("NOT r.refused").select("report", "r.id", F.coalesce("r.answer_llm", "r.answer").alias("answer"))


@book.query("""SELECT CAST(ts AS DATE) AS day, count(*) AS asks, count(*) FILTER (value > 50) AS refused, round(avg(user_id % 40), 4) AS total_ms FROM events GROUP BY 1""")
def ask_log_days(spark: SparkSession, d: str) -> DataFrame:
    """The log of asks, appended in two writes and read again: asks, refusals and mean time of each day."""
    path = shared_folder(spark, "asks")
    e = table(spark, d, "events")
    asks = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("refused"), F.create_map(F.lit("total"), (F.col("user_id") % 40).cast("int")).alias("timings_ms"))
    append_log(asks.filter("id % 2 = 0"), path)
    append_log(asks.filter("id % 2 = 1"), path)
    log = spark.read.parquet(path)
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("asks"), F.count(F.when(F.col("refused"), 1)).alias("refused"), F.round(F.avg(F.col("timings_ms")["total"]), 4).alias("total_ms"))


VERSIONS = Made("SELECT c_nationkey AS site, c_custkey AS version FROM {customer}")


@book.query(f"""SELECT site, max(version) AS version FROM {VERSIONS.duck()} GROUP BY site HAVING max(version) > 100 + site * 55""")
def newer_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each site where it is newer than the configured one."""
    newest = VERSIONS.spark(spark, d).groupBy("site").agg(F.max("version").alias("version"))
    return newest.filter(F.col("version") > F.col("site") * 55 + 100)


@book.query("""SELECT user_id, event_id, list_filter([event_type, CASE WHEN value > 50 THEN 'high' END], lambda x: x IS NOT NULL) AS marks, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS asks FROM events""")
def first_asks(spark: SparkSession, d: str) -> DataFrame:
    """Which events of a user reach a model: the first of each key; later ones are replayed from its log."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    return table(spark, d, "events").select("user_id", "event_id", F.array_compact(F.array("event_type", F.when(F.col("value") > 50, "high"))).alias("marks"), first.alias("asks"))


TERMS = Made("SELECT p_partkey AS ord, upper(substring(p_name, 1, 6)) || '| Second ' || p_size || ' |' AS roman, CASE WHEN p_partkey % 3 = 0 THEN 'ا|ب' END AS urdu, ' ' || p_name || ' ' AS english, CASE WHEN p_partkey % 2 = 0 THEN 's1  s' || p_size END AS section_ids, CASE p_partkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' END AS search, CASE WHEN p_partkey % 5 = 0 THEN 'a \"note\", with commas' END AS notes FROM {part}")


@book.query(f"""SELECT list_filter(list_transform(string_split(lower(roman), '|'), lambda x: trim(x)), lambda x: x <> '') AS roman, list_filter(string_split(coalesce(urdu, ''), '|'), lambda x: x <> '') AS urdu, trim(english) AS english,
    list_filter(string_split_regex(coalesce(section_ids, ''), '\\s+'), lambda x: x <> '') AS section_ids, coalesce(lower(trim(search)) = 'yes', false) AS search, coalesce(trim(notes), '') AS notes FROM {TERMS.duck()}""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary, written as CSV and read with its lists taken apart."""
    path = shared_folder(spark, "glossary")
    TERMS.spark(spark, d).drop("ord").write.option("header", True).option("escape", '"').csv(path)
    return read_glossary(spark, path)


@book.query("""SELECT conv_id AS page, turn::DOUBLE AS y, text, role = 'user' AS bold_start FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, -1, 'note ' || min(turn), NULL FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and footnotes of pages, written as JSON lines and read with the declared schema."""
    path = shared_folder(spark, "pages")
    c = table(spark, d, "conversations").filter("text IS NOT NULL")
    line = F.struct(F.col("conv_id").cast("int").alias("page"), F.col("turn").cast("double").alias("y"), F.lit(72.0).alias("x"), "text", (F.col("role") == "user").alias("bold_start"))
    pages = c.groupBy(F.col("conv_id").cast("int").alias("page")).agg(F.collect_list(line).alias("lines"), F.min("turn").alias("t"))
    note = F.struct("page", F.lit("1").alias("marker"), F.concat(F.lit("note "), "t").alias("text"))
    pages.select("page", "lines", F.array(note).alias("footnotes")).write.json(path)
    lines, notes = read_pages(spark, path)
    lines = lines.select(F.col("page").cast("bigint").alias("page"), "y", "text", "bold_start")
    return lines.unionByName(notes.select(F.col("page").cast("bigint").alias("page"), F.lit(-1.0).alias("y"), "text", F.lit(None).cast("boolean").alias("bold_start")))


@book.query("""SELECT doc_id, lang AS law, 2020 + doc_id % 3 AS year, length(text) AS n FROM documents WHERE lang = 'en' AND doc_id % 3 = 1""")
def snapshot_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One law's snapshot of one version: written side by side with the others, read by its folders alone."""
    path = shared_folder(spark, "snapshots")
    docs = table(spark, d, "documents").filter("lang IS NOT NULL")
    version = F.concat((F.col("doc_id") % 3 + 2020).cast("string"), F.lit("-06-30"))
    write_snapshot(docs.select("doc_id", F.length("text").alias("n"), F.col("lang").alias("law"), version.alias("version_date")), path)
    chosen = spark.read.parquet(path).filter((F.col("law") == "en") & (F.col("version_date") == F.lit("2021-06-30").cast("date")))
    return chosen.select("doc_id", "law", F.year("version_date").cast("bigint").alias("year"), "n")


OUTPUTS = Made("SELECT DISTINCT 'k' || user_id % 50 AS key, user_id % 50 AS output FROM {events} WHERE user_id % 50 < 30")


@book.query("SELECT event_id, CASE WHEN user_id % 70 < 30 AND user_id % 70 IN (SELECT user_id % 50 FROM events) THEN user_id % 70 END AS output, NOT (user_id % 70 < 30 AND user_id % 70 IN (SELECT user_id % 50 FROM events)) AS asked FROM events")
def replayed_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs from the log of earlier runs; only what it doesn't hold is asked."""
    requests = table(spark, d, "events").select("event_id", F.concat(F.lit("k"), F.col("user_id") % 70).alias("key"))
    known, new = cached(requests, OUTPUTS.spark(spark, d), "key")
    return known.join(new.select("event_id", F.lit(True).alias("asked")), "event_id", "left").select("event_id", "output", F.coalesce("asked", F.lit(False)).alias("asked"))
