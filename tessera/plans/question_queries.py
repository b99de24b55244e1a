"""Queries on questions and legal texts: languages, years, references, glossary, definitions, citations, answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import text as t
from tessera.functions.numbers import calculate_udf, missing_numbers_udf, numbers_udf
from tessera.operators import lookup
from tessera.operators.retrieval import bm25, md5_mod
from tessera.operators.serving import flagged, refusal
from tessera.operators.sizes import small
from tessera.plans.fixtures import NUMBERED, Fixture, Made
from tessera.plans.registering import Book, duck_line, quoted
from tessera.plans.retrieval_queries import _BM25
from tessera.plans.summary_queries import _LANG
from tessera.sources.shared import written
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

QUESTIONS = Fixture("question_id int, text string", [
    (1, "What is the rate under section 149 and rule 5 for tax year 2025?"), (2, "salary par kitna tax hai aur kab dena hai"), (3, "تنخواہ پر ٹیکس سال ۲۰۲۶ میں کتنا ہے؟ دفعہ ۱۴۹"),
    (4, "u/s 236k property purchase 2024-25"), (5, "section 999Z please"), (6, "what is imputable income?"), (7, "sections 149 and 150"), (8, "salary 149 hai"), (9, "non filer ki gaari ka token tax"),
    (10, "Definition of small company under the law"), (11, "tax year 2000-50"), (12, "what does \"business\" include"), (13, "what is the tax rate"), (14, "TY2024 sec. 4ab, Section 4AB and dafa 7e"), (15, ""), (16, "khareedna makan 2023/24, profit on debt"),
])
SECTIONS = Fixture("kind string, number string, section_id string", [("section", n, f"L-s{n}") for n in ("149", "236K", "4AB", "7E", "2")] + [("rule", "5", "R-r5")])


@book.query(f"SELECT 'q' || question_id AS id, {_LANG} AS language FROM {QUESTIONS.duck()} UNION ALL SELECT 'c' || conv_id || '-' || turn, {_LANG} FROM conversations")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """The language of questions and turns: English, Urdu or Roman Urdu."""
    q = QUESTIONS.spark(spark).select(F.concat(F.lit("q"), "question_id").alias("id"), "text")
    c = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return q.unionByName(c).select("id", t.language(F.col("text")).alias("language"))


#: A question for each customer, by twelve patterns (t) with numbers n and r, letters s and a year y: what the rules should find in it follows from these.
RULED = Made("""SELECT concat('r', k) AS question_id, k, t, n, s, r, y, CASE t WHEN 0 THEN concat('What is the rate under section ', n, s, ' for tax year ', y, '?') WHEN 1 THEN concat('u/s ', n, lower(s), ' and rule ', r, ' in ', y - 1, '-', y - 2000) WHEN 2 THEN concat('khareed ka tax saal ', y, ' batao') WHEN 3 THEN concat('dafa no. ', n, ' aur qaida ', r)
    WHEN 4 THEN concat('Salary of a non-filer, sections ', n, ' and ', n + 1) WHEN 5 THEN concat('دفعہ ', n, ' ٹیکس سال ', y) WHEN 6 THEN concat('property tax on buying a house in ', y) WHEN 7 THEN concat('the rate of property tax in city ', n) WHEN 8 THEN concat('sales tax on services in sindh, form ', n)
    WHEN 9 THEN concat('what does the upcoming federal budget of ', y, ' say') WHEN 10 THEN concat('what is ', CASE WHEN k % 24 < 12 THEN 'imputable income' ELSE 'a small company' END, '?') ELSE concat('the day ', n, ' of section ', n, 'Z and the budget ', y) END AS text
    FROM (SELECT c_custkey AS k, CAST(c_custkey % 12 AS INT) AS t, CAST(c_custkey % 290 AS INT) + 1 AS n, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'KB' END AS s, CAST(c_custkey % 90 AS INT) + 1 AS r, CAST(2015 + c_custkey % 14 AS INT) AS y FROM {customer}) x""")
#: The fixed questions, which hold the awkward cases, every turn of the conversations, in which the rules find nothing, and the questions above.
ASKED = f"(SELECT 'q' || question_id AS question_id, text FROM {QUESTIONS.duck()} UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT question_id, text FROM {RULED.duck()})"
#: Their ids, for the SQL of rules.
_IDS = f"(SELECT question_id FROM {ASKED})"


def asked_rows(spark: SparkSession, d: str) -> DataFrame:
    fixed = QUESTIONS.spark(spark).select(F.concat(F.lit("q"), "question_id").alias("question_id"), "text")
    said = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("question_id"), "text")
    return fixed.unionByName(said).unionByName(RULED.spark(spark, d).select("question_id", "text"))


#: What the fixed questions name, by hand.
_YEARS_NAMED = Fixture("question_id string, tax_year int", [("q1", 2025), ("q3", 2026), ("q4", 2025), ("q11", 2000), ("q14", 2024), ("q16", 2024)])
_YEARS_WRITTEN = Fixture("question_id string, year int", [("q1", 2025), ("q3", 2026), ("q4", 2025)])
_NAMED = Fixture("question_id string, ord int, kind string, number string", [
    ("q1", 0, "section", "149"), ("q1", 1, "rule", "5"), ("q3", 0, "section", "149"), ("q4", 0, "section", "236K"), ("q5", 0, "section", "999Z"), ("q7", 0, "section", "149"), ("q14", 0, "section", "4AB"), ("q14", 1, "section", "7E"),
])


@book.query(f"SELECT question_id, f.tax_year FROM {_IDS} LEFT JOIN (SELECT * FROM {_YEARS_NAMED.duck()} UNION ALL SELECT question_id, y FROM {RULED.duck()} WHERE t IN (0, 1, 2, 5)) f USING (question_id)")
def tax_year_extract(spark: SparkSession, d: str) -> DataFrame:
    """The tax year that a question names."""
    return asked_rows(spark, d).select("question_id", t.tax_year(F.col("text")).alias("tax_year"))


@book.query(f"""SELECT i.question_id, CAST(v.y AS INTEGER) AS year, f.year IS NOT NULL AS written FROM {_IDS} i CROSS JOIN (VALUES (2024), (2025), (2026)) v(y)
    LEFT JOIN (SELECT * FROM {_YEARS_WRITTEN.duck()} UNION ALL SELECT question_id, y FROM {RULED.duck()} WHERE t IN (0, 1, 2, 5, 9, 11)) f ON f.question_id = i.question_id AND f.year = v.y""")
def written_years(spark: SparkSession, d: str) -> DataFrame:
    """Whether questions write a year as a tax year, for three years."""
    years = spark.range(2024, 2027).select(F.col("id").cast("int").alias("year"))
    return asked_rows(spark, d).crossJoin(F.broadcast(years)).select("question_id", "year", t.written_as_tax_year(F.col("text"), F.col("year")).alias("written"))  # three rows


#: Sections and rules that are there: the fixed ones, and every other number that customers have.
HELD = Made("""SELECT DISTINCT 'section' AS kind, CAST(c_custkey % 290 + 1 AS STRING) AS number, concat('L-s', c_custkey % 290 + 1) AS section_id FROM {customer} WHERE c_custkey % 2 = 0 AND c_custkey % 290 <> 148 UNION ALL SELECT DISTINCT 'rule', CAST(c_custkey % 90 + 1 AS STRING), concat('R-r', c_custkey % 90 + 1) FROM {customer} WHERE c_custkey % 90 % 4 = 1""")
_HELD = f"(SELECT * FROM {SECTIONS.duck()} UNION ALL SELECT * FROM {HELD.duck()})"
_REFS = f"""(SELECT * FROM {_NAMED.duck()} UNION ALL SELECT question_id, 0, 'section', n || CASE WHEN t = 11 THEN 'Z' WHEN t < 2 THEN s ELSE '' END FROM {RULED.duck()} WHERE t IN (0, 1, 3, 4, 5, 11) UNION ALL SELECT question_id, 1, 'rule', r::VARCHAR FROM {RULED.duck()} WHERE t IN (1, 3))"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return SECTIONS.spark(spark).unionByName(HELD.spark(spark, d))


@book.query(f"SELECT r.question_id, r.ord, r.kind, r.number, s.section_id FROM {_REFS} r LEFT JOIN {_HELD} s USING (kind, number)")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The sections and rules that questions name."""
    return lookup.named_sections(asked_rows(spark, d), _sections(spark, d))


@book.query(f"SELECT r.question_id, r.kind || ' ' || r.number AS missing FROM {_REFS} r ANTI JOIN {_HELD} s USING (kind, number)")
def missing_refs_anti(spark: SparkSession, d: str) -> DataFrame:
    """References to sections that the law doesn't have."""
    found = lookup.named_sections(asked_rows(spark, d), _sections(spark, d))
    return found.filter("section_id IS NULL").select("question_id", F.concat_ws(" ", "kind", "number").alias("missing"))


GLOSSARY = Fixture("ord int, roman array<string>, urdu array<string>, english string", [
    (1, ["tankhwah", "salary"], ["تنخواہ"], "salary"), (2, ["filer"], ["فائلر"], "filer"), (3, ["non filer", "non-filer"], [], "person not on the list"), (4, ["khareed", "kharid"], ["خرید"], "purchase"), (5, ["token tax"], [], "motor vehicle tax"), (6, ["kab"], ["کب"], "due date"),
])


@book.query(rf"""WITH g AS (SELECT *, '(?:^|[^a-z])(' || list_aggregate(list_transform(roman, lambda x: regexp_replace(x, '([-.])', '\\\1', 'g') || CASE WHEN length(x) >= 5 AND regexp_matches(x, '[a-z]$') THEN '[a-z]{{0,3}}' ELSE '' END), 'string_agg', '|') || ')(?:[^a-z]|$)' AS p FROM {GLOSSARY.duck()}),
    h AS (SELECT question_id, english, ord, coalesce(nullif(regexp_extract(lower(text), p, 1), ''), list_filter(urdu, lambda u: regexp_matches(text, '(?:^|[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿])' || u))[1]) AS term FROM {ASKED}, g)
    SELECT question_id, english, term, CAST(row_number() OVER (PARTITION BY question_id ORDER BY length(term) DESC, ord) AS INTEGER) AS rank FROM h WHERE term IS NOT NULL""")
def glossary_regex_join(spark: SparkSession, d: str) -> DataFrame:
    """Glossary rows that questions match, longest first."""
    return lookup.glossary_matches(asked_rows(spark, d), GLOSSARY.spark(spark))


TERMS = Fixture("term string, clause string", [("income", "29"), ("imputable income", "28A"), ("company", "12"), ("small company", "59AB"), ("business", "10"), ("tax", "63")])


_ASKED_FOR = Fixture("question_id string, term string, clause string", [("q6", "imputable income", "28A"), ("q10", "small company", "59AB"), ("q12", "business", "10")])


@book.query(f"SELECT * FROM {_ASKED_FOR.duck()} UNION ALL SELECT question_id, CASE WHEN k % 24 < 12 THEN 'imputable income' ELSE 'small company' END, CASE WHEN k % 24 < 12 THEN '28A' ELSE '59AB' END FROM {RULED.duck()} WHERE t = 10")
def definition_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The defined term that a question asks for."""
    return lookup.asked_definitions(asked_rows(spark, d), TERMS.spark(spark))


ANSWERS = Fixture("answer_id string, text string, n_sources int, declared array<int>, sections array<string>", [
    ("a1", "The rate is 5% [1]. It applies to all [2, 7].", 3, [3, 9], ["149", "150", "151"]), ("a2", "Nothing cited here at all.", 2, [], ["1", "2"]), ("a3", "Twice [3] and [3], then [1,2] .", 3, [2], ["12", "13", "14"]),
    ("a4", "Bad [0] [9].", 4, [], []), ("a5", "Mixed [2] then [5, 2, 4].", 4, [4, 1], ["a", "b"]), ("a6", "By section 12 each payer withholds a part [1]. Section 7B has another rule for that.", 2, [], ["12", "13"]),
    ("a7", "", 2, [], []), ("a8", "سوال کا جواب یہ ہے [1]۔ دوسرا جملہ بھی کافی لمبا ہے۔", 2, [], ["1", "2"]),
])
#: Besides the fixed answers: every turn of the conversations with markers written behind it.
_ANSWERS = f"(SELECT * FROM {ANSWERS.duck()} UNION ALL SELECT 'c' || conv_id || '-' || turn, text || ' [' || turn || '] See section ' || conv_id % 300 || ' [9, 2].', 4, [3], ['7', '8', '9', '10'] FROM conversations)"
_MARK = t._MARK


def _distinct(items: str, kind: str) -> str:
    """The distinct items of an SQL list in order of first use."""
    return f"list_reduce(list_prepend([]::{kind}[], list_transform({items}, lambda x: [x])), lambda p, q: CASE WHEN list_contains(p, q[1]) THEN p ELSE list_concat(p, q) END)"


@book.query(f"""WITH a AS (SELECT *, string_split_regex(text, '{_MARK}') AS parts, list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda m: list_transform(string_split_regex(m, '\\s*,\\s*'), lambda x: x::INTEGER)) AS marks FROM {_ANSWERS}),
    f AS (SELECT *, flatten(marks) AS ns, list_transform(marks, lambda m: list_filter(m, lambda x: x >= 1 AND x <= n_sources)) AS good FROM a),
    j AS (SELECT *, regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i <= len(good) AND len(good[i]) > 0 THEN '[' || array_to_string(good[i], ', ') || ']' ELSE '' END), ''), '\\s+([.,;:۔])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS clean,
      {_distinct("list_concat(flatten(good), list_filter(declared, lambda x: x >= 1 AND x <= n_sources))", "INTEGER")} AS cited FROM f),
    k AS (SELECT *, list_filter(string_split(regexp_replace(clean, '([.!?۔؟])\\s+', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: length(trim(x)) > 20) AS sentences,
      list_transform(regexp_extract_all(lower({duck_line('clean')}), ' section  ([0-9]{{1,3}}[a-z]{{0,3}}) ', 1), lambda x: upper(x)) AS said, list_transform(list_filter(cited, lambda n: n <= len(sections)), lambda n: upper(sections[n])) AS own FROM j)
    SELECT answer_id, clean AS text, cited, list_filter(ns, lambda x: x < 1 OR x > n_sources) AS invalid, CAST(len(list_filter(sentences, lambda x: NOT regexp_matches(x, '{_MARK}'))) AS INTEGER) AS uncited,
      {_distinct("list_filter(said, lambda x: NOT list_contains(own, x))", "VARCHAR")} AS unsupported FROM k""")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their citations checked: the cleaned text, cited and invalid sources, sentences without a source, and
    sections that no cited source is."""
    turns = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("answer_id"),
        F.concat("text", F.lit(" ["), "turn", F.lit("] See section "), F.col("conv_id") % 300, F.lit(" [9, 2].")).alias("text"), F.lit(4).alias("n_sources"),
        F.array(F.lit(3)).alias("declared"), F.array(*map(F.lit, ("7", "8", "9", "10"))).alias("sections"),
    )
    checked = t.citation_check(F.col("text"), F.col("n_sources"), F.col("declared"), F.col("sections"))
    return ANSWERS.spark(spark).unionByName(turns).select("answer_id", checked.alias("c")).select("answer_id", "c.*")


AMENDMENTS = Fixture("note_id string, text string", [
    ("n1", "Substituted by the Finance Act, 2025. The earlier text read as follows: as inserted by Finance Act, 2010"),
    ("n2", "Added by the Finance Act 2019 and amended by S.R.O. 389(I)/2009"),
    ("n3", "Inserted by the Tax Law (second amendment) Ordinance, 2021"),
    ("n4", "See Income Tax Ordinance, 2001"), ("n5", ""), ("n6", "Finance Supplementary (Amendment) Act, 2018 then Finance Act, 2022 then Finance Act, 2022"),
    ("n7", "by Presidential Order No. 3 of 1990, then S.R.O.428(1)/2002 and SRO No. 516 (I)/2006"), ("n8", "Finance (Amendment) (Supplementary) Act 2017, Presidential Order"),
])
#: Besides the fixed notes: one for every order, with the acts of its year and status.
_NOTES = f"""(SELECT * FROM {AMENDMENTS.duck()} UNION ALL SELECT 'o' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Substituted by the Finance Act, ' WHEN 'O' THEN 'Added by the Tax  Laws (Amendment) Act ' ELSE 'See S.R.O. ' || o_orderkey || '(I)/' END || year(o_orderdate)
    || CASE WHEN o_orderkey % 3 = 0 THEN '. It read as under: Finance Act, 1999' ELSE ' and Finance Supplementary Act, 2018' END FROM orders)"""
_HEAD = f"string_split_regex(lower({duck_line('text')}), ' (?:{'|'.join(q.replace(' ', '  ') for q in t.QUOTES)}) ')[1] || ' '"
_LAWS = f"""WITH h AS (SELECT note_id, {_HEAD} AS h FROM {_NOTES}),
    a AS (SELECT note_id, h, regexp_extract_all(h, {quoted(t._ACT)}, 1) AS names, regexp_extract_all(h, {quoted(t._ACT)}, 2) AS kinds, regexp_extract_all(h, {quoted(t._ACT)}, 3) AS years,
      list_transform(regexp_extract_all(h, {quoted(t._ORDER)}), lambda m: 'SRO ' || regexp_extract(m, {quoted(t._ORDER)}, 1) || '(I)/' || regexp_extract(m, {quoted(t._ORDER)}, 2)) AS orders,
      list_transform(regexp_extract_all(h, {quoted(t._PRESIDENT)}, 1), lambda n: 'Presidential Order' || CASE WHEN n <> '' THEN ' No. ' || n ELSE '' END) AS presidents FROM h),
    z AS (SELECT *, list_filter(range(1, len(names) + 1), lambda i: contains(names[i], '(') OR (kinds[i] <> '' AND starts_with(names[i], 'finance'))) AS use FROM a),
    l AS (SELECT note_id, list_concat(list_transform(use, lambda i: regexp_replace(replace(replace(array_to_string(list_transform(list_filter(string_split(names[i], ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' '), '( ', '('), ' )', ')'), '^Tax Law\\b', 'Tax Laws')
      || CASE WHEN kinds[i] <> '' THEN ' ' || upper(kinds[i][1]) || kinds[i][2:] ELSE '' END || ', ' || years[i]), orders, presidents) AS laws FROM z)"""
_AGE = "coalesce(-try_cast(right(x, 4) AS INTEGER), 0)"


@book.query(f"{_LAWS} SELECT note_id, coalesce((SELECT list(x ORDER BY {_AGE}, x) FROM (SELECT DISTINCT unnest(laws) AS x)), []) AS laws FROM l")
def amendment_laws(spark: SparkSession, d: str) -> DataFrame:
    """The laws that amendment notes name, newest first."""
    return _notes(spark, d).select("note_id", t.amending_laws(F.col("text")).alias("laws"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("o_orderstatus") == "F", "Substituted by the Finance Act, ").when(F.col("o_orderstatus") == "O", "Added by the Tax  Laws (Amendment) Act ").otherwise(F.concat(F.lit("See S.R.O. "), "o_orderkey", F.lit("(I)/")))
    tail = F.when(F.col("o_orderkey") % 3 == 0, ". It read as under: Finance Act, 1999").otherwise(" and Finance Supplementary Act, 2018")
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("note_id"), F.concat(head, F.year("o_orderdate"), tail).alias("text"))
    return AMENDMENTS.spark(spark).unionByName(orders)


PAGES = Made("""SELECT page_id AS site, html || '<a href=\"/x/' || page_id || '.pdf\">Ordinance amended up to ' || (page_id % 31 + 1) || '.' || (page_id % 13 + 1) || '.2024</a> <a href=\"/x/2.pdf\">amended up to ' || (page_id % 28 + 1) || '.02.20' || (page_id % 10 + 15) || '</a> <a href=\"/x/3.pdf\">Ordinance</a>' AS html FROM {pages}""")
_LINK = r'(?i)<a href="([^"]+[.]pdf)">[^<]*amended up to ([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})'


@book.query(f"""WITH l AS (SELECT site, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS day FROM {PAGES.duck()}),
    v AS (SELECT site, url, CAST(try_strptime(day, '%d.%m.%Y') AS DATE) AS version FROM l)
    SELECT site, arg_max(url, struct_pack(a := version, b := url)) AS url, max(version) AS version FROM v WHERE version IS NOT NULL GROUP BY site""")
def version_links_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest version that an index page links; impossible dates are skipped."""
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)).alias("day"))
    rows = PAGES.spark(spark, d).select("site", F.explode(links).alias("l")).select("site", "l.url", F.expr("try_to_date(l.day, 'd.M.yyyy')").alias("version")).filter("version IS NOT NULL")
    return rows.groupBy("site").agg(F.max_by("url", F.struct("version", "url")).alias("url"), F.max("version").alias("version"))


@book.query("""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS heading, len(regexp_extract_all(html, 'href="')) AS n_links FROM pages""")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of each page and its number of links."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("heading"), F.regexp_count("html", F.lit('href="')).cast("long").alias("n_links"))


PARAS = Made("""SELECT event_id AS para_id, user_id AS page, array(CAST(event_id % 3 AS STRING), CAST(event_id % 4 AS STRING)) AS markers FROM {events}""")
FOOT = Made("""SELECT user_id AS page, CAST(event_id % 5 AS STRING) AS marker, 'note ' || event_id AS note FROM {events} WHERE event_type = 'purchase'""")


@book.query(f"SELECT p.para_id, p.marker, f.note FROM (SELECT para_id, page, unnest(markers) AS marker FROM {PARAS.duck()}) p LEFT JOIN {FOOT.duck()} f USING (page, marker)")
def footnote_composite_join(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes of each paragraph by page and marker, of which there may be none or several."""
    return PARAS.spark(spark, d).select("para_id", "page", F.explode("markers").alias("marker")).join(FOOT.spark(spark, d), ["page", "marker"], "left").select("para_id", "marker", "note")


CARDS = Made("""SELECT o_orderkey AS card, CASE o_custkey % 4 WHEN 0 THEN 'Division-I R.' || o_custkey % 12 || ' of the Tenth Schedule' WHEN 1 THEN 'R. ' || o_custkey % 30 || '(a) of Tenth Schedule and R.1, Tenth Schedule' WHEN 2 THEN 'R.5 | Tenth Schedule' ELSE 'no rule, Tenth Schedule' END AS text FROM {orders}""")


@book.query("""SELECT o_orderkey AS card, CAST(i AS INTEGER) AS ord, CAST(r AS INTEGER) AS rule FROM orders, LATERAL (SELECT unnest(CASE o_custkey % 4 WHEN 0 THEN [o_custkey % 12] WHEN 1 THEN [o_custkey % 30, 1] END) AS r, unnest([0, 1]) AS i) WHERE r IS NOT NULL""")
def card_schedule_rules(spark: SparkSession, d: str) -> DataFrame:
    """The schedule rules that rate cards point to."""
    return lookup.card_rules(CARDS.spark(spark, d))


PARTS = Made("""SELECT l_orderkey AS question_id, l_linenumber % 4 AS priority, l_linenumber AS ord, 'c' || l_partkey % 5 AS chunk_id FROM {lineitem}""")
PRESENT = Made("""SELECT DISTINCT l_orderkey AS question_id, 'c' || l_suppkey % 5 AS chunk_id FROM {lineitem} WHERE l_returnflag = 'A'""")


@book.query(f"""WITH f AS (SELECT question_id, chunk_id, min(priority * 100 + ord) AS place FROM {PARTS.duck()} GROUP BY ALL)
    SELECT question_id, chunk_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, chunk_id) AS n FROM f ANTI JOIN {PRESENT.duck()} p USING (question_id, chunk_id)) WHERE n <= 3""")
def companion_sources(spark: SparkSession, d: str) -> DataFrame:
    """Extra sources in order of priority, each once."""
    return lookup.companions(PARTS.spark(spark, d), PRESENT.spark(spark, d))


CANDIDATES = Made("""SELECT DISTINCT l_orderkey AS question_id, 'c' || l_linenumber AS chunk_id, CASE WHEN l_linenumber % 3 = 0 THEN 'lookup' ELSE 'search' END AS via, l_linenumber AS prior FROM {lineitem}""")
PASSAGES = Made("""SELECT l_orderkey AS question_id, 'c' || (l_partkey % 4 + 1) AS chunk_id, round(l_discount * 10 - 0.3, 6) AS score FROM {lineitem}""")


@book.query(f"""WITH b AS (SELECT question_id, chunk_id, max(score) AS best FROM {PASSAGES.duck()} GROUP BY ALL), s AS (SELECT c.*, greatest(coalesce(best, 0), 0) AS score FROM {CANDIDATES.duck()} c LEFT JOIN b USING (question_id, chunk_id))
    SELECT question_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY via = 'lookup' DESC, score DESC, prior) AS INTEGER) AS rank FROM s""")
def rerank_final_order(spark: SparkSession, d: str) -> DataFrame:
    """Pinned chunks first, then by the best passage."""
    return lookup.final_ranks(CANDIDATES.spark(spark, d), PASSAGES.spark(spark, d))


_WINDOWS = """(SELECT d.doc_id, CASE WHEN position(' ' IN substr(text, s + 1)) > 0 THEN s + position(' ' IN substr(text, s + 1)) ELSE s END AS begin, text FROM (SELECT doc_id, text, unnest(range(600, length(text) - 200, 600)) AS s FROM documents) d)"""


@book.query(f"""SELECT doc_id, CAST(begin AS INTEGER) AS begin, md5(substr(text, begin + 1, 800)) AS window_md5 FROM {_WINDOWS}""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 800 characters of every document, begun at words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lookup.windows_of(docs, "text", 800).select("doc_id", "begin", F.md5(F.col("window").cast("binary")).alias("window_md5"))


@book.query(f"""WITH n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT w, ln((SELECT n FROM n) / count(*)) AS v FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS w FROM documents) GROUP BY w),
    q AS (SELECT list_distinct(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY item_id)), '[a-z]{{4,}}')) AS ws FROM benchmark),
    h AS (SELECT doc_id, begin, unnest(list_distinct(regexp_extract_all(lower(substr(text, begin + 1, 800)), '[a-z]{{4,}}'))) AS w FROM {_WINDOWS}),
    s AS (SELECT doc_id, begin, round(sum(v), 6) AS score FROM h JOIN idf USING (w) WHERE list_contains((SELECT ws FROM q), w) GROUP BY ALL)
    SELECT doc_id, CAST(begin AS INTEGER) AS begin, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, begin) AS n FROM s WHERE score > 0) WHERE n = 1""")
def best_window_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The window of each document with the most rare words of all benchmark items."""
    docs = table(spark, d, "documents").select("doc_id", "text")

    def words(text):
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))

    asked = table(spark, d, "benchmark").select(F.explode(words("text")).alias("w")).distinct()
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(words("text")).alias("w")).join(small(asked), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("w", F.ln(F.col("n") / F.col("df")).alias("v"))
    hits = lookup.windows_of(docs, "text", 800).select("doc_id", "begin", F.explode(words("window")).alias("w")).join(small(idf), "w")
    scores = hits.groupBy("doc_id", "begin").agg(F.round(F.sum("v"), 6).alias("score")).filter("score > 0")
    return scores.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "begin"))).filter("k = 1").drop("k")


@book.query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
    SELECT doc_id, len(list_distinct(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda p: regexp_matches(p, '[a-z]{4,}')))) AS n_pairs FROM w""")
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of neighbouring words, one of them of four letters or more."""
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select("doc_id", F.size(F.array_distinct(F.filter(pairs, lambda p: p.rlike("[a-z]{4,}")))).cast("long").alias("n_pairs"))


NUMBERS = Made("""SELECT l_orderkey AS ref_id, LIST(l_discount BY k) AS wanted, LIST(l_tax + 0.0000000001 BY k) AS have FROM """ + NUMBERED + " GROUP BY l_orderkey")


@book.query(f"SELECT ref_id, w FROM (SELECT ref_id, have, unnest(wanted) AS w FROM {NUMBERS.duck()}) WHERE len(list_filter(have, lambda h: abs(h - w) < 1e-9)) = 0")
def tolerance_anti_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an answer that its sources don't have, within a tolerance."""
    rows = NUMBERS.spark(spark, d).select("ref_id", "have", F.explode("wanted").alias("w"))
    return rows.filter(~F.exists("have", lambda h: F.abs(h - F.col("w")) < 1e-9)).select("ref_id", "w")


SPELLED = Fixture("text_id string, text string", [("s1", "Rs. 10 million within fifteen days"), ("s2", "one hundred and eighty-three days"), ("s3", "one and a half million rupees"), ("s4", "the first of two lakh and five thousand"), ("s5", "1,50,000 or 0.8%"), ("s6", "nothing")])


_SPELLED_VALUES = Fixture("text_id string, numbers array<double>", [("s1", [10.0, 15.0, 10_000_000.0]), ("s2", [183.0]), ("s3", [1.5, 1_500_000.0]), ("s4", [1.0, 2.0, 200_005.0, 205_000.0]), ("s5", [0.8, 150_000.0]), ("s6", [])])
#: Each customer's key spelled in words: tens, a unit, hundreds.
IN_WORDS = Made("""SELECT concat('k', k) AS text_id, a, b, c, concat('Rs. ', split_part('twenty thirty forty fifty sixty seventy eighty ninety', ' ', a), '-', split_part('one two three four five six seven eight nine', ' ', b), ' lakh, then ', split_part('one two three four five six seven eight nine', ' ', c), ' hundred days') AS text
    FROM (SELECT c_custkey AS k, CAST(c_custkey % 8 + 1 AS INT) AS a, CAST(c_custkey % 9 + 1 AS INT) AS b, CAST(c_custkey % 7 + 1 AS INT) AS c FROM {customer}) x""")


@book.query(f"""SELECT text_id, numbers FROM {_SPELLED_VALUES.duck()} UNION ALL SELECT text_id, [a * 10 + 10 + b, c * 100, (a * 10 + 10 + b) * 100000]::DOUBLE[] FROM {IN_WORDS.duck()} UNION ALL SELECT 'c' || conv_id || '-' || turn, [] FROM conversations""")
def word_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Quantities in digits and words: of the fixed texts, of each customer's key in words, and of every turn, none of which has any."""
    turns = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("text_id"), "text")
    every = SPELLED.spark(spark).unionByName(IN_WORDS.spark(spark, d).select("text_id", "text")).unionByName(turns)
    return every.select("text_id", numbers_udf(F.col("text")).alias("numbers"))


@book.query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 90 + 3) / 100.0 * round(o_totalprice::DECIMAL(18, 2)) - (o_custkey + 12.5) / 4 END::DOUBLE, 6) AS value FROM orders""")
def written_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Written calculations, one for each order, evaluated without running text; every seventh is none."""
    price = F.format_number(F.round(F.col("o_totalprice").cast("decimal(18,2)")), 0)
    text = F.concat(F.lit("Rs. "), F.col("o_custkey") % 90 + 3, F.lit("% x "), price, F.lit(" − ("), F.col("o_custkey"), F.lit(" + 12.5) / 4"))
    odd = F.when(F.col("o_orderkey") % 7 == 0, F.concat(text, F.lit(" + __import__('os')"))).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", F.round(calculate_udf(odd), 6).alias("value"))


@book.query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [] WHEN o_custkey * 2 + 7 = 5 THEN [] ELSE [(o_custkey * 2 + 7)::DOUBLE] END AS missing FROM orders""")
def numbers_without_source(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of an answer that neither source nor question has: here results that every other answer works out
    wrongly. The section's number and the question's tax year are no quantities."""
    o = table(spark, d, "orders")
    result = F.col("o_custkey") * 2 + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(7)
    answer = F.concat(F.lit("Under section 149 or 150, for tax year 2026: 2 x "), F.col("o_custkey"), F.lit(" = Rs. "), F.format_number(result, 0), F.lit("."))
    question = F.concat(F.lit("I have "), F.col("o_custkey"), F.lit(" rupees"))
    return o.select("o_orderkey", missing_numbers_udf(answer, F.lit("two for every rupee over five"), question, F.lit(2026)).alias("missing"))


STATES = Made("""SELECT event_id AS q, CASE WHEN event_type = 'purchase' THEN 'provincial_tax' ELSE 'income_tax' END AS scope, CAST(2000 + user_id % 32 AS INT) AS year, user_id % 2 AS n_missing, user_id % 3 = 0 AS named, event_id % 4 AS n_candidates,
    CASE WHEN event_id % 4 > 0 THEN value / 100000 END AS top, CASE WHEN event_id % 5 > 0 THEN (event_id % 10) / 10.0 END AS guard FROM {events}""")


@book.query(f"""SELECT q, CASE WHEN coalesce(guard >= 0.5, false) THEN 'PROMPT_INJECTION' WHEN scope <> 'income_tax' THEN 'OUT_OF_SCOPE' WHEN year < 2003 OR year > 2027 THEN 'TAX_YEAR_NOT_COVERED' WHEN n_missing > 0 AND NOT named THEN 'SECTION_NOT_FOUND'
    WHEN n_candidates = 0 OR (top < 0.0005 AND NOT named) THEN 'NO_RELEVANT_SOURCES' END AS reason FROM {STATES.duck()}""")
def refusal_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Why each question is refused, null where it is answered."""
    r = refusal(F.col("scope"), F.col("year"), 2003, 2027, F.col("n_missing"), F.col("named"), F.col("n_candidates"), F.col("top"), 0.0005)
    return STATES.spark(spark, d).select("q", F.when(flagged(F.col("guard")), "PROMPT_INJECTION").otherwise(r).alias("reason"))


_SMALL = ", ".join(f"'{w}'" for w in t.SMALL_WORDS)


@book.query(f"""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({_SMALL}) THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS heading,
    regexp_replace(regexp_replace(regexp_replace(note, '\\[[\\s#*%]*\\]', '', 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM (SELECT p_partkey, upper(p_name) || ' OF  THE ' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' taxpayer’s' ELSE '' END AS title, ' [ ## ]' || p_name || '[]  [ x ]' || chr(9) || p_brand || ' [%*] ' AS note FROM part)""")
def heading_and_clean(spark: SparkSession, d: str) -> DataFrame:
    """Headings in heading case, and texts without empty brackets, for every part."""
    title = F.concat(F.upper("p_name"), F.lit(" OF  THE "), "p_type", F.when(F.col("p_partkey") % 5 == 0, " taxpayer’s").otherwise(""))
    note = F.concat(F.lit(" [ ## ]"), "p_name", F.lit("[]  [ x ]\t"), "p_brand", F.lit(" [%*] "))
    return table(spark, d, "part").select("p_partkey", t.heading_case(title).alias("heading"), t.clean(note).alias("cleaned"))


SETS = Made("""SELECT l_orderkey AS q, LISTN(CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 7 END BY k) AS list_a, LISTN(CASE WHEN l_linestatus = 'F' THEN l_suppkey % 5 END BY k) AS list_b FROM """ + NUMBERED + " GROUP BY l_orderkey")


@book.query(f"""SELECT q, {_distinct("list_concat(list_a, list_b)", "BIGINT")} AS merged, {_distinct("list_filter(list_a, lambda x: list_contains(list_b, x))", "BIGINT")} AS shared, {_distinct("list_filter(list_a, lambda x: NOT list_contains(list_b, x))", "BIGINT")} AS only_a FROM {SETS.duck()}""")
def ordered_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Ordered union, intersection and difference of id lists."""
    return SETS.spark(spark, d).select("q", F.array_distinct(F.concat("list_a", "list_b")).alias("merged"), F.array_intersect("list_a", "list_b").alias("shared"), F.array_except("list_a", "list_b").alias("only_a"))


@book.query("SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    """Orders with returned and accepted lines that aren't finished."""
    lines = table(spark, d, "lineitem")
    r, a = (lines.filter(F.col("l_returnflag") == x).select(F.col("l_orderkey").alias("k")) for x in ("R", "A"))
    return r.intersect(a).subtract(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")))


@book.query(f"""SELECT item_id, len(list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: ('0x' || substr(md5(w), 25, 8))::BIGINT % 64))) AS n_slots FROM benchmark""")
def hashed_embedder(spark: SparkSession, d: str) -> DataFrame:
    """How many of 64 slots the hashing encoder fills for each item."""
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(t.WORDS), F.lit(0))).alias("w"))
    return b.groupBy("item_id").agg(F.count_distinct(md5_mod(F.col("w"), 64)).alias("n_slots"))


#: A model that scores pairs in batches: any function of two columns; here a vectorised one, as a model's would be.
@F.pandas_udf(DoubleType())
def _batch_score(query: pd.Series, passage: pd.Series) -> pd.Series:
    words, held = query.fillna("").str.lower().str.split(), passage.fillna("").str.lower()
    long = [{w for w in ws if len(w) > 4} for ws in words]
    return pd.Series([round(sum(w in p for w in ws) / len(ws), 6) if ws else 0.0 for ws, p in zip(long, held, strict=True)])


@book.query("""WITH p AS (SELECT item_id, b.text AS q, conv_id, turn, c.text AS p FROM benchmark b JOIN conversations c ON c.conv_id = b.item_id)
    SELECT item_id, turn, round(CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: contains(lower(p), w))) / len(ws) END, 6) AS score FROM (SELECT *, list_distinct(list_filter(string_split_regex(lower(q), '\\s+'), lambda w: length(w) > 4)) AS ws FROM p)""")
def arrow_reranker(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored by a vectorised model function, here the share of long query words that the passage holds."""
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), "turn", F.col("text").alias("p"))
    return q.join(c, "item_id").select("item_id", "turn", _batch_score("q", "p").alias("score"))


#: Fixed texts with the awkward cases, and one definition for every part.
LAW_TEXTS = Fixture("ord bigint, chunk_id string, text string", [
    (-3, "s2-1", '(12) “company” means a company as defined in section 80; (10) "business" includes any trade; [(59AB)] “Small  Company” means more'), (-2, "s2-2", "(13) “Company” means another; (29A) ‘imputable income’ in relation to tax; (54) [royalty] means any sum"), (-1, "s3", "no definition\n(7) [the] other\n(8) \"person’s share\" includes all"),
])
#: What the fixed texts define, by hand; and of each part the name that its text was made from.
_DEFINED = Fixture("ord bigint, term string, clause string, chunk_id string, points_to string", [
    (-3, "company", "12", "s2-1", "80"), (-3, "business", "10", "s2-1", None), (-3, "small company", "59AB", "s2-1", None), (-2, "imputable income", "29A", "s2-2", None), (-2, "royalty", "54", "s2-2", None), (-1, "person", "8", "s3", None),
])


@book.query(f"""WITH r AS (SELECT ord, term, clause, chunk_id, points_to FROM {_DEFINED.duck()} UNION ALL SELECT p_partkey, lower(p_name), p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE '' END, 'p' || p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_size || 'B' END FROM part)
    SELECT term, clause, chunk_id, points_to FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY ord) = 1""")
def definition_index(spark: SparkSession, d: str) -> DataFrame:
    """The terms that a law defines, in quotes or brackets, and where definitions point."""
    pk = F.col("p_partkey")
    opened = F.when(pk % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('" means '))).otherwise(F.concat(F.lit("["), F.lower("p_name"), F.lit("] includes ")))
    text = F.concat(F.lit("("), pk, F.when(pk % 3 == 0, "A").otherwise(""), F.lit(") "), opened, "p_type", F.when(pk % 4 < 2, F.concat(F.lit(" as defined in section "), "p_size", F.lit("B"))).otherwise(""), F.lit("; then (1) more"))
    parts = table(spark, d, "part").select(pk.alias("ord"), F.concat(F.lit("p"), pk).alias("chunk_id"), text.alias("text"))
    return lookup.defined_terms(LAW_TEXTS.spark(spark).unionByName(parts))


@book.query(f"""{_LAWS}, s AS (SELECT DISTINCT substr(note_id, 1, 2) AS site, unnest(laws) AS x FROM l) SELECT site, list(x ORDER BY {_AGE}, x) AS laws FROM s GROUP BY site""")
def amendments_union(spark: SparkSession, d: str) -> DataFrame:
    """All laws that a section's notes name, newest first."""
    laws = _notes(spark, d).select(F.substring("note_id", 1, 2).alias("site"), F.explode(t.amending_laws(F.col("text"))).alias("law")).distinct()
    age = F.coalesce(-F.right("law", F.lit(4)).try_cast("int"), F.lit(0)).alias("age")
    return laws.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct(age, "law"))), lambda x: x["law"]).alias("laws"))


_COMMON = ", ".join(f"'{w}'" for w in lookup.COMMON)


@book.query(f"""WITH q AS (SELECT list_filter(list_distinct(regexp_extract_all(lower(string_agg(text, ' ')), '[a-z]{{4,}}')), lambda w: w NOT IN ({_COMMON})) AS ws FROM benchmark),
    w AS (SELECT d.doc_id, text, CASE WHEN position(' ' IN substr(text, s + 1)) > 0 THEN s + position(' ' IN substr(text, s + 1)) ELSE s END AS begin FROM (SELECT doc_id, text, unnest(range(1500, length(text) - 250, 500)) AS s FROM documents WHERE length(text) > 2500) d),
    h AS (SELECT doc_id, begin, substr(text, begin + 1, 1000) AS win, len(list_intersect(list_distinct(regexp_extract_all(lower(substr(text, begin + 1, 1000)), '[a-z]{{4,}}')), (SELECT ws FROM q))) AS n FROM w),
    b AS (SELECT * FROM h WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, begin) = 1)
    SELECT doc_id, md5(CASE WHEN length(text) <= 2500 THEN text WHEN b.begin >= 2000 THEN substr(text, 1, 1500) || ' … ' || win || ' …' ELSE substr(text, 1, 2500) || ' …' END) AS fitted_md5 FROM documents LEFT JOIN b USING (doc_id)""")
def fit_sources(spark: SparkSession, d: str) -> DataFrame:
    """Long documents cut to their head and the window nearest to the benchmark items."""
    focus = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lookup.fitted(docs, "doc_id", "text", focus, 2500).select("doc_id", F.md5(F.col("text").cast("binary")).alias("fitted_md5"))


_CANDIDATES = 30
_SHARED = """pair AS (SELECT item_id, doc_id FROM bmr WHERE rank <= {k}),
    iw AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS w FROM benchmark),
    starts AS (SELECT doc_id, text, unnest(range({first}, length(text) - {rest}, {step})) AS s FROM documents WHERE {long}),
    win AS (SELECT DISTINCT doc_id, CASE WHEN position(' ' IN substr(text, s + 1)) > 0 THEN s + position(' ' IN substr(text, s + 1)) ELSE s END AS begin, text FROM starts),
    hw AS (SELECT doc_id, begin, unnest(list_distinct(regexp_extract_all(lower(substr(text, begin + 1, {size})), '[a-z]{{4,}}'))) AS w FROM win)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the candidate documents of every benchmark item, and the words of every item."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return docs, written(bm25(docs, items, "doc_id", "item_id", _CANDIDATES).select("item_id", "doc_id"), "pairs"), items.select("item_id", F.explode(words).alias("w"))


@book.query(f"""WITH {_BM25}, {_SHARED.format(k=_CANDIDATES, first=600, rest=200, step=600, size=800, long='true')},
    idf AS (SELECT w, ln((SELECT count(*) FROM documents) / count(*)) AS v FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS w FROM documents) GROUP BY w),
    sc AS (SELECT item_id, doc_id, begin, round(sum(v), 6) AS score FROM pair JOIN iw USING (item_id) JOIN hw USING (doc_id, w) JOIN idf USING (w) GROUP BY ALL)
    SELECT item_id, doc_id, CAST(begin AS INTEGER) AS begin, score FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, begin) = 1""")
def best_window_per_item(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark item, the window of each of its candidate documents with the most rare words of the item."""
    docs, pairs, asked = _asked(spark, d)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    df = docs.select(F.explode(words).alias("w")).join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("w", F.ln(F.col("n") / F.col("df")).alias("v"))
    hits = lookup.shared_words(docs, "doc_id", "text", pairs, asked, "item_id", 800).join(idf, "w")
    scores = hits.groupBy("item_id", "doc_id", "begin").agg(F.round(F.sum("v"), 6).alias("score")).filter("score > 0")
    return scores.withColumn("k", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "begin"))).filter("k = 1").drop("k")


@book.query(f"""WITH {_BM25}, {_SHARED.format(k=_CANDIDATES, first=1500, rest=250, step=500, size=1000, long='length(text) > 2500')},
    cn AS (SELECT item_id, doc_id, begin, count(*) AS n FROM pair JOIN iw USING (item_id) JOIN hw USING (doc_id, w) WHERE w NOT IN ({_COMMON}) GROUP BY ALL),
    b AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, begin) = 1)
    SELECT item_id, doc_id, md5(CASE WHEN length(text) <= 2500 THEN text WHEN b.begin >= 2000 THEN substr(text, 1, 1500) || ' … ' || substr(text, b.begin + 1, 1000) || ' …' ELSE substr(text, 1, 2500) || ' …' END) AS fitted_md5
    FROM pair JOIN documents USING (doc_id) LEFT JOIN b USING (item_id, doc_id)""")
def fit_sources_per_item(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark item, its candidate documents cut to their head and the window nearest to the item."""
    docs, pairs, asked = _asked(spark, d)
    return lookup.fitted_pairs(docs, "doc_id", "text", pairs, asked, "item_id", 2500).select("item_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("fitted_md5"))
