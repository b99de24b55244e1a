"""Queries on prompts, citations, model calls and reports, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.operators import prompts as p
from tessera.plans.fixtures import NUMBERED, Fixture, Made
from tessera.plans.registering import Book
from tessera.sources.shared import shared_folder
from tessera.sources.tables import read_json_lines, table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

CHUNKS = Made("""SELECT p_partkey AS id, concat('c', p_partkey) AS chunk_id, concat('L-s', p_size) AS section_id, CASE p_partkey % 3 WHEN 0 THEN 'Ordinance' WHEN 1 THEN 'Rules' ELSE 'Cards' END AS law, CASE p_partkey % 3 WHEN 0 THEN 'ITO' WHEN 1 THEN 'ITR' ELSE 'WHT' END AS law_code, CASE WHEN p_partkey % 5 = 0 THEN 'First Schedule' END AS schedule,
    CASE WHEN p_partkey % 7 = 0 THEN concat('(', p_size, ')') END AS clause, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS STRING) END AS section, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS title, p_name AS text, p_size AS page, concat('http://law/', p_partkey % 9, '.pdf') AS source_url, CAST(concat('202', p_partkey % 7, '-06-30') AS DATE) AS version_date FROM {part}""")


@book.query(f"""SELECT id, law || ' — ' || CASE WHEN schedule IS NOT NULL THEN title ELSE CASE law_code WHEN 'ITR' THEN 'Rule' WHEN 'WHT' THEN 'Rate card, section' ELSE 'Section' END || ' ' || coalesce(clause, section, '') || CASE WHEN title <> '' THEN ': ' || title ELSE '' END END || chr(10) || text AS headed FROM {CHUNKS.duck()}""")
def headed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under their context line."""
    c = {n: F.col(n) for n in ("law", "law_code", "schedule", "clause", "section", "title", "text")}
    return CHUNKS.spark(spark, d).select("id", p.headed_text(**c).alias("headed"))


@book.query(f"SELECT id, 'n' || id % 6 || ' ' || chunk_id || ' ' || section_id || ' ' || source_url || '#page=' || page || ' ' || strftime(version_date, '%Y-%m-%d') AS shown FROM {CHUNKS.duck()}")
def citation_records(spark: SparkSession, d: str) -> DataFrame:
    """Citations with the link to their page."""
    names = ("chunk_id", "section_id", "law", "text", "page", "source_url", "version_date")
    record = p.citation_record(n=F.col("id") % 6, label=F.col("title"), **{n: F.col(n) for n in names})
    c = CHUNKS.spark(spark, d).select("id", record.alias("c"))
    return c.select("id", F.concat(F.lit("n"), "c.n", F.lit(" "), "c.chunk_id", F.lit(" "), "c.section_id", F.lit(" "), "c.url", F.lit(" "), "c.version_date").alias("shown"))


@book.query("""SELECT o_orderkey, 'Question: ' || o_orderpriority || chr(10) || chr(10) || 'Tax year: ' || (2015 + o_custkey % 10) || CASE WHEN o_custkey % 2 = 0 THEN ' (assumed)' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Notes:' || chr(10) || '- card added' || chr(10) || '- rule added' ELSE '' END
    || CASE WHEN o_custkey % 5 = 0 THEN chr(10) || chr(10) || 'Searched as: ' || o_orderstatus ELSE '' END || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] ' || o_orderkey AS user_message, 'Answer from the sources.' AS system_message FROM orders""")
def answer_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages of an answer, with notes on companion sources."""
    none = F.array().cast("array<string>")
    notes, also = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("card added"), F.lit("rule added"))).otherwise(none), F.when(F.col("o_custkey") % 5 == 0, F.array("o_orderstatus")).otherwise(none)
    made = p.messages(F.lit("Answer from the sources."), F.col("o_orderpriority"), F.concat(F.lit("[1] "), "o_orderkey"), 2015 + F.col("o_custkey") % 10, F.col("o_custkey") % 2 == 0, notes, also)
    return table(spark, d, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", F.col("m")[1]["content"].alias("user_message"), F.col("m")[0]["content"].alias("system_message"))


PROMPTS = Made("SELECT event_id, concat('u', user_id % 90) AS key, concat('about user ', user_id % 90) AS prompt FROM {events}")
KEPT = Made("SELECT DISTINCT concat('u', user_id % 90) AS key, concat('kept ', user_id % 90) AS output FROM {events} WHERE user_id % 90 < 40")


@book.query(f"""SELECT event_id, key, coalesce(output, 'ABOUT USER ' || substr(key, 2)) AS output, output IS NULL AS asked FROM {PROMPTS.duck()} LEFT JOIN {KEPT.duck()} USING (key)""")
def batched_calls(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs: replayed where they are kept, else asked in batches, each key once. The model here puts a prompt in capitals."""
    outputs, _ = p.called(PROMPTS.spark(spark, d), KEPT.spark(spark, d), lambda prompts: [x.upper() for x in prompts])
    return outputs.select("event_id", "key", "output", "asked")


@book.query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'OUT_OF_SCOPE' WHEN event_id % 3 = 0 THEN 'NOT_ANSWERABLE' WHEN user_id % 4 = 0 THEN 'NO_VALID_CITATION' END AS reason FROM events""")
def final_refusals(spark: SparkSession, d: str) -> DataFrame:
    """The cascade with its last two stages: not answerable, and no valid citation."""
    e = table(spark, d, "events")
    answerable = F.when(F.col("event_id") % 6 == 0, None).otherwise(F.col("event_id") % 3 != 0)
    return e.select("event_id", p.last_checks(F.when(F.col("event_type") == "purchase", "OUT_OF_SCOPE"), answerable, F.col("user_id") % 4).alias("reason"))


SETUPS = Fixture("ord int, setup string", [(1, "en"), (2, "es"), (3, "absent"), (4, "de"), (5, "fr")])
REPORTS = Made("SELECT lang AS setup, concat(source, '-', doc_id) AS report, (n_chars % 1000) / 1000.0 AS in_scope, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 777) / 777.0 END AS correct FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL")


@book.query(f"SELECT ord, setup, report, round(100 * in_scope, 1)::DOUBLE AS in_scope, round(100 * correct, 1)::DOUBLE AS correct FROM {SETUPS.duck()} JOIN (SELECT setup, report, in_scope::DOUBLE AS in_scope, correct::DOUBLE AS correct FROM {REPORTS.duck()} QUALIFY row_number() OVER (PARTITION BY setup ORDER BY report DESC) = 1) USING (setup)")
def setups_with_reports(spark: SparkSession, d: str) -> DataFrame:
    """Set-ups in their order with the percentages of their newest report."""
    reports = REPORTS.spark(spark, d).withColumn("in_scope", F.col("in_scope").cast("double")).withColumn("correct", F.col("correct").cast("double"))
    return p.latest_correctness(SETUPS.spark(spark), reports)


@book.query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE coalesce(o_orderstatus, 'none') END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE coalesce(o_orderpriority, 'none') END AS o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority, with all margins."""
    return p.cross_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"large": F.col("o_totalprice") > 100_000})


@book.query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def json_lines_read(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines with a blank line behind each, and read with a declared schema."""
    path = shared_folder(spark, "lines")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    o.select(F.concat(F.to_json(F.struct(*o.columns)), F.lit("\n")).alias("value")).write.text(path)
    return read_json_lines(spark, path, o.schema)


LINES = Made(f"SELECT l_orderkey AS page, k, k * 110.0 AS y, CASE WHEN l_partkey % 7 = 0 THEN 40.0 WHEN l_partkey % 3 = 0 THEN 6.0 ELSE 10.0 END AS size, CASE WHEN l_suppkey % 5 = 0 THEN ' [ ] .;' WHEN l_suppkey % 5 = 1 THEN '[*a]' ELSE 'words' END AS text FROM {NUMBERED}")


@book.query(f"SELECT page, k FROM {LINES.duck()} WHERE size < 30 AND NOT ((y < 120 OR y > 500) AND size >= 8) AND text <> ' [ ] .;'")
def body_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the body: no junk, no header or footer, no empty brackets."""
    return layout.body_lines(LINES.spark(spark, d), 120.0, 500.0, 8.0, 30.0).select("page", "k")


ENTRIES = Made(f"SELECT l_orderkey AS law, k, CAST(k * 9 + l_suppkey % 60 - 10 AS INT) AS number, CASE WHEN l_partkey % 19 = 0 THEN 'THE SCHEDULES' ELSE concat('Title ', l_linenumber) END AS title FROM {NUMBERED}")


@book.query(f"""WITH RECURSIVE x AS (SELECT *, max(CASE WHEN title = 'THE SCHEDULES' THEN 1 ELSE 0 END) OVER (PARTITION BY law ORDER BY k) AS ended FROM {ENTRIES.duck()}),
    f AS (SELECT DISTINCT law, 0 AS k, 0 AS last, NULL::INTEGER AS number, NULL::VARCHAR AS title FROM x UNION ALL SELECT x.law, x.k, CASE WHEN ok THEN x.number ELSE last END, CASE WHEN ok THEN x.number END, CASE WHEN ok THEN x.title END FROM f JOIN (SELECT *, ended = 0 AS live FROM x) x ON x.law = f.law AND x.k = f.k + 1, LATERAL (SELECT live AND x.number > f.last AND x.number <= f.last + 50 AS ok) o)
    SELECT law, number, title FROM f WHERE number IS NOT NULL""")
def contents_with_titles(spark: SparkSession, d: str) -> DataFrame:
    """Tables of contents: numbers with titles, up to the schedules."""
    lists = ENTRIES.spark(spark, d).groupBy("law").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "number", "title"))), lambda e: F.struct(e["number"].alias("number"), e["title"].alias("title"))).alias("e"))
    return lists.select("law", F.explode(layout.contents(F.col("e"))).alias("x")).select("law", "x.number", "x.title")


@book.query("SELECT DISTINCT section_id FROM (SELECT 'D-' || lang || '-' || doc_id % 50 AS section_id FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'P-' || p_size FROM part)")
def known_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section ids of all laws, from chunks that lie by law."""
    path = shared_folder(spark, "by-law")
    docs = table(spark, d, "documents").filter("lang IS NOT NULL").select(F.concat(F.lit("D-"), "lang").alias("law"), F.concat(F.lit("D-"), "lang", F.lit("-"), F.col("doc_id") % 50).alias("section_id"))
    parts = table(spark, d, "part").select(F.lit("P").alias("law"), F.concat(F.lit("P-"), "p_size").alias("section_id"))
    docs.unionByName(parts).write.partitionBy("law").parquet(path)
    return spark.read.parquet(path).select("section_id").distinct()
