"""Queries that summarise: grouped means with totals, matrices, percentiles, allocation, samples, caches, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ROMAN_URDU, estimate_tokens, language, normalized_question, tax_year_of
from tessera.operators import aggregates as a
from tessera.operators.ordered import numbered
from tessera.operators.retrieval import means_with_total
from tessera.operators.serving import cache_hits, last_votes
from tessera.operators.sizes import small
from tessera.plans.fixtures import Made
from tessera.plans.registering import Book
from tessera.sources.shared import written
from tessera.sources.tables import last_by_key, table, upsert

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE


@book.query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def grouped_means_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price by priority and over all."""
    return means_with_total(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice"])


@book.query("""WITH v AS (SELECT d.lang, l.toxic, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'yes' WHEN l.quality = 1 THEN 'partly' ELSE 'no' END AS verdict FROM labels l JOIN documents d USING (doc_id)),
    g AS (SELECT lang AS grp, * FROM v UNION ALL SELECT 'in_scope', * FROM v WHERE lang <> 'es')
    SELECT grp, count(*) AS n, round(avg((verdict = 'yes')::INT::DOUBLE), 4) AS strict, round(avg((verdict IN ('yes', 'partly'))::INT::DOUBLE), 4) AS lenient FROM g GROUP BY grp""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Strict and lenient shares of verdicts by language, and over the languages in scope."""
    v = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    v = v.withColumn("verdict", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").when(F.col("quality") == 1, "partly").otherwise("no"))
    g = v.withColumn("grp", F.explode(F.when(F.col("lang") != "es", F.array("lang", F.lit("in_scope"))).otherwise(F.array("lang"))))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("verdict") == "yes").cast("double")), 4).alias("strict"), F.round(F.avg(F.col("verdict").isin("yes", "partly").cast("double")), 4).alias("lenient"))


@book.query("""SELECT l_returnflag AS setup, round(100 * avg(l_discount) FILTER (l_linestatus = 'O'), 1) AS "O", round(100 * avg(l_discount) FILTER (l_linestatus = 'F'), 1) AS "F" FROM lineitem GROUP BY l_returnflag""")
def pivot_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Percentages by setup, a column for each group."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("setup")).pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_discount"))
    return p.select("setup", F.round(100 * F.col("O"), 1).alias("O"), F.round(100 * F.col("F"), 1).alias("F"))


_LANG = """CASE WHEN length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')) > 0 AND length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')) >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ur'
    WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: w IN ({marks}))) >= 2 OR (len(regexp_extract_all(lower(text), '[a-z'']+')) > 0
      AND len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: w IN ({marks}))) >= 0.2 * len(regexp_extract_all(lower(text), '[a-z'']+'))) THEN 'roman_ur' ELSE 'en' END""".format(marks=", ".join(f"'{w}'" for w in ROMAN_URDU))


@book.query(f"""WITH k AS (SELECT * FROM (VALUES ('user'), ('assistant')) r(role), (VALUES ('en'), ('ur'), ('roman_ur'), ('all')) l(lang)),
    c AS (SELECT role, {_LANG} AS lang, text FROM conversations WHERE role <> 'system'), g AS (SELECT * FROM c UNION ALL SELECT role, 'all', text FROM c)
    SELECT k.role, k.lang, count(g.text) AS n, count(CASE WHEN contains(g.text, ',') THEN 1 END) AS flagged FROM k LEFT JOIN g ON k.role = g.role AND k.lang = g.lang GROUP BY ALL""")
def guard_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Turns and flagged turns by kind and language, every cell of the matrix, zero where nothing is."""
    c = table(spark, d, "conversations").filter("role <> 'system'").withColumn("lang", F.explode(F.array(language(F.col("text")), F.lit("all"))))
    keys = spark.sql("SELECT role, lang FROM VALUES ('user'), ('assistant') r(role) CROSS JOIN VALUES ('en'), ('ur'), ('roman_ur'), ('all') l(lang)")
    return a.dense_counts(c, keys, ["role", "lang"], {"n": F.lit(True), "flagged": F.col("text").contains(",")})


@book.query("""WITH o AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
    SELECT event_type, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INT) + 1] AS p95 FROM o""")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank p50 and p95 of event values."""
    return a.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@book.query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The middle value, or the mean of the middle two."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)"), 6).alias("median"))


@book.query("""WITH w AS (SELECT p_brand, p_size, sum(length(p_name)) AS w FROM part GROUP BY ALL)
    SELECT p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_size) AS n FROM w) WHERE n = 1""")
def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    """The size with the most characters of each brand: the dominant font of a page."""
    return a.weighted_mode(table(spark, d, "part"), ["p_brand"], "p_size", F.length("p_name"))


_SHARES = """g AS (SELECT source AS grp, count(*) AS size FROM (SELECT CASE WHEN doc_id % 7 < 3 THEN source ELSE lang END AS source FROM documents) GROUP BY 1),
    e AS (SELECT *, size * 50 / (SELECT sum(size) FROM g) AS exact FROM g), b AS (SELECT *, greatest(floor(exact), 1) AS base FROM e),
    r AS (SELECT *, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, size DESC, grp) AS n FROM b),
    shares AS (SELECT grp, size, CAST(base + CASE WHEN n <= 50 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS share FROM r)"""


def _groups(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 < 3, F.col("source")).otherwise(F.col("lang")).alias("grp"))


@book.query(f"WITH {_SHARES} SELECT * FROM shares")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """Fifty places shared out over groups."""
    return a.allocate(_groups(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp", "size", 50)


@book.query(f"""WITH {_SHARES}, p AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('2027:' || doc_id), doc_id) AS place FROM (SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN source ELSE lang END AS grp FROM documents))
    SELECT doc_id, grp, CAST(place AS INTEGER) AS place FROM p JOIN shares USING (grp) WHERE place <= share""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents, drawn by group in a seeded order."""
    return a.stratified_sample(_groups(spark, d), "grp", "doc_id", 50, 2027)


@book.query("""SELECT n_nationkey, CAST(row_number() OVER (ORDER BY rn, n_regionkey) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation)""")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    """One of each group, then the second of each, and so on."""
    n = table(spark, d, "nation").withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return numbered(n.withColumn("at", F.struct("rn", "n_regionkey")), "at", "place").select("n_nationkey", (F.col("place") + 1).cast("int").alias("place"))


@book.query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once."""
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@book.query("SELECT user_id, event_type AS stage, round(sum(value), 4) AS ms, count(*) AS n FROM events GROUP BY ALL")
def stage_timings_agg(spark: SparkSession, d: str) -> DataFrame:
    """Summed time and count of each stage of a request."""
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("ms"), F.count(F.lit(1)).alias("n"))


@book.query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k_sum, CAST(max(CAST(json_extract(props, '$.k') AS INT)) AS INTEGER) AS k_max FROM events GROUP BY 1""")
def json_props_agg(spark: SparkSession, d: str) -> DataFrame:
    """A field of the JSON column, summed."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k INT"))
    return e.groupBy("event_type").agg(F.sum("p.k").cast("long").alias("k_sum"), F.max("p.k").alias("k_max"))


@book.query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_daily_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of each UTC day and type."""
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@book.query("""SELECT lang AS kind, count(*) AS n, count(DISTINCT source) AS n_sections, CAST(max(ceil(length(text) / 4.0)) AS BIGINT) AS max_tokens, count(CASE WHEN length(text) > 3200 THEN 1 END) AS over_budget FROM documents GROUP BY 1""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind, distinct sections, the longest chunk, and how many exceed the budget of 800 tokens."""
    t = table(spark, d, "documents").withColumn("t", estimate_tokens(F.col("text")))
    return t.groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sections"), F.max("t").alias("max_tokens"), F.count(F.when(F.col("t") > 800, 1)).alias("over_budget"))


@book.query("""SELECT user_id, event_id, event_type AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click', 'error')) WHERE n = 1 AND user_id IN (SELECT c_custkey FROM customer)""")
def feedback_last_vote(spark: SparkSession, d: str) -> DataFrame:
    """The last vote of each known user."""
    e = table(spark, d, "events").filter("event_type IN ('click', 'error')").withColumn("rating", F.col("event_type"))
    return last_votes(e, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "ts", "event_id", ["event_id", "rating"])


_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ ', ''), '[ ?.!؟۔]+$', '')"


@book.query(f"""SELECT sha256('v1|None|' || {_KEY}) AS key, min(conv_id * 1000 + turn) AS first, count(*) - 1 AS hits FROM conversations WHERE role = 'user' GROUP BY 1""")
def answer_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """How often each answered question came again, ignoring case, blanks and closing marks."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    key = F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("None"), normalized_question(F.col("text"))), 256)
    return cache_hits(c, key, ["conv_id", "turn"]).select("key", (F.col("first.conv_id") * 1000 + F.col("first.turn")).alias("first"), "hits")


ITEMS = Made("""SELECT 'q' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'q' || (o_orderkey - 1) END AS source_id, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, array('s' || o_custkey % 2) AS gold, o_orderpriority AS reference FROM {orders}""")
CHANGES = Made("""SELECT 'q' || o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN array('s1', 's4') END AS gold, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus END AS reference FROM {orders} WHERE o_orderkey % 2 = 0""")


@book.query(f"""SELECT i.id, coalesce(CASE WHEN i.source_id IS NULL THEN c.gold END, i.gold) AS gold, coalesce(CASE WHEN i.source_id IS NULL THEN c.reference END, i.reference) AS reference,
    CASE WHEN i.source_id IS NULL AND coalesce(c.gold, i.gold) <> i.gold OR i.source_id IS NULL AND coalesce(c.reference, i.reference) <> i.reference THEN i.reference END AS before FROM {ITEMS.duck()} i LEFT JOIN {CHANGES.duck()} c USING (id)""")
def merge_changes(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed changes merged into the items, with the old answer kept; translations are not changed."""
    i, c = ITEMS.spark(spark, d), CHANGES.spark(spark, d).select("id", F.col("gold").alias("new_gold"), F.col("reference").alias("new_ref"))
    own = F.col("source_id").isNull()
    gold, ref = F.coalesce(F.when(own, F.col("new_gold")), F.col("gold")), F.coalesce(F.when(own, F.col("new_ref")), F.col("reference"))
    return i.join(c, "id", "left").select("id", gold.alias("gold"), ref.alias("reference"), F.when((gold != F.col("gold")) | (ref != F.col("reference")), F.col("reference")).alias("before"))


@book.query(f"""SELECT t.id, CASE WHEN s.id IS NULL THEN 'no source' WHEN s.split <> t.split THEN 'split differs' WHEN s.gold <> t.gold THEN 'gold differs' ELSE 'ok' END AS verdict FROM {ITEMS.duck()} t LEFT JOIN {ITEMS.duck()} s ON t.source_id = s.id WHERE t.source_id IS NOT NULL""")
def translation_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Translations checked against the questions they come from."""
    t, s = ITEMS.spark(spark, d).alias("t"), ITEMS.spark(spark, d).alias("s")
    j = t.join(s, F.col("t.source_id") == F.col("s.id"), "left").filter("t.source_id IS NOT NULL")
    return j.select("t.id", F.when(F.col("s.id").isNull(), "no source").when(F.col("s.split") != F.col("t.split"), "split differs").when(F.col("s.gold") != F.col("t.gold"), "gold differs").otherwise("ok").alias("verdict"))


@book.query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0""")
def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    """New versions of every third order replace the old ones."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return upsert(o, o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@book.query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def append_log_last_line(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log read as a table: the last line of each key."""
    return last_by_key(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@book.query("""SELECT year(o_orderdate + INTERVAL 6 MONTH) AS tax_year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def tax_year_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by tax year."""
    return table(spark, d, "orders").groupBy(tax_year_of(F.col("o_orderdate")).cast("long").alias("tax_year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: Versions of each nation's law: from two of three of the years that its customers order in.
SNAPSHOTS = Made("""SELECT n_name AS law, concat('v', o_year) AS version, o_year AS tax_year_from FROM (SELECT DISTINCT c_nationkey, CAST(year(o_orderdate) AS INT) AS o_year FROM {orders} JOIN {customer} ON o_custkey = c_custkey) y JOIN {nation} ON n_nationkey = c_nationkey WHERE (c_nationkey + o_year) % 3 > 0""")
_CLOSED = f"(SELECT law, version, tax_year_from, lead(tax_year_from) OVER (PARTITION BY law ORDER BY tax_year_from) - 1 AS tax_year_to FROM {SNAPSHOTS.duck()})"


def _closed(spark, d):
    following = F.lead("tax_year_from").over(Window.partitionBy("law").orderBy("tax_year_from"))
    return SNAPSHOTS.spark(spark, d).withColumn("tax_year_to", following - 1)


@book.query(f"SELECT * FROM {_CLOSED}")
def snapshot_close_out(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot is valid until the year before the next one."""
    return _closed(spark, d)


@book.query(f"""SELECT o_orderkey, s.law, version FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN {_CLOSED} s ON s.law = n_name AND year(o_orderdate + INTERVAL 6 MONTH) >= tax_year_from AND (tax_year_to IS NULL OR year(o_orderdate + INTERVAL 6 MONTH) <= tax_year_to)""")
def tax_year_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot of its customer's law that is in force for each order. A snapshot is a row for each of its years, the open one up to the last year of any order, so
    that the join is by law and year."""
    closed = written(_closed(spark, d), "closed")
    laws = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("law"))  # 25 nations
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", tax_year_of(F.col("o_orderdate")).alias("tax_year"))
    last = orders.agg(F.max("tax_year").alias("last"))
    each = closed.crossJoin(F.broadcast(last)).withColumn("to", F.coalesce("tax_year_to", "last")).filter(F.col("to") >= F.col("tax_year_from"))  # one row
    years = each.select("law", "version", F.explode(F.sequence("tax_year_from", "to")).alias("tax_year"))
    return orders.join(laws, "o_custkey").join(small(years), ["law", "tax_year"]).select("o_orderkey", "law", "version")


@book.query("""SELECT p_partkey AS key, 'no line' AS problem FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l_partkey, 'no part' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def toc_coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    """Coverage both ways: parts without lines, and lines whose part isn't listed."""
    p, lines = table(spark, d, "part"), table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))
    bare = p.select(F.col("p_partkey").alias("key")).join(lines, "key", "left_anti").withColumn("problem", F.lit("no line"))
    return bare.unionByName(lines.distinct().join(p.filter("p_size > 5").select(F.col("p_partkey").alias("key")), "key", "left_anti").withColumn("problem", F.lit("no part")))


@book.query("""SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1""")
def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Distinct kinds of each user, sorted."""
    return table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
