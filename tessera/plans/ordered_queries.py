"""Queries over ordered rows: headings, sessions, folds, bands, as-of joins, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens, section_key
from tessera.operators import ordered as o
from tessera.operators.serving import daily_quota as quota
from tessera.operators.serving import sliding_limit
from tessera.plans.fixtures import NUMBERED, Fixture, Made
from tessera.plans.registering import Book
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

HEADINGS = Made("""SELECT CAST(l_orderkey AS STRING) AS block, k AS ord, (l_partkey % 12 + 1) || CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS number FROM """ + NUMBERED)


@book.query(f"""SELECT block, ord, number, coalesce(k > max(k) OVER (PARTITION BY block ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
    FROM (SELECT *, lpad(regexp_extract(number, '^[0-9]+'), 6, '0') || regexp_extract(number, '[A-Z]*$') AS k FROM {HEADINGS.duck()})""")
def running_max_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that go up."""
    return o.monotone(HEADINGS.spark(spark, d), ["block"], ["ord"], section_key(F.col("number")))


@book.query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def fill_down_sections(spark: SparkSession, d: str) -> DataFrame:
    """The value of each user's last purchase so far, filled down to every event."""
    e = table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return o.fill_down(e, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("event_id", "user_id", "last_purchase")


@book.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, CAST(sum(s) AS BIGINT) AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id""")
def session_gap_users(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: a pause of over twelve hours begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("ts").over(w))
    s = o.sessions(e, ["user_id"], ["ts", "event_id"], F.col("ts") - F.col("before") > F.expr("INTERVAL '12' HOUR"))
    return s.groupBy("user_id").agg(F.max("session").cast("long").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


@book.query("""WITH g AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations)
    SELECT conv_id, CAST(part AS INTEGER) AS part, count(*) AS n_turns, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM g WHERE part > 0 GROUP BY ALL""")
def sessionize_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Turns from one user turn to the next, joined in order: lines to paragraphs."""
    c = table(spark, d, "conversations")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    parts = c.withColumn("part", F.sum((F.col("role") == "user").cast("int")).over(upto).cast("int")).filter("part > 0")
    joined = o.joined_in_order(parts, ["conv_id", "part"], "turn", "text", "text")
    n = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"))
    return joined.join(n, ["conv_id", "part"]).select("conv_id", "part", "n_turns", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@book.query("""WITH RECURSIVE t AS (SELECT conv_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn FROM conversations),
    f AS (SELECT conv_id, i, turn, s, 0 AS g, s AS size FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, t.i, t.turn, t.s, CASE WHEN f.size > 0 AND f.size + t.s > 270 THEN f.g + 1 ELSE f.g END, CASE WHEN f.size > 0 AND f.size + t.s > 270 THEN t.s ELSE f.size + t.s END
          FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
    SELECT conv_id, turn, CAST(g AS INTEGER) AS piece FROM f""")
def greedy_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns packed in order into pieces of at most 300 estimated tokens, 30 of them kept for a header."""
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", estimate_tokens(F.col("text")).alias("s")).alias("t"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    of = o.greedy_groups(F.col("t.s"), 300 - 30)
    return lists.select("conv_id", F.explode(F.arrays_zip(F.col("t.turn").alias("turn"), of.alias("piece"))).alias("x")).select("conv_id", "x.turn", "x.piece")


EDGES = Made("""SELECT l_orderkey AS page, LIST(l_quantity BY l_linenumber) AS xs FROM {lineitem} GROUP BY l_orderkey""")


@book.query(f"""WITH RECURSIVE s AS (SELECT page, list_sort(xs) AS xs FROM {EDGES.duck()}),
    f AS (SELECT page, xs, 1 AS i, xs[1] AS anchor, [xs[1]] AS found FROM s
          UNION ALL SELECT page, xs, i + 1, CASE WHEN xs[i + 1] - anchor > 3.0 THEN xs[i + 1] ELSE anchor END, CASE WHEN xs[i + 1] - anchor > 3.0 THEN list_append(found, xs[i + 1]) ELSE found END FROM f WHERE i < len(xs))
    SELECT page, unnest(found) AS edge FROM f WHERE i = len(xs)""")
def anchored_cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    """Column edges: the first value of each cluster that is 3 wide."""
    return EDGES.spark(spark, d).select("page", F.explode(o.anchored_clusters(F.col("xs"), 3.0)).alias("edge"))


CHAIN = Made("""SELECT l_partkey AS doc, LIST(l_linenumber BY l_orderkey * 10 + l_linenumber) AS ns FROM {lineitem} GROUP BY l_partkey""")


@book.query(f"""WITH RECURSIVE t AS (SELECT doc, unnest(ns) AS n, generate_subscripts(ns, 1) AS i FROM {CHAIN.duck()}),
    c AS (SELECT doc, min(i) AS i, 1 AS n FROM t WHERE n = 1 GROUP BY doc
          UNION ALL SELECT c.doc, (SELECT min(t.i) FROM t WHERE t.doc = c.doc AND t.n = c.n + 1 AND t.i > c.i), c.n + 1 FROM c WHERE c.i IS NOT NULL)
    SELECT doc, CAST(n AS INTEGER) AS rule FROM c WHERE i IS NOT NULL""")
def rule_number_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rule numbers that follow one another."""
    return CHAIN.spark(spark, d).select("doc", F.explode(o.number_chain(F.col("ns"))).alias("rule"))


NOTES = Made("""SELECT conv_id AS law, turn AS page, n AS pos, CASE WHEN n = 0 AND (conv_id + turn) % 3 <> 0 THEN '' ELSE CAST(n + 1 AS STRING) END AS marker, 'note ' || turn || '.' || n AS text
    FROM {conversations} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE n < (conv_id + turn * 2) % 4""")
_TURNS = "(SELECT conv_id AS law, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"


@book.query(f"""WITH RECURSIVE n AS (SELECT * FROM {NOTES.duck()}), p AS (SELECT t.law, t.page, t.i, count(n.pos) AS n, coalesce(max(CASE WHEN n.pos = 0 THEN n.marker END) = '', false) AS bare FROM {_TURNS} t LEFT JOIN n USING (law, page) GROUP BY ALL),
    c AS (SELECT law, page, i, n, false AS moved, n AS stays FROM p WHERE i = 1
          UNION ALL SELECT p.law, p.page, p.i, p.n, p.bare AND c.stays > 0, p.n - CASE WHEN p.bare AND c.stays > 0 THEN 1 ELSE 0 END FROM c JOIN p ON p.law = c.law AND p.i = c.i + 1),
    k AS (SELECT n.*, c.i, max(n.pos) OVER (PARTITION BY n.law, n.page) AS last FROM n JOIN c USING (law, page) WHERE NOT (n.pos = 0 AND c.moved)),
    m AS (SELECT c.law, c.i - 1 AS i, n.text AS more FROM c JOIN n USING (law, page) WHERE c.moved AND n.pos = 0)
    SELECT k.law, k.page, k.marker, CASE WHEN k.pos = k.last AND more IS NOT NULL THEN k.text || ' ' || more ELSE k.text END AS text FROM k LEFT JOIN m ON m.law = k.law AND m.i = k.i""")
def footnote_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Notes that continue on the next page, law by law; a page that is left without notes stops the carry."""
    notes = NOTES.spark(spark, d).groupBy("law", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "marker", "text"))).alias("n"))
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("law"), F.col("turn").alias("page")).join(notes, ["law", "page"], "left")
    pages = pages.select("law", "page", F.transform(F.coalesce("n", F.array().cast("array<struct<pos:int,marker:string,text:string>>")), lambda x: F.struct(x["marker"].alias("marker"), x["text"].alias("text"))).alias("n"))
    laws = pages.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("page", "n"))).alias("p"))
    done = laws.select("law", F.explode(F.arrays_zip(F.col("p.page").alias("page"), o.carried_notes(F.col("p.n")).alias("n"))).alias("x"))
    return done.select("law", "x.page", F.explode("x.n").alias("n")).select("law", "page", "n.marker", "n.text")


LABELS = Made("""SELECT user_id AS page, value AS y, CAST(min(event_id) AS STRING) AS label FROM {events} WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id, value""")
ROWS = Made("""SELECT user_id AS page, value AS y, event_id AS row_id FROM {events} WHERE event_type <> 'purchase' AND value IS NOT NULL""")


@book.query(f"""SELECT r.row_id, r.page, r.y, l.label AS section FROM {ROWS.duck()} r ASOF LEFT JOIN {LABELS.duck()} l ON r.page = l.page AND r.y >= l.y""")
def asof_label(spark: SparkSession, d: str) -> DataFrame:
    """The last section label at or above each row, not across pages."""
    return o.as_of(ROWS.spark(spark, d), LABELS.spark(spark, d), ["page"], "y", "label", "section").select("row_id", "page", "y", "section")


@book.query("""SELECT e.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    """The user's last view at or before each purchase."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return o.as_of(e.filter("event_type = 'purchase'").drop("value", "event_type"), e.filter("event_type = 'view'"), ["user_id"], "ts", "value", "last_view").select("event_id", "last_view")


BANDS = Fixture("page int, cell int, lo double, hi double", [(p, i, 12.5 * i, 12.5 * i + 12.5) for p in (0, 1, 2) for i in range(4)])


@book.query(f"""SELECT l_orderkey, l_linenumber, b.cell FROM lineitem l JOIN {BANDS.duck()} b ON l.l_linenumber % 3 = b.page AND l.l_quantity >= b.lo AND l.l_quantity < b.hi""")
def band_join_cells(spark: SparkSession, d: str) -> DataFrame:
    """The grid cell that holds each line's quantity."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") % 3).alias("page"))
    return o.band_join(rows, BANDS.spark(spark, d), ["page"], "l_quantity", "lo", "hi", width=12.5).select("l_orderkey", "l_linenumber", "cell")


BOXES = Made("""SELECT user_id AS page, value * 0.9 AS top, value * 1.1 AS bottom FROM {events} WHERE event_type = 'purchase' AND value IS NOT NULL""")


@book.query(f"""SELECT row_id FROM {ROWS.duck()} r WHERE NOT EXISTS (SELECT 1 FROM {BOXES.duck()} b WHERE b.page = r.page AND r.y BETWEEN b.top AND b.bottom)""")
def lines_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines that no table box on their page holds."""
    r, b = ROWS.spark(spark, d).alias("r"), BOXES.spark(spark, d).alias("b")
    return r.join(b, (F.col("r.page") == F.col("b.page")) & F.col("r.y").between(F.col("b.top"), F.col("b.bottom")), "left_anti").select("row_id")


HEADS = Made("""SELECT s_nationkey AS page, s_suppkey AS col, s_acctbal AS h FROM {supplier}""")
SEGMENTS = Made("""SELECT c_nationkey AS page, c_acctbal AS x FROM {customer}""")


@book.query(f"""SELECT col, coalesce(max(x), h - 8) AS edge FROM {HEADS.duck()} c LEFT JOIN {SEGMENTS.duck()} s ON s.page = c.page AND s.x BETWEEN h - 40 AND h + 2 GROUP BY col, h""")
def rightmost_edge_band(spark: SparkSession, d: str) -> DataFrame:
    """The right-most ruling segment near each column head, else a default."""
    return o.last_within(HEADS.spark(spark, d), SEGMENTS.spark(spark, d), ["page"], "h", "x", 40.0, 2.0).groupBy("col", "h").agg(F.max("x").alias("x")).select("col", F.coalesce("x", F.col("h") - 8).alias("edge"))


@book.query("""SELECT user_id, event_id, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events""")
def row_bounds_lead(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the beginning of the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("lo"), F.lead("ts").over(w).alias("hi"))


@book.query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """The first two events of each user and UTC day."""
    return quota(table(spark, d, "events"), "user_id", "ts", "event_id", 2).select("user_id", "event_id")


@book.query("""WITH RECURSIVE t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, true AS allowed, [ts] AS hits FROM t WHERE i = 1
          UNION ALL SELECT t.user_id, t.event_id, t.i, len(list_filter(f.hits, lambda h: h >= t.ts - INTERVAL 1 DAY)) < 2,
            CASE WHEN len(list_filter(f.hits, lambda h: h >= t.ts - INTERVAL 1 DAY)) < 2 THEN list_append(list_filter(f.hits, lambda h: h >= t.ts - INTERVAL 1 DAY), t.ts) ELSE list_filter(f.hits, lambda h: h >= t.ts - INTERVAL 1 DAY) END
          FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)
    SELECT user_id, event_id, allowed FROM f""")
def stateful_rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Two events a day and user in a sliding day; events that were turned away leave no trace."""
    return sliding_limit(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, seconds=86_400).select("user_id", "event_id", "allowed")
