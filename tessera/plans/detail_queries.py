"""Smaller operators: manifests, tables, prompts, parsed outputs, fixes, validation, verification, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scope
from tessera.functions.phrases import token_line
from tessera.functions.text import QUOTES, estimate_tokens, note_head
from tessera.operators.cards import DIVISION
from tessera.operators.ordered import sessions
from tessera.plans.fixtures import NUMBERED, Fixture, Made
from tessera.plans.question_queries import ASKED, RULED, asked_rows
from tessera.plans.registering import Book
from tessera.sources.tables import newest_report, table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE


@book.query("""SELECT coalesce(o.page_id, n.page_id) AS page_id, CASE WHEN o.page_id IS NULL THEN 'added' WHEN n.page_id IS NULL THEN 'gone' ELSE 'changed' END AS state
    FROM (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 5 <> 0) o FULL JOIN (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'x' ELSE sha256(html) END AS h FROM pages WHERE page_id % 7 <> 0) n USING (page_id) WHERE o.h IS DISTINCT FROM n.h""")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files whose hash differs between two manifests, both ways."""
    p = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    old = p.filter("page_id % 5 <> 0").select("page_id", F.col("h").alias("old"))
    new = p.filter("page_id % 7 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.col("h")).alias("new"))
    both = old.join(new, "page_id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("page_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("changed").alias("state"))


CARD_ROWS = Made("""SELECT conv_id AS card, CAST(floor(turn / 3.0) AS INT) AS page, turn AS ord, CASE WHEN turn % 4 = 0 THEN 's' || turn END AS section, CASE WHEN turn % 3 <> 1 THEN role END AS description, CASE WHEN conv_id % 5 = turn % 5 THEN 'r' END AS reference, substring(md5(text), 1, 4) AS rate FROM {conversations}""")


@book.query(f"""WITH s AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY card ORDER BY ord) AS sec, sum(CASE WHEN description IS NULL AND reference IS NULL AND lag_page = page THEN 0 ELSE 1 END) OVER (PARTITION BY card ORDER BY ord) AS rec FROM (SELECT *, lag(page) OVER (PARTITION BY card ORDER BY ord) AS lag_page FROM {CARD_ROWS.duck()}))
    SELECT card, CAST(rec AS INTEGER) AS record, min(sec) AS section, string_agg(rate, ' ' ORDER BY ord) AS rate FROM s GROUP BY card, rec""")
def wrapped_card_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows without description and reference continue the row above on their page; sections are filled down."""
    rows = CARD_ROWS.spark(spark, d)
    w = Window.partitionBy("card").orderBy("ord")
    rows = rows.withColumn("above", F.lag("page").over(w)).withColumn("sec", F.last("section", ignorenulls=True).over(w))
    rows = sessions(rows, ["card"], ["ord"], ~(F.col("description").isNull() & F.col("reference").isNull() & (F.col("above") == F.col("page"))), "record")
    return rows.groupBy("card", "record").agg(F.min("sec").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rate"))), lambda x: x["rate"]), " ").alias("rate"))


@book.query("""SELECT conv_id, turn, coalesce(list(CASE WHEN role = 'user' THEN turn END) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS context FROM conversations""")
def table_context(spark: SparkSession, d: str) -> DataFrame:
    """Of the two rows before each, those of one kind: the caption of a table."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("context"))


NOTES = Made("""SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 400) || ' - It reads  as under: ' || text WHEN doc_id % 3 = 1 THEN 'Read as follows ' || lang ELSE text END AS text FROM {documents}""")


_FLAT = "regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
_AT = "least(" + ", ".join(f"nullif(instr(lower(f), '{q}'), 0)" for q in QUOTES) + ")"


@book.query(f"""SELECT note_id, CASE WHEN length(h) <= 300 THEN h ELSE rtrim(substr(h, 1, 299)) || '…' END AS summary FROM (SELECT note_id, regexp_replace(trim(coalesce(substr(f, 1, {_AT} - 1), f)), '[-:–— ]+$', '') AS h FROM (SELECT note_id, {_FLAT} AS f FROM {NOTES.duck()}))""")
def note_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Amendment notes without the old text they quote, cut at 300 characters."""
    h = F.regexp_replace(F.trim(note_head(F.col("text"))), "[-:–— ]+$", "")
    return NOTES.spark(spark, d).select("note_id", h.alias("h")).select("note_id", F.when(F.length("h") <= 300, F.col("h")).otherwise(F.concat(F.rtrim(F.substring("h", 1, 299)), F.lit("…"))).alias("summary"))


GRID = Made("""SELECT l_orderkey AS table_id, k - 1 AS row_no, CASE WHEN l_suppkey % 2 = 0 THEN array(l_returnflag || '|' || l_linestatus, CAST(l_partkey AS STRING)) ELSE array(CAST(l_suppkey AS STRING), l_linestatus, l_returnflag) END AS cells FROM """ + NUMBERED)


@book.query(f"""WITH w AS (SELECT *, max(len(cells)) OVER (PARTITION BY table_id) AS n FROM {GRID.duck()}), r AS (SELECT table_id, row_no, n, '| ' || array_to_string(list_transform(range(1, n + 1), lambda i: replace(coalesce(cells[i], ''), '|', '/')), ' | ') || ' |' AS line FROM w)
    SELECT table_id, string_agg(CASE WHEN row_no = 0 THEN line || chr(10) || '|' || repeat(' --- |', n::INT) ELSE line END, chr(10) ORDER BY row_no) AS markdown FROM r GROUP BY table_id""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """Grids as Markdown: rows padded, bars escaped, a rule under the header."""
    rows = GRID.spark(spark, d).withColumn("n", F.max(F.size("cells")).over(Window.partitionBy("table_id")))
    cells = F.transform(F.sequence(F.lit(1), "n"), lambda i: F.replace(F.coalesce(F.get("cells", i - 1), F.lit("")), F.lit("|"), F.lit("/")))
    line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = rows.select("table_id", "row_no", F.when(F.col("row_no") == 0, F.concat(line, F.lit("\n|"), F.expr("repeat(' --- |', n)"))).otherwise(line).alias("line"))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("markdown"))


@book.query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \n]+[ \n]*|[ \n]+') AS p FROM conversations)
    SELECT conv_id, turn, CAST(ceil(len(p) / 4.0) AS BIGINT) AS n_pieces, md5(array_to_string(p[1:4], '')) AS first_md5 FROM p""")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts in pieces of four words that keep every blank, as an answer is streamed."""
    p = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"[^ \n]+[ \n]*|[ \n]+"), F.lit(0)).alias("p"))
    return p.select("conv_id", "turn", F.ceil(F.size("p") / 4).alias("n_pieces"), F.md5(F.array_join(F.slice("p", 1, 4), "").cast("binary")).alias("first_md5"))


CLIENTS = Made("""SELECT c_custkey AS req, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || '.1, ' || c_nationkey || '.2, 3.3' END AS forwarded, c_name AS peer, CAST(c_custkey % 4 + 1 AS INT) AS hops FROM {customer}""")


@book.query(f"SELECT req, coalesce(trim(string_split(forwarded, ',')[-hops]), peer) AS client FROM {CLIENTS.duck()}")
def client_keys(spark: SparkSession, d: str) -> DataFrame:
    """The n-th forwarded address from the right, else the peer."""
    return CLIENTS.spark(spark, d).select("req", F.coalesce(F.trim(F.try_element_at(F.split("forwarded", ","), -F.col("hops"))), "peer").alias("client"))


_CONFIDENCE = "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END"
OUTPUTS = Made(f"""SELECT event_id AS q, CASE WHEN event_id % 7 = 0 THEN 'no json' ELSE CASE WHEN event_id % 2 = 0 THEN '```json\n' ELSE '' END || '{{{{"answerable": ' || CASE WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END
    || ', "answer": "' || CASE WHEN event_id % 5 = 0 THEN ' ' ELSE ' ' || event_type || ' [1] ' END || '", "citations": ["' || user_id || '", "x", 2], "confidence": "' || {_CONFIDENCE} || '"}}}}' || CASE WHEN event_id % 2 = 0 THEN '\n```' ELSE '' END END AS output FROM {{events}}""")


@book.query(f"""SELECT event_id AS q, event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS answerable, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN '' ELSE event_type || ' [1]' END AS answer,
    CASE WHEN event_id % 7 = 0 THEN [] ELSE [user_id::INTEGER, 2] END AS citations, CASE WHEN event_id % 7 = 0 OR event_id % 4 = 3 THEN 'low' ELSE {_CONFIDENCE} END AS confidence FROM events""")
def parsed_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs as JSON, fences removed: citations that are no numbers are dropped, an unknown confidence is low."""
    plain = F.regexp_replace(F.trim("output"), r"^```(?:json)?\s*|\s*```$", "")
    j = OUTPUTS.spark(spark, d).select("q", F.from_json(plain, "answerable BOOLEAN, answer STRING, citations ARRAY<STRING>, confidence STRING").alias("j"))
    answer = F.trim(F.coalesce("j.answer", F.lit("")))
    cited = F.transform(F.filter(F.coalesce("j.citations", F.array().cast("array<string>")), lambda c: c.rlike("^[0-9]+$")), lambda c: c.cast("int"))
    known = F.col("j.confidence").isin("high", "medium", "low")
    return j.select("q", (F.coalesce("j.answerable", F.lit(False)) & (answer != "")).alias("answerable"), answer.alias("answer"), cited.alias("citations"), F.when(known, F.col("j.confidence")).otherwise("low").alias("confidence"))


@book.query("SELECT doc_id, substr(sha256(source || chr(0) || text), 1, 24) AS key FROM documents")
def rerank_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """The cache key of a (query, passage) pair."""
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat("source", F.lit("\0"), "text"), 256), 1, 24).alias("key"))


FIXES = Made("""SELECT p_partkey AS fix_id, 'the ' || p_name || ' is the ' || p_name AS text, p_name AS old, CASE p_partkey % 3 WHEN 0 THEN p_type || ' ' || p_name WHEN 1 THEN p_name ELSE substring(p_name, 1, 3) END AS new FROM {part}""")


@book.query(f"""SELECT fix_id, CASE WHEN list_sort(string_split(old, ' ')) = list_sort(string_split(new, ' ')) THEN replace(text, old, new) END AS fixed FROM {FIXES.duck()}""")
def layout_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Replacements that only move words; others are refused (null)."""
    same = F.array_sort(F.split("old", " ")) == F.array_sort(F.split("new", " "))
    return FIXES.spark(spark, d).select("fix_id", F.when(same, F.replace("text", F.col("old"), F.col("new"))).alias("fixed"))


SETUPS = Made("""SELECT event_type AS setup, min(event_id) AS ord, round(avg(value) / 50) AS hit, CAST(count(*) AS DOUBLE) AS pairs FROM {events} GROUP BY event_type""")


@book.query(f"SELECT setup FROM {SETUPS.duck()} ORDER BY hit DESC, pairs, ord LIMIT 1")
def best_setup(spark: SparkSession, d: str) -> DataFrame:
    """The setup with the most hits, then the fewest pairs, then the first."""
    return SETUPS.spark(spark, d).agg(F.max_by("setup", F.struct("hit", -F.col("pairs"), -F.col("ord"))).alias("setup"))


@book.query("""SELECT conv_id, min(turn) AS turn_from, max(turn) AS turn_to, coalesce(arg_min(text, turn) FILTER (role = 'assistant' AND text <> ''), 'none') AS first_answer FROM conversations GROUP BY conv_id""")
def page_spans(spark: SparkSession, d: str) -> DataFrame:
    """The first and last row of each group, and its first text that isn't empty."""
    text = F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("text"))
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.min("turn").alias("turn_from"), F.max("turn").alias("turn_to"), F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.col("turn"))), F.lit("none")).alias("first_answer"))


@book.query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS i FROM conversations),
    f AS (SELECT conv_id, turn, i, true AS taken, s AS size FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, t.turn, t.i, f.size + t.s <= 250, CASE WHEN f.size + t.s <= 250 THEN f.size + t.s ELSE f.size END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
    SELECT conv_id, turn FROM f WHERE taken""")
def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a group in rank order, each taken if it still fits the budget, the first always."""
    c = table(spark, d, "conversations").select("conv_id", F.struct((-F.length("text")).alias("o"), "turn", estimate_tokens(F.col("text")).alias("s")).alias("t"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("bigint").alias("size"))
    fits = lambda acc, x: (acc["size"] == 0) | (acc["size"] + x["s"] <= 250)
    fold = F.aggregate(F.array_sort(F.collect_list("t")), start, lambda acc, x: F.struct(F.when(fits(acc, x), F.concat(acc["kept"], F.array(x["turn"]))).otherwise(acc["kept"]).alias("kept"), F.when(fits(acc, x), acc["size"] + x["s"]).otherwise(acc["size"]).alias("size")), lambda acc: acc["kept"])
    return c.groupBy("conv_id").agg(fold.alias("kept")).select("conv_id", F.explode("kept").alias("turn"))


@book.query("SELECT event_type AS setup, count(*) AS pairs, count(DISTINCT user_id) AS questions, round(count(*) / count(DISTINCT user_id), 4) AS per_question FROM events GROUP BY 1")
def pairs_per_question(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs a question."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("setup")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("user_id").alias("questions"))
    return e.withColumn("per_question", F.round(F.col("pairs") / F.col("questions"), 4))


REASONS = Made("""SELECT event_id AS q, CASE WHEN event_type = 'purchase' THEN 'OUT_OF_SCOPE' ELSE 'TAX_YEAR_NOT_COVERED' END AS reason, CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ur' ELSE 'xx' END AS language, CAST(1995 + event_id % 40 AS INT) AS year FROM {events}""")
TEXTS = Fixture("kind string, language string, message string", [("future", "en", "Year {year} comes after {last}."), ("past", "ur", "{year} is before {first}"), ("future", "ur", "later than {last}"), ("any", "en", "Not covered.")])
_KIND = "CASE WHEN reason <> 'TAX_YEAR_NOT_COVERED' THEN 'any' WHEN year > 2027 THEN 'future' ELSE 'past' END"


@book.query(f"SELECT q, replace(replace(replace(message, '{{year}}', year::VARCHAR), '{{last}}', '2027'), '{{first}}', '2003') AS message FROM (SELECT *, {_KIND} AS kind FROM {REASONS.duck()}) LEFT JOIN {TEXTS.duck()} USING (kind, language)")
def refusal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Messages by reason and language, with the years filled in."""
    rows = REASONS.spark(spark, d).withColumn("kind", F.expr(_KIND)).join(F.broadcast(TEXTS.spark(spark, d)), ["kind", "language"], "left")
    filled = F.replace(F.replace(F.replace("message", F.lit("{year}"), F.col("year").cast("string")), F.lit("{last}"), F.lit("2027")), F.lit("{first}"), F.lit("2003"))
    return rows.select("q", filled.alias("message"))


@book.query("""SELECT doc_id, list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN length(text) > 3200 THEN 'over budget' END], lambda r: r IS NOT NULL) AS reasons FROM documents d LEFT JOIN labels l USING (doc_id)""")
def verification_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against each item, as a list; an empty list means verified."""
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    why = F.array(F.when(F.col("known").isNull(), "unlabelled"), F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n") > 3200, "over budget"))
    return rows.select("doc_id", F.array_compact(why).alias("reasons"))


@book.query("""SELECT 'size' AS rule, count(*) AS n FROM conversations WHERE length(text) NOT BETWEEN 3 AND 1000 UNION ALL SELECT 'role', count(*) FROM conversations WHERE role NOT IN ('user', 'assistant')
    UNION ALL SELECT 'order', count(*) FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) WHERE step <> 1""")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each rule of a request log."""
    step = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").select(F.length("text").alias("n"), "role", step.alias("step"))
    bad = {"size": ~F.col("n").between(3, 1000), "role": ~F.col("role").isin("user", "assistant"), "order": F.col("step") != 1}
    counts = c.agg(*[F.count(F.when(wrong, 1)).alias(rule) for rule, wrong in bad.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in bad])).alias("r")).select("r.*")


#: Which rules hold: by hand for the fixed questions, by its pattern for each customer's. A number that is one of the sections on withholding decides too.
@book.query(f"""SELECT question_id, coalesce(t = 7 AND n <> 236, false) AS property, coalesce(t = 8 AND n NOT IN (151, 153), false) AS sales, coalesce(t = 9, false) AS budget, coalesce(t = 4, question_id = 'q9') AS filer FROM (SELECT question_id FROM {ASKED}) LEFT JOIN {RULED.duck()} USING (question_id)""")
def scope_rules(spark: SparkSession, d: str) -> DataFrame:
    """Provincial taxes, future budgets and filer status of questions, by rule."""
    text = F.col("text")
    return asked_rows(spark, d).select("question_id", scope.provincial_property_tax(text).alias("property"), scope.provincial_sales_tax(text).alias("sales"), scope.future_budget(text).alias("budget"), scope.filer_question(text).alias("filer"))


DIVISIONS = Made("""SELECT o_orderkey AS card, o_orderkey AS ord, CASE o_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Division-I' || substring('ABC', CAST(o_custkey % 3 + 1 AS INT), 1) || ' of Part-III of First Schedule and Division l, Part-I of the First Schedule' WHEN 2 THEN 'Division-IV, Part ' || substring('IVX', CAST(o_custkey % 3 + 1 AS INT), 1) || ' of the First Schedule' ELSE 'Division V of Part-II of the Second Schedule' END AS text FROM {orders}""")
@book.query("""SELECT division, arg_min(o_orderkey, o_orderkey) AS card FROM (SELECT o_orderkey, unnest(CASE o_custkey % 4 WHEN 1 THEN ['pIII-divI' || substr('ABC', CAST(o_custkey % 3 + 1 AS INTEGER), 1), 'pI-divI'] WHEN 2 THEN ['p' || substr('IVX', CAST(o_custkey % 3 + 1 AS INTEGER), 1) || '-divIV'] ELSE [] END) AS division FROM orders) GROUP BY division""")
def division_cards(spark: SparkSession, d: str) -> DataFrame:
    """The first rate card that names each rate division."""
    pairs = F.arrays_zip(*[F.regexp_extract_all(F.lower(token_line(F.col("text"))), F.lit(DIVISION), F.lit(i)).alias(n) for i, n in ((1, "div"), (2, "part"))])
    x = DIVISIONS.spark(spark, d).select("card", "ord", F.explode(pairs).alias("x"))
    return x.groupBy(F.concat(F.lit("p"), F.upper("x.part"), F.lit("-div"), F.upper(F.replace("x.div", F.lit("l"), F.lit("i")))).alias("division")).agg(F.min_by("card", "ord").alias("card"))


REPORTS = Made("""SELECT lang AS name, source || '-' || doc_id || '.json' AS path FROM {documents} WHERE lang IS NOT NULL""")


@book.query(f"SELECT name, max(path) AS path FROM {REPORTS.duck()} GROUP BY name")
def newest_reports(spark: SparkSession, d: str) -> DataFrame:
    """The newest report of each name."""
    return newest_report(REPORTS.spark(spark, d))


LINES = Made("""SELECT l_orderkey AS page, k AS ord, k * 12.0 + l_quantity / 5 AS y0, k * 12.0 + l_quantity / 5 + 8 AS y1, CASE l_returnflag WHEN 'R' THEN CAST(k AS STRING) || '% if' WHEN 'A' THEN 'of the amount if' ELSE 'Rs. 500' END AS text FROM """ + NUMBERED)


@book.query(f"SELECT page, ord, coalesce(y0 - lag(y1) OVER w > 5, true) AS starts_row, regexp_matches(text, '^(?:[0-9.]+%|Rs)') AND NOT coalesce(y0 - lag(y1) OVER w < 2 AND regexp_matches(lag(text) OVER w, 'if$'), false) AS starts_rate FROM {LINES.duck()} WINDOW w AS (PARTITION BY page ORDER BY ord)")
def rate_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin a row (a gap above), and lines that begin a rate and don't continue the one above."""
    w = Window.partitionBy("page").orderBy("ord")
    gap = F.col("y0") - F.lag("y1").over(w)
    tail = (gap < 2) & F.lag("text").over(w).rlike("if$")
    return LINES.spark(spark, d).select("page", "ord", F.coalesce(gap > 5, F.lit(True)).alias("starts_row"), (F.col("text").rlike("^(?:[0-9.]+%|Rs)") & ~F.coalesce(tail, F.lit(False))).alias("starts_rate"))


MODELS = Made("""SELECT l_orderkey AS role, LIST('m' || l_suppkey % 5 BY k) AS chain, LISTN(CASE WHEN l_returnflag = 'R' THEN 'm' || l_suppkey % 5 END BY k) AS unavailable FROM """ + NUMBERED + " GROUP BY l_orderkey")


@book.query(f"SELECT role, list_filter(chain, lambda m: NOT list_contains(unavailable, m))[1] AS model FROM {MODELS.duck()}")
def resolved_models(spark: SparkSession, d: str) -> DataFrame:
    """The first model of each fallback chain that is available."""
    return MODELS.spark(spark, d).select("role", F.get(F.array_except("chain", "unavailable"), F.lit(0)).alias("model"))


@book.query("""SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END), 4) AS with_lines FROM (SELECT CASE WHEN source = 'src1' THEN 'own' ELSE lang END AS source, text FROM documents) GROUP BY GROUPING SETS ((source), ())""")
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    """Report groups, one source on its own, with a total."""
    g = table(spark, d, "documents").select(F.when(F.col("source") == "src1", "own").otherwise(F.col("lang")).alias("source"), F.contains("text", F.lit("\n")).cast("int").alias("x"))
    sets = g.groupingSets([[F.col("source")], []], F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("with_lines"), F.grouping("source").alias("__total"))
    return sets.select(F.when(F.col("__total") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "with_lines")
