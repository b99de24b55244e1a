"""Queries on rate cards: chunks, best sources and questions made from the tables. The SQL knows each chunk's numbers from how it was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cards import card_companions, card_index
from tessera.plans.fixtures import NUMBERED, Made
from tessera.plans.registering import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

_NAMED = "CASE WHEN q % 40 = 3 THEN '236K' WHEN q % 40 = 4 THEN '236G' ELSE CAST(q % {0} AS STRING) END"
#: For every part: a piece or a table of the Tenth Schedule, a rate card, a section, or a division of the First Schedule. q counts each kind; rules, d and r say what a text holds.
CHUNKS = Made(f"""SELECT p AS ord, kind, q, CASE kind WHEN 0 THEN CASE WHEN q % 11 < 10 THEN concat('X-sch10-', p) ELSE concat('X-sch10-t', CAST(floor(q / 11) AS INT) % 3 + 1) END WHEN 1 THEN concat('card-', p) WHEN 2 THEN concat('X-s', {_NAMED.format(60)}, '-', p) ELSE concat('X-sch1-p', repeat('I', q % 3 + 1), '-div', repeat('X', q % 4 + 1), CASE WHEN q % 2 = 0 THEN concat('-t', p) ELSE '' END) END AS chunk_id,
    CASE kind WHEN 0 THEN 'X-sch10' WHEN 1 THEN concat('card-', q) WHEN 2 THEN concat('X-s', {_NAMED.format(60)}) ELSE 'X-sch1' END AS section_id, CASE kind WHEN 1 THEN 'WHT' ELSE 'ITO' END AS law_code, CASE kind WHEN 1 THEN {_NAMED.format(40)} WHEN 2 THEN {_NAMED.format(60)} END AS section, CASE WHEN kind IN (0, 3) THEN 'schedule' END AS schedule,
    CASE kind WHEN 0 THEN concat('(1) as in ', q % 14, '. The rule of ', p, ', and 3.', q % 10, ' of ', (q + 5) % 9, '. [Rate') WHEN 1 THEN concat(CASE q % 3 WHEN 0 THEN 'R. 1 of the Tenth Schedule' WHEN 1 THEN 'R.10 of Tenth Schedule, R.1(a) of Tenth Schedule' ELSE 'R.4 | Tenth Schedule' END, CASE WHEN q % 2 = 0 THEN concat(' Division-', repeat('X', q % 5 + 1), ' of Part-', repeat('I', q % 3 + 1), ' of the First Schedule') ELSE '' END) ELSE concat('text ', p) END AS text
    FROM (SELECT p_partkey AS p, CAST(p_partkey % 4 AS INT) AS kind, CAST(floor(p_partkey / 4) AS INT) AS q FROM {{part}}) a""")
#: The sources of each order's question, up to seven, and the question's subject.
TOP = Made(f"SELECT l_orderkey AS question_id, min(k) AS rank, l_partkey AS p FROM {NUMBERED} GROUP BY l_orderkey, l_partkey")
ASKS = Made("SELECT o_orderkey AS question_id, o_custkey % 2 = 0 AS filer, array(concat('Y-s', o_orderkey % 5), concat('X-s', o_orderkey % 70), 'X-s236K') AS named FROM {orders}")
_INDEX = f"""ch AS (SELECT * FROM {CHUNKS.duck()}), pl AS (SELECT ord * 2 + i AS pos, chunk_id, n FROM (SELECT ord, chunk_id, q % 14 AS n, 0 AS i FROM ch WHERE kind = 0 AND q % 11 < 10 UNION ALL SELECT ord, chunk_id, (q + 5) % 9, 1 FROM ch WHERE kind = 0 AND q % 11 < 10)),
    chain AS (SELECT 0 AS rule, -1::BIGINT AS pos UNION ALL SELECT rule + 1, (SELECT min(pl.pos) FROM pl WHERE pl.n = rule + 1 AND pl.pos > chain.pos) FROM chain WHERE chain.pos IS NOT NULL AND rule < 99),
    rules AS (SELECT rule, chunk_id FROM chain JOIN pl ON pl.pos = chain.pos AND pl.n = chain.rule WHERE rule > 0), tables AS (SELECT 't' || (q // 11 % 3 + 1) AS name, arg_max(chunk_id, ord) AS chunk_id FROM ch WHERE kind = 0 AND q % 11 = 10 GROUP BY 1),
    cards AS (SELECT section, arg_min(chunk_id, ord) AS chunk_id FROM ch WHERE kind = 1 GROUP BY section), cr AS (SELECT chunk_id, unnest(CASE q % 3 WHEN 0 THEN [1] WHEN 1 THEN [10, 1] ELSE [] END) AS rule, unnest(CASE q % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] ELSE [] END) AS i FROM ch WHERE kind = 1),
    dv AS (SELECT 'X-sch1-p' || repeat('I', q % 3 + 1) || '-div' || repeat('X', q % 5 + 1) AS division, arg_min(section, ord) AS section FROM ch WHERE kind = 1 AND q % 2 = 0 GROUP BY 1),
    sec AS (SELECT chunk_id, section FROM ch WHERE kind = 2 AND section IN (SELECT section FROM cards) UNION SELECT chunk_id, dv.section FROM ch JOIN dv ON kind = 3 AND division = 'X-sch1-p' || repeat('I', q % 3 + 1) || '-div' || repeat('X', q % 4 + 1))"""


@book.query(f"WITH RECURSIVE {_INDEX} SELECT rule, chunk_id FROM rules")
def schedule_rule_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where each rule of the schedule begins."""
    return card_index(CHUNKS.spark(spark, d), "X-sch10", "ITO", "X-sch1").rules


@book.query(f"""WITH RECURSIVE {_INDEX}, t AS (SELECT question_id, rank, chunk_id, law_code, section FROM (SELECT question_id, min(rank) AS rank, chunk_id FROM {TOP.duck()} JOIN ch ON ch.ord = p GROUP BY ALL) JOIN (SELECT DISTINCT chunk_id, law_code, section FROM ch) USING (chunk_id)), a AS (SELECT * FROM {ASKS.duck()}),
    held AS (SELECT * FROM t WHERE law_code = 'WHT'), ab AS (SELECT question_id, sec.section, min(rank) AS pos FROM t JOIN sec USING (chunk_id) WHERE rank <= 3 GROUP BY ALL),
    c1 AS (SELECT ab.question_id, ab.section, cards.chunk_id, pos FROM ab JOIN cards USING (section) JOIN a USING (question_id) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.question_id = ab.question_id AND h.section = ab.section) AND (filer OR cards.chunk_id IN (SELECT chunk_id FROM cr WHERE rule = 1))),
    nm AS (SELECT question_id, unnest(named) AS sid, generate_subscripts(named, 1) AS i FROM a WHERE filer AND question_id NOT IN (SELECT question_id FROM held) AND question_id NOT IN (SELECT question_id FROM c1)),
    c2 AS (SELECT question_id, arg_min(cards.section, i) AS section, arg_min(chunk_id, i) AS chunk_id, 0 AS pos FROM nm JOIN cards ON sid = 'X-s' || cards.section GROUP BY question_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)),
    w AS (SELECT question_id, rule, min(pos) AS pos FROM (SELECT question_id, 1 AS rule, 0 AS pos FROM a WHERE filer UNION ALL SELECT h.question_id, rule, 1000 + rank * 10 + i FROM held h JOIN cr USING (chunk_id) JOIN a ON a.question_id = h.question_id WHERE rank <= 3 AND (filer OR rule = 1) UNION ALL SELECT c.question_id, rule, 2000 + n * 10 + i FROM c JOIN cr USING (chunk_id) JOIN a ON a.question_id = c.question_id WHERE filer OR rule = 1) GROUP BY ALL),
    s AS (SELECT DISTINCT question_id, section FROM (SELECT question_id, section FROM held UNION ALL SELECT question_id, section FROM c)),
    every AS (SELECT question_id, chunk_id, CASE WHEN n = 1 THEN 0 ELSE 2 END AS g, lpad(n::VARCHAR, 9, '0') AS place FROM c UNION ALL SELECT question_id, chunk_id, 1, lpad(pos::VARCHAR, 9, '0') FROM w JOIN rules USING (rule)
      UNION ALL SELECT s.question_id, tables.chunk_id, 3, section FROM s JOIN w ON w.question_id = s.question_id AND rule = 1 JOIN (VALUES ('236K', 't1'), ('236C', 't2'), ('236G', 't2'), ('236H', 't2')) v(x, name) ON x = section JOIN tables USING (name)),
    f AS (SELECT question_id, chunk_id, min(g || place) AS pos FROM every GROUP BY ALL)
    SELECT question_id, chunk_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n FROM f ANTI JOIN t USING (question_id, chunk_id)) WHERE n <= 3""")
def rate_card_companions(spark: SparkSession, d: str) -> DataFrame:
    """Cards, rules and tables that go with the sources of each question."""
    chunks = CHUNKS.spark(spark, d)
    top = TOP.spark(spark, d).join(chunks.select(F.col("ord").alias("p"), "chunk_id"), "p").groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    distinct = chunks.select("chunk_id", "law_code", "section").distinct()
    return card_companions(card_index(chunks, "X-sch10", "ITO", "X-sch1"), top, distinct, ASKS.spark(spark, d), "X")
