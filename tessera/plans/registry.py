"""All registered queries, and the SQL that checks them."""

from tessera.plans import answer_queries, card_queries, detail_queries, evaluation_queries, index_queries, ordered_queries, question_queries, report_queries, retrieval_queries, review_queries, stream_queries, structure_queries, summary_queries

_MODULES = [retrieval_queries, ordered_queries, summary_queries, question_queries, stream_queries, detail_queries, answer_queries, review_queries, index_queries, structure_queries, evaluation_queries, card_queries, report_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
