"""Questions answered in bulk: plan, retrieve, pin, rerank, rank, and the decision whether to answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.lookup import asked_definitions, final_ranks, named_sections, shared_words
from tessera.operators.retrieval import asked_terms, both_searches, fuse_rows
from tessera.operators.review import more_pieces
from tessera.operators.serving import refusal
from tessera.operators.sizes import small
from tessera.sources.shared import written


def plan_questions(questions: DataFrame, current_year: int) -> DataFrame:
    """question_id, text, language, tax_year (the current one where none is named), tax_year_assumed."""
    year = t.tax_year(F.col("text"))
    return questions.select("question_id", "text", t.language(F.col("text")).alias("language"), F.coalesce(year, F.lit(current_year)).alias("tax_year"), year.isNull().alias("tax_year_assumed"))


def in_year(year: Column) -> Column:
    """A chunk's validity holds the year; no end is open."""
    return (F.col("tax_year_from") <= year) & (F.col("tax_year_to").isNull() | (F.col("tax_year_to") >= year))


def keyword_score(question: Column, passage: Column) -> Column:
    """The default reranker: the share of the question's words of over four letters that the passage holds."""
    words = F.array_distinct(F.filter(F.split(F.lower(question), r"\s+"), lambda w: F.length(w) > 4))
    # the passage is put in small letters once, not for each word
    held = F.get(F.transform(F.array(F.lower(passage)), lambda p: F.size(F.filter(words, lambda w: F.contains(p, w)))), F.lit(0))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(held / F.size(words), 6))


def best_windows(docs: DataFrame, pairs: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """question_id, chunk_id, text: of each pair's chunk that is longer than `size`, the later window with the most rare words of the
    question (question_id, w), of equal ones the first; none where no window shares a word. A word counts by its idf over all
    chunks."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    df = docs.select(F.explode(own).alias("w")).join(small(words.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("w", F.ln(F.col("n") / F.col("df")).alias("v"))  # one row
    long = docs.filter(F.length("text") > size)
    hits = shared_words(long, "chunk_id", "text", pairs, words, "question_id", size).join(small(idf), "w")
    scores = hits.groupBy("question_id", "chunk_id", "begin").agg(F.round(F.sum("v"), 6).alias("score")).filter("score > 0")
    best = scores.groupBy("question_id", "chunk_id").agg(F.max_by("begin", F.struct("score", -F.col("begin"))).alias("begin"))
    return docs.select("chunk_id", "text").join(small(written(best, "windows")), "chunk_id").select("question_id", "chunk_id", F.expr(f"substring(text, begin + 1, {size})").alias("text"))


def pinned_pieces(refs: DataFrame, valid: DataFrame, years: DataFrame, found: DataFrame, most_pieces: int) -> DataFrame:
    """question_id, chunk_id, prior: pieces of the sections that a question names (question_id, ord, section_id), `most_pieces` of each, those that the
    search found first and in its order, of chunks that hold in the question's year."""
    pieces = refs.filter("section_id IS NOT NULL").join(valid, "section_id").join(found.select("question_id", "chunk_id", F.col("n").alias("found_at")), ["question_id", "chunk_id"], "left")
    order = Window.partitionBy("question_id", "ord", "section_id").orderBy(F.coalesce("found_at", F.lit(1 << 30)), "chunk_id")
    kept = pieces.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most_pieces).join(years, "question_id").filter(in_year(F.col("tax_year")))
    return kept.groupBy("question_id", "chunk_id").agg(F.min(F.col("ord") * most_pieces + F.col("k")).alias("prior"))


def pinned_definitions(phrases: DataFrame, terms: DataFrame, valid: DataFrame, years: DataFrame, found: DataFrame, most_pieces: int) -> DataFrame:
    """question_id, chunk_id, prior: the chunk that defines the term which a question, or a rewrite of it, asks for, and, where the definition only
    points to another section, pieces of that section. terms: term, clause, chunk_id, points_to (a section_id or null)."""
    asked = asked_definitions(phrases.select(F.struct("question_id", "n").alias("question_id"), "text"), terms).join(terms, ["term", "clause"])
    asked = asked.select("question_id.question_id", F.col("question_id.n").alias("ord"), "chunk_id", "points_to")
    own = asked.join(valid.select("chunk_id", "tax_year_from"), "chunk_id").join(years, "question_id").filter(F.col("tax_year_from") <= F.col("tax_year")).select("question_id", "chunk_id", F.col("ord").alias("prior"))
    aims = asked.filter("points_to IS NOT NULL").select("question_id", "ord", F.col("points_to").alias("section_id"))
    pieces = aims.join(valid, "section_id").join(found.select("question_id", "chunk_id", F.col("n").alias("found_at")), ["question_id", "chunk_id"], "left")
    order = Window.partitionBy("question_id", "ord", "section_id").orderBy(F.coalesce("found_at", F.lit(1 << 30)), "chunk_id")
    more = pieces.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most_pieces).join(years, "question_id").filter(F.col("tax_year_from") <= F.col("tax_year"))
    both = own.unionByName(more.select("question_id", "chunk_id", (F.lit(1000) + F.col("ord") * most_pieces + F.col("k")).alias("prior")))
    return both.groupBy("question_id", "chunk_id").agg(F.min("prior").alias("prior"))


def ask(
    questions: DataFrame, chunks: DataFrame, sections: DataFrame, current_year: int, first_year: int, last_year: int, threshold: float = 0.0005, candidates: int = 30, reranked: int = 15, answered: int = 6, most_pieces: int = 3,
    score: Callable[[Column, Column], Column] = keyword_score, rewrites: DataFrame | None = None, definitions: DataFrame | None = None, named: DataFrame | None = None, most_sections: int = 6, window: int = 0, policy: str = "question",
) -> tuple[DataFrame, DataFrame]:
    """(decisions, sources) for a table of questions.

    decisions: question_id, language, tax_year, reason (null where answered), top. sources: question_id, chunk_id, via,
    score, rank of the `answered` best. Every phrasing of a question (rewrites: question_id, n from 1, text) is searched twice, all lists are fused, and
    only the `reranked` best reach the scorer, since the cheap ranking is cut before the costly one begins. Both searches rank only
    chunks of the question's year, so chunks of other years take no place; word statistics are of all.

    Pieces of sections that a question names are pinned ahead of what search finds, then chunks that define a term it asks for (definitions: term, clause,
    chunk_id, points_to); pieces of sections that its glossary terms name (named: question_id, ord, section_id) join the pool behind the rest. A
    chunk longer than `window` (0: none) is scored by its text and by its best later window. policy: a passage's score is that
    of the question, or the best of it and the first rewrite (`max`; `max_non_en`: for questions not in English); passages of named sections are
    scored against all rewrites too.
    chunks: chunk_id, section_id, text, tax_year_from, tax_year_to; sections: kind, number, section_id.
    """
    plan = written(plan_questions(questions, current_year), "plan")
    docs = chunks.select("chunk_id", "text")
    years = plan.select("question_id", "tax_year")
    valid = chunks.select("chunk_id", "section_id", "tax_year_from", "tax_year_to")
    phrases = plan.select("question_id", F.lit(0).alias("n"), "text")
    if rewrites is not None:
        phrases = phrases.unionByName(rewrites.select("question_id", F.col("n").cast("int").alias("n"), "text"))
    asked = asked_terms(phrases.join(years, "question_id").select(F.struct("question_id", "n").alias("ask"), "tax_year", "text"), "ask", ["tax_year"], ["tax_year_from", "tax_year_to"], in_year(F.col("tax_year")))
    lists = [r.select("ask.question_id", "chunk_id", (F.col("ask.n") * 2 + i).alias("list_idx"), "rank") for i, r in enumerate(both_searches(chunks, asked, "chunk_id", candidates))]
    found = fuse_rows(lists[0].unionByName(lists[1]), "question_id", "chunk_id", reranked).select("question_id", "chunk_id", F.col("rank").alias("n"))
    found = written(found, "found")  # decisions and sources begin here
    refs = named_sections(questions, sections)
    pins = pinned_pieces(refs, valid, years, found, most_pieces)
    if definitions is not None:
        more = pinned_definitions(phrases, definitions, valid, years, found, most_pieces)
        pins = pins.unionByName(more.join(pins, ["question_id", "chunk_id"], "left_anti").withColumn("prior", F.col("prior") + 100_000))
    pinned = written(pins, "pinned").select("question_id", "chunk_id", F.lit("lookup").alias("via"), "prior")
    pool = pinned.unionByName(found.join(pinned, ["question_id", "chunk_id"], "left_anti").select("question_id", "chunk_id", F.lit("search").alias("via"), F.col("n").alias("prior")))
    if named is not None:
        added = more_pieces(pool.select("question_id", "chunk_id"), named.join(years, "question_id"), valid, most_sections, most_pieces).groupBy("question_id", "chunk_id").agg(F.lit(1 << 20).alias("prior"))
        pool = pool.unionByName(added.select("question_id", "chunk_id", F.lit("search").alias("via"), "prior"))
    pool = written(pool, "pool")
    passages = docs.join(small(pool.select("question_id", "chunk_id")), "chunk_id").select("question_id", "chunk_id", "text")
    if window:
        words = phrases.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w")).distinct()
        passages = passages.unionByName(best_windows(docs, pool.select("question_id", "chunk_id"), words, window))
    scored = passages.join(plan.select("question_id", "language", F.col("text").alias("question")), "question_id").withColumn("to_question", score(F.col("question"), F.col("text")))
    if rewrites is not None:
        every = phrases.filter("n > 0").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]).alias("rewrites"))
        scored = scored.join(every, "question_id", "left")
        also = {"question": F.lit(False), "max": F.lit(True), "max_non_en": F.col("language") != "en"}[policy]
        to_first = F.when(also & F.col("rewrites").isNotNull(), score(F.get("rewrites", F.lit(0)), F.col("text")))
        best = F.greatest("to_question", to_first)
        if named is not None:
            meant = named.join(chunks.select("section_id", "chunk_id"), "section_id").select("question_id", "chunk_id", F.lit(True).alias("meant")).distinct()
            to_all = F.array_max(F.transform("rewrites", lambda r: score(r, F.col("text"))))
            scored = scored.join(meant, ["question_id", "chunk_id"], "left")
            best = F.greatest(best, F.when(F.col("meant"), to_all))
        scored = scored.withColumn("to_question", best)
    ranked = final_ranks(pool, scored.select("question_id", "chunk_id", F.col("to_question").alias("score"))).join(pool.select("question_id", "chunk_id", "via"), ["question_id", "chunk_id"])
    facts = ranked.groupBy("question_id").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n_candidates"))
    are_named = pinned.groupBy("question_id").agg(F.lit(True).alias("named"))
    missing = refs.filter("section_id IS NULL").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_missing"))
    state = plan.join(facts, "question_id", "left").join(are_named, "question_id", "left").join(missing, "question_id", "left")
    reason = refusal(F.lit("income_tax"), F.col("tax_year"), first_year, last_year, F.coalesce("n_missing", F.lit(0)), F.coalesce("named", F.lit(False)), F.coalesce("n_candidates", F.lit(0)), F.col("top"), threshold)
    decisions = state.select("question_id", "language", "tax_year", reason.alias("reason"), "top")
    return decisions, ranked.filter(F.col("rank") <= answered).select("question_id", "chunk_id", "via", "score", "rank")
