"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stash

#: Character classes of the histogram. Lower-case letters, most of any text, are counted as what none of the others holds.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"[\x20\x09-\x0D]", "point": r"[.,;:!?'()\-]", "rest": r"[^\p{Ll}\p{Lu}\p{Nd}\x20\x09-\x0D.,;:!?'()\-]"}
SPACE = list(CLASSES).index("space")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often they are used later: a generator of one row keeps the
    optimizer from copying the expressions into their uses."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__made.{n}").alias(n) for n in columns])


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _after(values: Column, places: int) -> Column:
    return F.slice(values, places + 1, F.greatest(F.size(values) - places, F.lit(0)))


def window_codes(codes: Column) -> Column:
    """A code for each 5-word window, of the codes of its words. `codes` must be a column that is already there: the
    function looks into it once a window."""
    whole = F.transform(codes, lambda x, i: F.xxhash64(x, *[F.get(codes, i + k) for k in range(1, 5)]))
    return F.slice(whole, F.lit(1), F.greatest(F.size(codes) - 4, F.lit(0)))


def with_repeated_words(rows: DataFrame, windows: str, out: str) -> DataFrame:
    """Add the words in windows that occur twice or more: only where two codes are equal, the windows are sorted by
    code, equal neighbours give their places, and the places' five words are counted once each."""
    none = F.array().cast("array<int>")
    w = F.col(windows)
    placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = once(rows, placed=F.when(F.size(F.array_distinct(w)) < F.size(w), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    p = F.col("placed")
    pairs = F.zip_with(p, _after(p, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    rows = once(rows.drop(windows), places=F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.coalesce(x, none))))))
    covered = F.zip_with("places", _after(F.col("places"), 1), lambda a, b: F.coalesce(F.least(F.lit(5), b - a), F.lit(5)))
    return rows.withColumn(out, _sum(covered)).drop("placed", "places")


def common_words(docs: DataFrame, top: int) -> DataFrame:
    """lang, ref_words: the `top` commonest words of each language, lower-cased, from all its words. Counts are summed in
    each task before they are shuffled."""
    words = F.explode_outer(words_of(F.lower("text"))).alias("word")
    counts = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), words).filter("word IS NOT NULL").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("best"))
    return best.select("lang", F.col("best.word").alias("ref_words"))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, the class histogram and the counts of the language's common words of every whole
    text."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(common, "lang", "left").withColumn("ref_words", F.coalesce("ref_words", F.array().cast("array<string>")))
    # white space is counted as what the words leave; a text of one line repeats none
    held = [F.regexp_count("text", F.lit(p)).cast("double") for k, p in CLASSES.items() if k != "space"]
    lines = F.when(F.contains("text", F.lit("\n")), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))).otherwise(F.array().cast("array<string>"))
    rows = once(rows, words=words_of(F.col("text")), lines=lines, held=F.array(*held), n_symbols=F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
    # no word is longer in capitals, so those over the longest common word are none of them
    longest = F.coalesce(F.array_max(F.transform("ref_words", F.length)), F.lit(0))
    rows = once(rows, longest=longest, codes=F.transform("words", lambda w: F.xxhash64(w))).select(
        "doc_id", "lang", "ref_words", "codes", "held", F.length("text").cast("double").alias("n_chars"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("words").cast("long").alias("n_words"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.filter("words", lambda w: F.length(w) <= F.col("longest")), F.lower).alias("near"),
    )
    own = F.transform("ref_words", lambda w: (F.size("near") - F.size(F.array_remove(F.col("near"), w))).cast("double"))
    rows = once(rows, windows=window_codes(F.col("codes")), own=own).drop("codes", "near")
    space = F.col("n_chars") - F.col("word_chars")
    lower = F.greatest(F.col("word_chars") - F.aggregate("held", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    classes = F.concat(F.slice("held", 1, SPACE), F.array(space), F.slice("held", SPACE + 1, len(CLASSES)), F.array(lower))
    rows = with_repeated_words(rows, "windows", "n_repeat_words")
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", classes.alias("classes"), "own")


def references(rows: DataFrame, top: int) -> DataFrame:
    """One row a language from all its documents: the summed class histogram, and the counts of its common words, then
    the count of all its other words. Counts are summed in each task before they are shuffled."""
    n = len(CLASSES) + 1
    sums = rows.groupBy("lang").agg(
        *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n)], *[F.sum(F.get("own", F.lit(i))).alias(f"w{i}") for i in range(top)],
        F.sum("n_words").alias("all_words"), F.max(F.size("own")).alias("n_common"),
    )
    common = F.slice(F.array(*[f"w{i}" for i in range(top)]), F.lit(1), F.col("n_common"))
    known = F.aggregate(common, F.lit(0.0), lambda a, x: a + x)
    return sums.select("lang", F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"), F.concat(common, F.array(F.col("all_words") - known)).alias("ref_counts"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length; 0 if either is empty."""
    total_a = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    total_b = F.aggregate(b, F.lit(0.0), lambda s, x: s + x)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    shares = F.zip_with(F.transform(a, lambda x: x / F.greatest(total_a, F.lit(1.0))), F.transform(b, lambda x: x / F.greatest(total_b, F.lit(1.0))), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    divergence = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((total_a > 0) & (total_b > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def judge_quality(
    docs: DataFrame, max_class_distance: float = 0.27, max_word_distance: float = 0.45, min_chars: int = 200, min_words: int = 50, top: int = 20, max_languages: int = 10_000
) -> DataFrame:
    """Base counts of every document, and whether it is kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. Else a document goes if
    the Jensen-Shannon distance of its character classes (given min_chars characters) or of its common words (given
    min_words words) to those of its language is over the limit; a shorter text passes that test unmeasured. A null
    lang is a language of its own, a null text has no words. Common words are the `top` of all words. Repeated rows are judged each. The references are one
    row a language and are broadcast up to max_languages, joined by shuffle beyond.
    """
    common = stash(common_words(docs, top), "common", max_languages)
    rows = stash(features(docs, F.broadcast(common) if common.count() <= max_languages else common), "quality")
    refs = stash(references(rows, top), "references", max_languages)
    joined = rows.join(F.broadcast(refs) if refs.count() <= max_languages else refs, "lang")
    own_all = F.concat("own", F.array(F.col("n_words") - F.aggregate("own", F.lit(0.0), lambda a, x: a + x)))
    measured = once(
        joined,
        class_distance=F.when(F.col("n_chars") >= min_chars, js_distance(F.col("classes"), F.col("ref_classes"))),
        word_distance=F.when(F.col("n_words") >= min_words, js_distance(own_all, F.col("ref_counts"))),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
