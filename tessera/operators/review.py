"""Evaluation and review: answers against a test set, verdicts, pools and score policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def citation_correct(refused: Column, cited: Column, gold: Column, acceptable: Column) -> Column:
    """Whether an answer was given and cites a section that is gold or acceptable."""
    return ~refused & F.coalesce(F.arrays_overlap(cited, F.concat(gold, acceptable)), F.lit(False))


def answer_rates(rows: DataFrame, group: str, outside: str, digits: int = 4) -> DataFrame:
    """group, n, answered, correct, correct_answered: rates of each group, of `in_scope` (all but the group `outside`) and
    of `all`. rows: group, refused, correct. Correct citations are counted over all rows and over those answered, null
    where none was."""
    part = F.explode(F.filter(F.array(F.col(group), F.when(F.col(group) != outside, F.lit("in_scope")), F.lit("all")), lambda g: g.isNotNull()))
    answered, correct = (~F.col("refused")).cast("double"), F.col("correct").cast("double")
    return rows.withColumn(group, part).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(answered), digits).alias("answered"), F.round(F.avg(correct), digits).alias("correct"),
        F.round(F.avg(F.when(~F.col("refused"), correct)), digits).alias("correct_answered"))


def verdict(text: Column) -> Column:
    """A judge's word as yes or no: yes, true, ok and correct mean yes; null stays null."""
    return F.lower(F.regexp_replace(text, r"[\s.!]", "")).isin("yes", "true", "ok", "correct")


def agreement(rows: DataFrame, first: str, second: str) -> DataFrame:
    """agreed, checked, rate: how often two judges agree, over the items that both judged."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    counts = rows.agg(F.count(F.when(both & (F.col(first) == F.col(second)), 1)).alias("agreed"), F.count(F.when(both, 1)).alias("checked"))
    return counts.withColumn("rate", F.when(F.col("checked") > 0, F.round(F.col("agreed") / F.col("checked"), 4)))


def reviewed_status(items: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Add `status`: what a person has set stays; `reviewed` where a sampled item was found correct or fixed and its
    checks are ok; else `machine` if they are ok, and `open`. items: key, status, ok; answers: key, answer."""
    good = F.col("answer").isin("correct", "fixed")
    new = F.when(F.col("ok") & F.coalesce(good, F.lit(False)), "reviewed").when(F.col("ok"), "machine").otherwise("open")
    return items.join(answers, key, "left").withColumn("status", F.when(F.col("status") == "human", "human").otherwise(new)).select(*items.columns)


def with_children(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Each row that has no parent, with the sorted keys of its children."""
    children = rows.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.sort_array(F.collect_list(key)).alias("children"))
    return rows.filter(F.col(parent).isNull()).join(children, key, "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def more_pieces(pool: DataFrame, sections: DataFrame, pieces: DataFrame, most_sections: int = 6, most_pieces: int = 3) -> DataFrame:
    """question_id, chunk_id of pieces that the glossary's sections add to a pool: the first `most_sections` of a question,
    `most_pieces` of each, in its year, and none that the pool has. pool: question_id, chunk_id; sections: question_id,
    tax_year, ord, section_id; pieces: section_id, chunk_id, tax_year_from, tax_year_to."""
    first = sections.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("ord", "section_id"))).filter(F.col("n") <= most_sections)
    valid = (F.col("tax_year_from") <= F.col("tax_year")) & (F.col("tax_year_to").isNull() | (F.col("tax_year_to") >= F.col("tax_year")))
    found = first.join(pieces, "section_id").filter(valid).join(pool, ["question_id", "chunk_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("question_id", "section_id").orderBy("chunk_id"))
    return found.withColumn("k", rank).filter(F.col("k") <= most_pieces).select("question_id", "section_id", "chunk_id")


def policy_scores(passages: DataFrame, policy: str = "max_non_en") -> DataFrame:
    """question_id, chunk_id, score: a passage's score against the question, or also against the rewrite where the policy is
    `max`, or `max_non_en` and the question is not English; a chunk has the best of its passages, 0 at least. passages:
    question_id, language, chunk_id, passage_no, to_question, to_rewrite."""
    also = {"question": F.lit(False), "max": F.lit(True), "max_non_en": F.col("language") != "en"}[policy]
    score = F.when(also, F.greatest("to_question", "to_rewrite")).otherwise(F.col("to_question"))
    return passages.groupBy("question_id", "chunk_id").agg(F.greatest(F.coalesce(F.max(score), F.lit(0.0)), F.lit(0.0)).alias("score"))


def source_label(law: Column, kind: Column, section: Column, title: Column, subsections: Column) -> Column:
    """How a source is named to a reader: its law, its section, rule or card, and its title where it has one."""
    unit = F.when(kind == "table", "Table").when(kind == "schedule", "Schedule").when(kind == "rule", "Rule").otherwise("Section")
    return F.concat_ws(", ", law, F.concat(unit, F.lit(" "), section, F.coalesce(subsections, F.lit(""))), F.nullif(title, F.lit("")))


def source_blocks(sources: DataFrame, question: str, rank: str, label: str, text: str) -> DataFrame:
    """question, prompt: the numbered blocks of a question's sources, in order."""
    block = F.concat(F.lit("["), F.col(rank), F.lit("] "), F.col(label), F.lit("\n"), F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n")
    return sources.groupBy(question).agg(joined.alias("prompt"))


def error_kind(status: Column, message: Column) -> Column:
    """Why a model call failed: the day's quota, a model that is not there, the minute's rate, or something else."""
    words = F.lower(message)
    daily = words.contains("per day") | words.contains("perday") | words.contains("daily")
    return F.when((status == 429) & daily, "daily_limit").when(status == 429, "rate_limit").when(status.isin(404, 503) | words.contains("overloaded"), "unavailable").otherwise("other")


def retry_seconds(header: Column, body: Column) -> Column:
    """How long to wait before the next try: from the header, else from the message, else null."""
    said = F.regexp_extract(F.lower(body), r"(?:retry|try again) (?:in|after) ([0-9]+(?:[.][0-9]+)?) ?s", 1)
    return F.coalesce(header.try_cast("double"), F.nullif(said, F.lit("")).try_cast("double"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def preview(text: Column, most: int = 300) -> Column:
    """A text in one line, cut with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))
