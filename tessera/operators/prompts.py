"""What goes to a model and what comes back: headed texts, messages, citations, batched calls with replay, and the last checks of an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written

# What a unit is called in the context line of a law's chunks.
UNITS = {"ITR": "Rule", "WHT": "Rate card, section"}


def headed_text(law: Column, law_code: Column, schedule: Column, clause: Column, section: Column, title: Column, text: Column) -> Column:
    """A chunk's text below one line that tells its law, unit and title, so that a piece means something alone."""
    unit = F.lit("Section")
    for code, name in UNITS.items():
        unit = F.when(law_code == code, name).otherwise(unit)
    named = F.when(F.coalesce(title, F.lit("")) != "", title)
    place = F.concat(unit, F.lit(" "), F.coalesce(F.nullif(clause, F.lit("")), section, F.lit("")), F.coalesce(F.concat(F.lit(": "), named), F.lit("")))
    head = F.concat(law, F.lit(" — "), F.when(F.coalesce(schedule, F.lit("")) != "", F.coalesce(title, F.lit(""))).otherwise(place))
    return F.concat(head, F.lit("\n"), text)


def citation_record(n: Column, chunk_id: Column, section_id: Column, law: Column, label: Column, text: Column, page: Column, source_url: Column, version_date: Column) -> Column:
    """A citation as it is shown: with a link to the page of its source."""
    link = F.concat(source_url, F.lit("#page="), page)
    return F.struct(n.alias("n"), chunk_id.alias("chunk_id"), section_id.alias("section_id"), law.alias("law"), label.alias("label"), text.alias("text"), page.alias("page"), link.alias("url"), F.date_format(version_date, "yyyy-MM-dd").alias("version_date"))


def percent(share: Column) -> Column:
    """A share as a percentage with one digit; null stays null."""
    return F.round(100 * share, 1)


def messages(system: Column, question: Column, sources: Column, year: Column, assumed: Column, notes: Column, searches: Column) -> Column:
    """The two messages of an answer: instructions, then the question with its year, notes (companion sources and the like), other wordings that were searched, and the
    numbered sources. Empty parts are left out."""
    said = F.concat(F.lit("Tax year: "), year, F.when(assumed, " (assumed)").otherwise(""))
    listed = F.when(F.size(notes) > 0, F.concat(F.lit("Notes:\n- "), F.array_join(notes, "\n- ")))
    also = F.when(F.size(searches) > 0, F.concat(F.lit("Searched as: "), F.array_join(searches, "; ")))
    body = F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), said, listed, also, F.concat(F.lit("Sources:\n"), sources))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def called(prompts: DataFrame, kept: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """(outputs, kept): the output of every prompt (key, prompt) and whether it was asked for now, and the replay table with the new ones. kept: key, output.

    Only keys that the table does not hold are asked, each once, in batches of `batch` within tasks; the model is any function of a list of prompts. New outputs are
    written before they are used, so a task that is run again for a later step asks nothing twice. Of keys that repeat in `kept` the least output counts."""
    known = kept.groupBy("key").agg(F.min("output").alias("output"))
    wanted = prompts.groupBy("key").agg(F.min("prompt").alias("prompt")).join(known.select("key"), "key", "left_anti")

    def ask(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                out = model(part.column("prompt").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], names=["key", "output"])

    new = written(wanted.mapInArrow(ask, "key string, output string"), "outputs")
    both = known.withColumn("asked", F.lit(False)).unionByName(new.withColumn("asked", F.lit(True)))
    return prompts.join(both, "key", "left"), known.unionByName(new)


def last_checks(reason: Column, answerable: Column, n_cited: Column) -> Column:
    """The end of the refusal cascade: what was refused stays so; then an answer that its model calls not answerable, or one that cites no source that is
    there, is refused."""
    return F.coalesce(reason, F.when(~F.coalesce(answerable, F.lit(False)), "NOT_ANSWERABLE"), F.when(F.coalesce(n_cited, F.lit(0)) == 0, "NO_VALID_CITATION"))


def latest_correctness(setups: DataFrame, reports: DataFrame) -> DataFrame:
    """ord, setup, report, in_scope, correct: each set-up's newest report with its percentages; set-ups without one are skipped. setups: ord, setup; reports: setup, report,
    in_scope, correct, of which the last name is the newest."""
    newest = reports.groupBy("setup").agg(F.max_by(F.struct("report", "in_scope", "correct"), "report").alias("r")).select("setup", "r.*")
    return setups.join(newest, "setup").select("ord", "setup", "report", percent(F.col("in_scope")).alias("in_scope"), percent(F.col("correct")).alias("correct"))


def cross_counts(rows: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts of each cell of a cross table and, as `all`, of its margins, in one pass; a null value is counted as `none`."""
    filled = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in by], *[m.alias(f"__{n}") for n, m in measures.items()])
    counts = [F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"__{n}"), 1)).alias(n) for n in measures]]
    cube = filled.cube(*by).agg(*counts, *[F.grouping(c).alias(f"__g_{c}") for c in by])
    return cube.select(*[F.when(F.col(f"__g_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in by], "n", *measures)
