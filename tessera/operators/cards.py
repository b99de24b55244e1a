"""Rate cards and the rules that they depend on: one index, followed for two hops from the best sources of a question."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.phrases import token_line
from tessera.operators.lookup import CARD_RULE, companions
from tessera.operators.sizes import small
from tessera.sources.shared import written

# The table of rule 1 that holds for a section, and the law of rate cards.
RULE_TABLES = {"236K": "t1", "236C": "t2", "236G": "t2", "236H": "t2"}
CARDS = "WHT"
#: A division and its part of the First Schedule, in a lower-cased token line; a small l stands for a one.
DIVISION = " division  (?:-  )?([ivxl]+[a-c]?)  (?:,  )?(?:of  )?part  (?:-  )?([ivx]+)  of  (?:the  )?first "


class CardIndex(NamedTuple):
    """rules: rule, chunk_id; tables: name, chunk_id; cards: section, chunk_id (the first of a section); card_rules: chunk_id, ord, rule;
    divisions: division, section; sections: chunk_id, section (what a source is about, where a card exists for it), distinct: pieces that share a chunk id count once."""

    rules: DataFrame
    tables: DataFrame
    cards: DataFrame
    card_rules: DataFrame
    divisions: DataFrame
    sections: DataFrame


def card_rules(chunks: DataFrame) -> DataFrame:
    """chunk_id, ord, rule: the rules of the Tenth Schedule that a card's text points to, in order."""
    found = F.regexp_extract_all(F.lower(token_line(F.col("text"))), F.lit(CARD_RULE), F.lit(1))
    return chunks.select("chunk_id", F.posexplode(F.transform(found, lambda n: n.cast("int"))).alias("ord", "rule"))


def rule_starts(pieces: DataFrame) -> DataFrame:
    """rule, chunk_id: where each rule of a schedule begins. A number, a point and a capital begin a rule only if the number follows the
    last rule found, so rules run 1, 2, 3 and so on.

    The rule n begins at the first place of n behind that of n - 1. The places are written once and each rule is the least place of its number
    behind the last rule, a distributed minimum; so no task holds a schedule, and the rounds are as few as it has rules (two digits, so 99 at most)."""
    line = token_line(F.col("text"))
    found = F.regexp_extract_all(line, F.lit(r" ([0-9]{1,2})  \.  (?:\[  )?[A-Z]"), F.lit(1))
    places = written(pieces.select("ord", "chunk_id", F.posexplode(F.transform(found, lambda n: n.cast("int"))).alias("at", "n")), "places")
    place, last, rules = F.struct("ord", "at", "chunk_id"), None, []
    while len(rules) < 99:
        own = places.filter(F.col("n") == len(rules) + 1)
        later = own if last is None else own.filter(place > F.struct(F.lit(last["ord"]).cast("long").alias("ord"), F.lit(last["at"]).alias("at"), F.lit(last["chunk_id"]).alias("chunk_id")))
        last = later.agg(F.min(place).alias("p")).first()["p"]
        if last is None:
            break
        rules.append((len(rules) + 1, last["chunk_id"]))
    return pieces.sparkSession.createDataFrame(rules, "rule int, chunk_id string")


def card_index(chunks: DataFrame, schedule: str, law: str, prefix: str) -> CardIndex:
    """The index of a collection. schedule: the section_id of the schedule with the rules; law: the law code whose sections have cards; prefix: of its
    First Schedule's chunk ids. chunks: chunk_id, section_id, law_code, section, schedule, ord, text."""
    pieces = chunks.filter(F.col("section_id") == schedule).withColumn("suffix", F.element_at(F.split("chunk_id", "-"), -1)).withColumn("ord", F.col("ord").cast("long"))
    is_table = F.startswith("suffix", F.lit("t"))
    cards = chunks.filter((F.col("law_code") == CARDS) & F.col("section").isNotNull() & (F.col("section_id") != schedule))
    pairs = F.arrays_zip(*[F.regexp_extract_all(F.lower(token_line(F.col("text"))), F.lit(DIVISION), F.lit(i)).alias(n) for i, n in ((1, "div"), (2, "part"))])
    named = cards.select("ord", "section", F.posexplode(pairs).alias("at", "x"))
    division = F.concat(F.lit(f"{prefix}-p"), F.upper("x.part"), F.lit("-div"), F.upper(F.replace("x.div", F.lit("l"), F.lit("i"))))
    divisions = named.groupBy(division.alias("division")).agg(F.min_by("section", F.struct("ord", "at")).alias("section"))
    first = cards.groupBy("section").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"))
    of_law = chunks.filter((F.col("law_code") == law) & F.col("section").isNotNull() & F.col("schedule").isNull()).select("chunk_id", "section").join(first.select("section"), "section", "left_semi")
    own = F.regexp_extract("chunk_id", rf"^({prefix}-p[IVX]+-div[IVXA-Z]+)(?:-t?[0-9]+)?$", 1)
    by_division = chunks.filter((F.col("law_code") != law) | F.col("section").isNull() | F.col("schedule").isNotNull()).select("chunk_id", own.alias("division")).join(divisions, "division").select("chunk_id", "section")
    tables = pieces.filter(is_table).groupBy(F.col("suffix").alias("name")).agg(F.max_by("chunk_id", "ord").alias("chunk_id"))
    parts = {"rules": rule_starts(pieces.filter(~is_table)), "tables": tables, "cards": first, "card_rules": card_rules(cards), "divisions": divisions, "sections": of_law.unionByName(by_division).distinct()}
    return CardIndex(**{name: written(rows, f"cards-{name}") for name, rows in parts.items()})


def card_companions(index: CardIndex, top: DataFrame, chunks: DataFrame, questions: DataFrame, law_prefix: str, most: int = 3, best: int = 3) -> DataFrame:
    """question_id, chunk_id, rank: what goes with the best sources of a question, `most` at most and none that it has.

    First the card of the first section that the best sources are about, if no source is a card of it, and the card points to rule 1 or the question is
    about filers; for such a question without any card, that of the first section it names. Then the rules that the cards among the best sources, and the
    added ones, point to: rule 1, and for a filer question all, rule 1 in any case. Then the other cards, then the tables of rule 1 for the cards' sections.
    top: question_id, chunk_id, rank (distinct); chunks: chunk_id, law_code, section; questions: question_id, filer (boolean), named (section ids in
    order)."""
    filer = questions.select("question_id", F.coalesce("filer", F.lit(False)).alias("filer"))
    top = written(top, "top")  # this, the cards held and the cards added are each read several times
    held = written(top.join(small(chunks.filter(F.col("law_code") == CARDS).select("chunk_id", "section")), "chunk_id"), "held-cards")
    first = top.filter(F.col("rank") <= best)
    about = first.join(small(index.sections), "chunk_id").groupBy("question_id", "section").agg(F.min("rank").alias("at"))
    about = about.join(held.select("question_id", "section").distinct(), ["question_id", "section"], "left_anti")
    doubled = index.card_rules.filter("rule = 1").select("chunk_id", F.lit(True).alias("doubles")).distinct()
    cards = about.join(small(index.cards.join(doubled, "chunk_id", "left")), "section").join(filer, "question_id").filter(F.col("filer") | F.col("doubles")).select("question_id", "section", "chunk_id", "at")
    without = filer.filter("filer").select("question_id").join(held.select("question_id"), "question_id", "left_anti").join(cards.select("question_id"), "question_id", "left_anti")
    mark = f"{law_prefix}-s"
    named = questions.select("question_id", F.posexplode("named").alias("at", "sid")).filter(F.startswith("sid", F.lit(mark))).withColumn("section", F.element_at(F.split("sid", "-s"), -1))
    named = named.join(without, "question_id", "left_semi").join(small(index.cards), "section").groupBy("question_id").agg(F.min_by(F.struct("section", "chunk_id"), "at").alias("c")).select("question_id", "c.section", "c.chunk_id", F.lit(0).alias("at"))
    cards = written(cards.unionByName(named).withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))), "added-cards")

    def pointed(rows: DataFrame, hop: int, order: str) -> DataFrame:
        found = rows.join(small(index.card_rules), "chunk_id").join(filer, "question_id").filter(F.col("filer") | (F.col("rule") == 1))
        return found.select("question_id", "rule", F.struct(F.lit(hop).alias("hop"), F.col(order).cast("long").alias("place"), F.col("ord").cast("long").alias("ord")).alias("at"))

    always = filer.filter("filer").select("question_id", F.lit(1).alias("rule"), F.struct(F.lit(0).alias("hop"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("ord")).alias("at"))
    wanted = always.unionByName(pointed(held.filter(F.col("rank") <= best).select("question_id", "chunk_id", "rank"), 1, "rank")).unionByName(pointed(cards, 2, "n"))
    rules = wanted.groupBy("question_id", "rule").agg(F.min("at").alias("at"))
    ordered = rules.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).join(small(index.rules), "rule")
    tables = F.create_map(*[F.lit(x) for pair in RULE_TABLES.items() for x in pair])
    sections = held.select("question_id", "section").unionByName(cards.select("question_id", "section")).distinct()
    own = sections.withColumn("name", tables[F.col("section")]).join(small(index.tables), "name").join(rules.filter("rule = 1").select("question_id"), "question_id", "left_semi")
    parts = [
        cards.select("question_id", "chunk_id", F.when(F.col("n") == 1, 0).otherwise(2).alias("priority"), F.col("n").cast("string").alias("place"), F.col("n").alias("ord")),
        ordered.select("question_id", "chunk_id", F.lit(1).alias("priority"), F.lit("").alias("place"), F.col("n").alias("ord")), own.select("question_id", "chunk_id", F.lit(3).alias("priority"), F.col("section").alias("place"), F.lit(0).alias("ord")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = F.dense_rank().over(Window.partitionBy("question_id", "priority").orderBy("ord", "place"))
    return companions(every.withColumn("ord", order).select("question_id", "chunk_id", "priority", "ord"), top.select("question_id", "chunk_id"), most)
