"""The structure of a law from its lines: chapters, parts and divisions with resets, tables that go on over pages, grids,
marker spans, schedules and long paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.phrases import token_line
from tessera.functions.text import clean, heading_case, section_key
from tessera.operators.chunking import bracketed, first_tokens, opens_paragraph, section_number
from tessera.operators.ordered import greedy_groups, monotone
from tessera.operators.sizes import joined_as
from tessera.sources.shared import written

#: Lines of a law that one block of a scan holds.
BLOCK = 4096
# The words that open a level, and ordinal words of schedules.
LEVELS = ("chapter", "part", "division")
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split()
#: Texts of titles are shorter than this.
SHORT = 80


def carried(rows: DataFrame, by: list[str], order: str, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Each row with, for every name in `columns`, the last value of its expression that is not null, at or before the row. Rows
    without a group or a place are left out.

    An associative scan: blocks of `block` steps of the order (a whole number that grows) are scanned by themselves and written once; the values
    that they end with, a row a block, are scanned over the group, and only blocks behind a group's first take values from it. So a group with a
    third of all rows is never sorted in one task, and rows are shuffled once."""
    keys = [*by, "__of_scan"]
    inside, before = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*by).orderBy("__of_scan").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.dropna(subset=[*by, order]).select("*", *[c.alias(f"__{n}") for n, c in columns.items()], F.floor(F.col(order) / block).alias("__of_scan"))
    scanned = cut.select(*rows.columns, "__of_scan", *[F.last(f"__{n}", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in columns], F.lead(F.lit(1)).over(inside).isNull().alias("__ends"))
    scanned = written(scanned, "scanned")
    ends = scanned.filter("__ends").select(*keys, *[F.last(n, ignorenulls=True).over(before).alias(f"__c_{n}") for n in columns], F.row_number().over(Window.partitionBy(*by).orderBy("__of_scan")).alias("__nth")).filter(F.col("__nth") > 1)
    joined = scanned.join(joined_as(ends)(ends.drop("__nth")), keys, "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(n, f"__c_{n}").alias(n) for n in columns])


# --- levels ---------------------------------------------------------------------------------------------------------


def _words(text: Column, line: Column | None = None) -> Column:
    """Tokens of a line without brackets. line: its token line, where that is at hand."""
    return F.filter(F.split(F.trim(token_line(text) if line is None else line), " +"), lambda w: ~w.isin("[", "]", ""))


def _level_words(text: Column, line: Column | None = None) -> Column:
    """The tokens that `level_line` reads."""
    return F.filter(_words(text, line), lambda w: ~w.isin("-", "–"))


def level_line(text: Column, words: Column | None = None) -> Column:
    """(level, number, rest) of a line that opens a level: its word, a dash or none, a roman numeral with letters, and, behind a division
    alone, its title. Null for other lines."""
    words = _level_words(text) if words is None else words
    word, number = F.lower(F.get(words, F.lit(0))), F.upper(F.get(words, F.lit(1)))
    letters = F.when(word == "division", F.lit("^[IVXL]+[A-Z]{0,2}$")).otherwise(F.lit("^[IVXL]+[A-Z]?$"))
    rest = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?i)^[\[\s]*division\s+[a-z]+\b(.*)$", 1), r"^[\[\]\s]+|[\[\]\s]+$", ""))
    opens = word.isin(*LEVELS) & F.rlike(number, letters) & ((word == "division") | (F.size(words) == 2))
    return F.when(opens, F.struct(word.alias("level"), number.alias("number"), F.when(word == "division", rest).otherwise("").alias("rest")))


def _read(lines: DataFrame) -> DataFrame:
    """Lines with `first`, their first tokens, and `words`, those that open a level: each line is cut into tokens once."""
    return lines.withColumn("line", token_line(F.col("text"))).withColumn("first", first_tokens(F.col("text"), F.col("line"))).withColumn("words", _level_words(F.col("text"), F.col("line"))).drop("line")


def chapter_pages(pages: DataFrame) -> DataFrame:
    """law, page, chapter, changes: the chapter that a page's running header names, or the one before goes on; `changes` where it is
    another than on the page before. pages: law, page, header."""
    number = _words(F.col("header"))
    named = F.when(F.lower(F.get(number, F.lit(0))) == "chapter", F.trim("header"))
    rows = carried(pages.select("law", "page", named.alias("named")), ["law"], "page", {"chapter": F.col("named")})
    before = F.lag("chapter").over(Window.partitionBy("law").orderBy("page"))  # a row a page
    return rows.select("law", "page", "chapter", (F.col("chapter").isNotNull() & ~F.col("chapter").eqNullSafe(before)).alias("changes"))


def section_levels(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """law, ord, section, chapter, part of every line that opens a section; part is "Part V: Title — Title; Division I: Title", null without
    a part.

    A chapter, be it by a line or by the page header, ends part and division; a part ends the division. Bold centred short lines that follow a
    part or a division, until a section opens, are its titles. lines: law, page, ord, text, bold, centred; pages: law, page,
    header."""
    bold, text = F.col("bold"), F.col("text")
    short = bold & F.col("centred") & (F.length("text") < SHORT)
    # texts are read once; only what they say goes on
    read = _read(lines.select("law", "page", "ord", "text", short.alias("short"), (bold & ~F.col("centred")).alias("beside")))
    said = read.withColumn("level", level_line(text, F.col("words"))).withColumn("number", section_number(text, F.col("first")))
    said = said.withColumn("at", F.when(F.col("short") | F.col("level.level").isin("chapter", "part"), F.col("level")))
    plain = F.col("short") & F.col("at").isNull() & (F.col("number") == "") & ~text.rlike(r"^\s*$") & ~opens_paragraph(text, F.col("first"))
    said = said.select("law", "page", "ord", F.when(F.col("beside") & (F.col("number") != ""), F.col("number")).alias("number"), "at", F.when(plain, heading_case(F.regexp_replace("text", r"^[\[\]\s]+|[\[\]\s]+$", ""))).alias("title"))
    said = written(said, "said")
    dealt = joined_as(said)  # heads, pages and titles are no more than lines, and are written so small that Spark would collect them in the driver
    heads = monotone(said.filter("number IS NOT NULL").select("law", "ord", F.col("number").alias("section")), ["law"], ["ord"], section_key(F.col("section"))).filter("accepted").select("law", "ord", "section")
    first = said.groupBy("law", "page").agg(F.min("ord").alias("page_ord"))
    turned = chapter_pages(pages).join(dealt(first), ["law", "page"])
    # plain lines carry nothing but the change of a chapter by their page
    events = said.join(dealt(turned), ["law", "page"], "left").filter("number IS NOT NULL OR at IS NOT NULL OR title IS NOT NULL OR changes")
    rows = events.join(dealt(heads), ["law", "ord"], "left").drop("number")

    def opened(*levels: str) -> Column:
        return F.when(F.col("at.level").isin(*levels), F.struct("ord", "at.number", "at.rest"))

    kind = F.coalesce("at.level", F.when(F.col("section").isNotNull(), F.lit("section")))
    rows = carried(rows, ["law"], "ord", {
        "by_page": F.when(F.col("changes"), F.col("page_ord") - 1), "by_line": F.when(F.col("at.level") == "chapter", F.col("ord")),
        "in_part": opened("part"), "in_division": opened("division"), "opener": F.when(kind.isNotNull(), F.struct("ord", kind.alias("kind"))),
    })
    reset = F.greatest(F.coalesce("by_page", F.lit(-1)), F.coalesce("by_line", F.lit(-1)))
    rows = rows.withColumn("reset", reset)
    rows = rows.withColumn("in_part", F.when(F.col("in_part.ord") > F.col("reset"), F.col("in_part")))
    rows = rows.withColumn("in_division", F.when(F.col("in_division.ord") > F.greatest("reset", F.coalesce("in_part.ord", F.lit(-1))), F.col("in_division")))
    collecting = F.col("opener.kind").isin("part", "division") & (F.col("opener.ord") > F.col("reset"))
    titles = rows.filter(F.col("title").isNotNull() & collecting).groupBy("law", F.col("opener.ord").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda t: t["title"]).alias("titles"))
    found = rows.filter("section IS NOT NULL").select("law", "ord", "section", "chapter", "in_part", "in_division")
    for name in ("part", "division"):
        own = titles.select("law", F.col("owner").alias(f"{name}_ord"), F.col("titles").alias(f"{name}_titles"))
        found = found.withColumn(f"{name}_ord", F.col(f"in_{name}.ord")).join(dealt(own), ["law", f"{name}_ord"], "left")

    def label(word: str, name: str) -> Column:
        rest = F.when(F.col(f"in_{name}.rest") != "", F.array(heading_case(F.col(f"in_{name}.rest")))).otherwise(F.array().cast("array<string>"))
        every = F.concat(rest, F.coalesce(f"{name}_titles", F.array().cast("array<string>")))
        return F.concat(F.lit(f"{word} "), F.col(f"in_{name}.number"), F.when(F.size(every) > 0, F.concat(F.lit(": "), F.array_join(every, " — "))).otherwise(""))

    part = F.when(F.col("in_part").isNotNull(), F.concat(label("Part", "part"), F.when(F.col("in_division").isNotNull(), F.concat(F.lit("; "), label("Division", "division"))).otherwise("")))
    return found.select("law", "ord", "section", "chapter", part.alias("part"))


# --- paragraphs and tables --------------------------------------------------------------------------------------------


def paragraphs_and_tables(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, para, is_table, text, page, page_end: lines joined to paragraphs, and table pieces to tables.

    A table piece goes on with the table right before it if it stands on the next page; its first line is dropped if
    it repeats the table's first line, and its rule always. Text begins a paragraph after a table and at an enumerator or proviso. A line that
    ends in a hyphen before a small letter is joined without a blank. lines: by, ord, page, kind (text or table), text."""
    within = Window.partitionBy(*by).orderBy("ord")
    is_table, before = F.col("kind") == "table", F.lag("kind").over(within) == "table"
    goes_on = F.when(is_table, before & (F.col("page") == F.lag("page").over(within) + 1)).otherwise(~before & ~opens_paragraph(F.col("text")))
    rows = lines.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("para", F.sum("begins").over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    joined = rows.groupBy(*by, "para").agg(parts.alias("p"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.first(is_table).alias("is_table"))

    def add(acc: Column, x: Column) -> Column:
        return F.when(acc == "", x["text"]).when(acc.rlike("-$") & x["text"].rlike("^[a-z]"), F.concat(acc, x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"]))

    def rows_of(p: Column, i: Column) -> Column:
        own, first = F.split(p["text"], "\n"), F.get(F.split(F.get("p", F.lit(0))["text"], "\n"), F.lit(0))
        rest = F.slice(own, 3, F.size(own))
        return F.when(i == 0, own).when(F.get(own, F.lit(0)) == first, rest).otherwise(F.concat(F.slice(own, 1, 1), rest))

    table = F.array_join(F.flatten(F.transform("p", rows_of)), "\n")
    text = F.when(F.col("is_table"), table).otherwise(clean(F.aggregate("p", F.lit(""), add)))
    return joined.select(*by, "para", "is_table", text.alias("text"), "page", "page_end").filter("text <> ''")


def sentence_pieces(paras: DataFrame, by: list[str], text: str, limit: int) -> DataFrame:
    """by, piece, text: long texts packed by sentence (ends of `.`, `:` or `;`) into pieces of at most `limit` estimated tokens, blanks between the
    sentences counted; a longer sentence is a piece of its own."""
    parts = F.filter(F.split(F.trim(text), r"(?<=[.:;])\s+"), lambda s: s != "")
    sizes = F.transform("parts", lambda s: F.length(s).cast("long") + 1)  # a sentence and the blank before it
    each = paras.withColumn("parts", parts).select(*by, F.posexplode(F.arrays_zip(F.col("parts").alias("s"), greedy_groups(sizes, 4 * limit + 1).alias("piece"))).alias("at", "x"))
    return each.groupBy(*by, F.col("x.piece").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("x.s").alias("s")))), lambda p: p["s"]), " ").alias("text"))


def continued_title(unit: str, section: Column, title: Column) -> Column:
    """The title line that the later pieces of a section repeat."""
    return F.concat(F.lit(f"{unit} "), section, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(". "), title)).otherwise(""), F.lit(" (continued)"))


def with_titles(pieces: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Pieces (by, section, title, piece from 0, text), each after the first headed by its section's title."""
    head = continued_title(unit, F.col("section"), F.col("title"))
    return pieces.withColumn("text", F.when(F.col("piece") > 0, F.concat(head, F.lit("\n"), "text")).otherwise(F.col("text")))


# --- grids ----------------------------------------------------------------------------------------------------------


def without_markers(cell: Column) -> Column:
    """A cell without the footnote digits that stand right before a bracket: one to three digits after the start or a character
    that is no letter, digit, point or comma."""
    return F.regexp_replace(cell, r"(^|[^\p{L}\p{N}_.,])[0-9]{1,3}(?=\[)", "$1")


def grid_tables(rows: DataFrame, grid: str, order: str, cells: str, long: int = 60) -> DataFrame:
    """grid, n (from 1), caption, rows: the tables of a grid of cells.

    Cells lose markers and line breaks, rows their empty cells. One long cell alone is a caption; it ends a
    table, and so does a row that repeats the table's first row, with which the next one begins. What has fewer than two rows or is one cell wide is
    no table but a caption too. A table's caption is all of these since the table before."""
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(without_markers(F.coalesce(c, F.lit(""))), "[-]", ""), r"[\s ]+", " ")))
    kept = rows.select(grid, order, F.filter(plain, lambda c: c != "").alias("cells")).filter(F.size("cells") > 0)
    inside = Window.partitionBy(grid).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("is_caption", (F.size("cells") == 1) & (F.length(F.get("cells", F.lit(0))) > long))
    kept = kept.withColumn("run", F.sum(F.col("is_caption").cast("int")).over(inside))
    body = Window.partitionBy(grid, "run", "is_caption").orderBy(order)
    kept = kept.withColumn("header", F.first("cells").over(body)).withColumn("part", F.sum((F.col("cells") == F.col("header")).cast("int")).over(body.rowsBetween(Window.unboundedPreceding, 0)))
    lists = kept.groupBy(grid, "run", "is_caption", "part").agg(F.min(order).alias("at"), F.transform(F.array_sort(F.collect_list(F.struct(order, "cells"))), lambda r: r["cells"]).alias("rows"))
    real = ~F.col("is_caption") & (F.size("rows") > 1) & (F.array_max(F.transform("rows", lambda r: F.size(r))) > 1)
    lists = lists.withColumn("real", real)
    before = Window.partitionBy(grid).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lists = lists.withColumn("n", F.coalesce(F.sum(F.col("real").cast("int")).over(before), F.lit(0)) + 1)
    # a table is the last of its number, behind all that is its caption
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("real"), F.struct("at", F.array_join(F.flatten("rows"), " ").alias("t"))))), lambda c: c["t"]), " ")
    tables = lists.groupBy(grid, "n").agg(F.nullif(words, F.lit("")).alias("caption"), F.get(F.collect_list(F.when(F.col("real"), F.col("rows"))), F.lit(0)).alias("rows"))
    return tables.filter("rows IS NOT NULL").select(grid, F.col("n").cast("int").alias("n"), "caption", "rows")


# --- spans ----------------------------------------------------------------------------------------------------------


def marker_spans(spans: DataFrame, line: list[str], ratio: float = 0.9, gap: float = 1.5) -> DataFrame:
    """line, text, fn_refs, footnote_start, bold_start: spans of a line read from left to right, footnote markers apart.

    A marker is one to three digits or a star, at most `ratio` times the line's dominant size, the one that most
    characters have (of ties the leftmost). Words more than `gap` apart get a blank. A line starts a footnote if a marker comes before all
    text and no opening bracket follows; it is bold if its first span with a letter or digit is. spans: line, x0, x1, size, bold, text."""
    rows = spans.filter(F.trim("text") != "").withColumn("size", F.round("size", 1))
    weights = rows.groupBy(*line, "size").agg(F.sum(F.length(F.trim("text"))).alias("w"), F.min("x0").alias("left"))
    dominant = weights.groupBy(*line).agg(F.max_by("size", F.struct("w", -F.col("left"))).alias("dominant"))
    rows = rows.join(dominant, line).withColumn("marker", F.trim("text").rlike(r"^([0-9]{1,3}|\*)$") & (F.col("size") <= F.col("dominant") * ratio))
    across = Window.partitionBy(*line).orderBy("x0", "x1")
    seen = F.max(~F.col("marker")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    following = F.ltrim(F.coalesce(F.lead("text").over(across), F.lit("")))
    rows = rows.withColumn("starts_note", F.col("marker") & ~F.coalesce(seen, F.lit(False)) & ~F.startswith(following, F.lit("[")))
    apart = F.coalesce(F.col("x0") - F.lag("x1").over(across) > gap, F.lit(False))
    rows = rows.withColumn("part", F.when(F.col("marker"), F.lit("")).otherwise(F.concat(F.when(apart & F.coalesce(seen, F.lit(False)), " ").otherwise(""), F.col("text"))))
    alnum = F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.col("marker")

    def in_order(value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("x0", "x1", value.alias("v"))))), lambda s: s["v"])

    return rows.groupBy(*line).agg(
        clean(F.array_join(in_order(F.col("part")), "")).alias("text"), in_order(F.when(F.col("marker"), F.trim("text"))).alias("fn_refs"), F.max("starts_note").alias("footnote_start"),
        F.coalesce(F.min_by("bold", F.when(alnum, F.struct("x0", "x1"))), F.lit(False)).alias("bold_start"),
    )


def marker_owners(spans: DataFrame, line: list[str], ratio: float = 0.9) -> DataFrame:
    """line, marker, x0, owner: each marker with the text of the nearest text span to its left on the line, null at its start: an as-of join in x
    by one scan of the line."""
    rows = spans.filter(F.trim("text") != "").withColumn("size", F.round("size", 1))
    weights = rows.groupBy(*line, "size").agg(F.sum(F.length(F.trim("text"))).alias("w"), F.min("x0").alias("left"))
    dominant = weights.groupBy(*line).agg(F.max_by("size", F.struct("w", -F.col("left"))).alias("dominant"))
    rows = rows.join(dominant, line).withColumn("marker", F.trim("text").rlike(r"^([0-9]{1,3}|\*)$") & (F.col("size") <= F.col("dominant") * ratio))
    left = Window.partitionBy(*line).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("owner", F.last(F.when(~F.col("marker"), F.trim("text")), ignorenulls=True).over(left))
    return rows.filter("marker").select(*line, F.trim("text").alias("marker"), "x0", "owner")


def page_headers(lines: DataFrame, page: list[str], top: float, least_size: float) -> DataFrame:
    """page, header: the running header, the lines of running size that stand above `top`, joined from the top. lines: page, y, size,
    text."""
    kept = lines.filter((F.col("y") < top) & (F.col("size") >= least_size))
    words = F.transform(F.array_sort(F.collect_list(F.struct("y", F.trim(F.replace(clean(F.col("text")), F.lit("_"), F.lit(""))).alias("t")))), lambda p: p["t"])
    return kept.groupBy(*page).agg(F.array_join(words, " ").alias("header"))


# --- schedules ------------------------------------------------------------------------------------------------------


def schedule_of(header: Column, words: Column | None = None) -> Column:
    """(name, n, part) of a page header that names a schedule: an ordinal word, "schedule", and maybe a part with a roman numeral; null
    for others, and for an ordinal that is not known."""
    words = F.transform(_words(header), lambda w: F.lower(w)) if words is None else words
    n = F.array_position(F.array(*map(F.lit, ORDINALS)), F.get(words, F.lit(0)))
    at = F.array_position(words, F.lit("part"))
    behind = F.filter(F.slice(words, F.when(at > 0, at + 1).otherwise(1), F.size(words)), lambda w: ~w.isin("-", "–"))
    number = F.when(at > 0, F.upper(F.get(behind, F.lit(0))))
    part = F.when(number.rlike("^[IVXL]+[A-Z]?$"), F.concat(F.lit("Part "), number))
    return F.when((F.get(words, F.lit(1)) == "schedule") & (n > 0), F.struct(F.initcap(F.concat_ws(" ", F.get(words, F.lit(0)), F.lit("schedule"))).alias("name"), n.cast("int").alias("n"), part.alias("part")))


def schedule_units(lines: DataFrame, pages: DataFrame, prefix: str) -> DataFrame:
    """law, ord, unit, title, kind of every line that stands on a schedule's page: its schedule, part and division, and in the second schedule its
    clause.

    A part goes on over pages whose header names none; another schedule or part begins a unit, a bold centred division line too, and in the second
    schedule a bold line that begins with a clause number that goes up. pages: law, page, header; lines: law, page, ord, text, bold,
    centred."""
    named = pages.withColumn("words", F.transform(_words(F.col("header")), lambda w: F.lower(w))).select("law", "page", schedule_of(F.col("header"), F.col("words")).alias("s"))
    named = written(named, "named").filter("s IS NOT NULL").select("law", "page", "s.name", "s.n", "s.part")
    by_page = Window.partitionBy("law").orderBy("page")  # a row a page of schedules
    runs = named.withColumn("change", F.when(F.lag("n").over(by_page).eqNullSafe(F.col("n")), 0).otherwise(1)).withColumn("run", F.sum("change").over(by_page))
    filled = runs.withColumn("part", F.last("part", ignorenulls=True).over(Window.partitionBy("law", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    filled = filled.withColumn("fresh", F.when((F.col("change") == 1) | ~F.lag("part").over(by_page).eqNullSafe(F.col("part")), F.col("page"))).drop("change", "run")
    # texts are read once; only what they say goes on
    number = bracketed(F.col("text"), "number", first=F.col("first"))
    said = _read(lines.withColumn("text", F.when(F.col("bold"), F.col("text")))).select("law", "page", "ord", F.when(F.col("bold") & F.col("centred"), level_line(F.col("text"), F.col("words"))).alias("level"), F.when(F.col("bold") & ~F.col("centred"), F.nullif(number, F.lit(""))).alias("clause"))
    said = written(said.select("law", "page", "ord", F.when(F.col("level.level") == "division", F.col("level.number")).alias("named"), "clause"), "said")
    first = said.groupBy("law", "page").agg(F.min("ord").alias("page_ord"))
    dealt = joined_as(said)
    rows = said.join(dealt(filled.join(dealt(first), ["law", "page"])), ["law", "page"]).withColumn("clause", F.when(F.col("n") == 2, F.col("clause")))
    rows = carried(rows, ["law"], "ord", {"block": F.when(F.col("fresh").isNotNull(), F.col("page_ord"))})
    heads = monotone(rows.filter("clause IS NOT NULL").select("law", "block", "ord", F.col("clause").alias("head")), ["law", "block"], ["ord"], section_key(F.col("head"))).filter("accepted").select("law", "ord", "head")
    other = ~F.lag("named").over(Window.partitionBy("law", "block").orderBy("ord")).eqNullSafe(F.col("named"))
    divisions = rows.filter("named IS NOT NULL").select("law", "ord", "named", other.alias("other")).filter("other").select("law", "ord", F.col("named").alias("begins"))
    # what begins at a line comes right before the line in the scan
    begins = heads.unionByName(divisions, allowMissingColumns=True).withColumn("place", F.col("ord") * 2)
    rows = rows.select("law", "ord", "name", "n", "part", "block", F.lit(True).alias("line"), (F.col("ord") * 2 + 1).alias("place")).unionByName(begins, allowMissingColumns=True)
    rows = carried(rows, ["law"], "place", {n: F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("value"))) for n, c in (("in_clause", "head"), ("in_division", "begins"))}, 2 * BLOCK).filter("line")
    rows = rows.withColumn("division", F.when(F.col("in_division.ord") >= F.col("block"), F.col("in_division.value")))
    begun = F.greatest("block", F.coalesce("in_division.ord", F.lit(-1)))
    rows = rows.withColumn("in_clause", F.when(F.col("in_clause.ord") >= begun, F.col("in_clause.value")))
    code = F.regexp_extract("part", " (.*)$", 1)
    whole = F.concat(F.lit(f"{prefix}-sch"), F.col("n"), F.when(F.col("part").isNotNull(), F.concat(F.lit("-p"), code)).otherwise(""), F.when(F.col("division").isNotNull(), F.concat(F.lit("-div"), "division")).otherwise(""))
    title = F.concat("name", F.when(F.col("part").isNotNull(), F.concat(F.lit(", "), "part")).otherwise(""), F.when(F.col("division").isNotNull(), F.concat(F.lit(", Division "), "division")).otherwise(""))
    clause = F.concat(F.lit(f"{prefix}-sch2-p"), F.when(F.col("part").isNotNull(), code).otherwise("I"), F.lit("-cl"), "in_clause")
    titled = F.concat("name", F.lit(", "), F.coalesce("part", F.lit("Part I")), F.lit(", clause ("), "in_clause", F.lit(")"))
    is_clause = F.col("in_clause").isNotNull()
    return rows.select("law", "ord", F.when(is_clause, clause).otherwise(whole).alias("unit"), F.when(is_clause, titled).otherwise(title).alias("title"), F.when(is_clause, F.lit("schedule_clause")).otherwise(F.lit("schedule_part")).alias("kind"))
