"""Terms in texts: one automaton of all spellings, one pass over a text; very many plain phrases by a join."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sizes import small
from tessera.sources.shared import written

#: Spellings of one automaton. Beyond them, terms whose spellings are all plain phrases are found by a join; the others are dealt into parts, each with
#: an automaton and a pass of its own, so that what is broadcast and what a worker holds is bounded at any number of terms.
SPELLINGS = 200_000
#: Words of small Latin letters with a blank between, and how many of them a joined phrase has at most.
PLAIN, PLAIN_WORDS = "^[a-z]+( [a-z]+)*$", 8
#: Bits of a spelling in a table of spellings, and how many phrases a text sends to the join beyond those that are wanted.
PROBES, SPARE = 6, 8
#: Letters that may follow a spelling of at least so many characters.
SUFFIX, LEAST = 3, 5
#: Ranges of Arabic script: a spelling in it begins where no such letter stands before.
ARABIC = (("؀", "ۿ"), ("ݐ", "ݿ"), ("ﭐ", "﷿"), ("ﹰ", "﻿"))

_automata: dict = {}


def _letter(c: str) -> bool:
    return "a" <= c <= "z"


def _arabic(c: str) -> bool:
    return any(lo <= c <= hi for lo, hi in ARABIC)


def _automaton(shared, name: str):
    """The automaton of a broadcast list of (ord, place of the spelling in its term, Arabic or not, spelling); a worker keeps the last one."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        made, terms = ahocorasick.Automaton(), {}
        for ord_, place, arabic, spelling in shared.value:
            terms.setdefault(spelling, []).append((ord_, place, arabic))
        for spelling, owners in terms.items():
            made.add_word(spelling, (len(spelling), _letter(spelling[-1]), owners))
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def occurrences(automaton, text: str) -> Iterator[tuple[int, int, bool, int, int]]:
    """(ord, place, Arabic or not, begin, end) of every spelling in a lower-cased text that stands by itself.

    A spelling in Latin letters has no letter before it and none behind it, but one of LEAST characters or more that
    ends in a letter may be followed by up to SUFFIX letters, which count as its own. One in Arabic script has no letter of that script before it."""
    if not len(automaton):
        return
    for last, (length, in_letter, owners) in automaton.iter(text):
        begin, end = last - length + 1, last + 1
        before = text[begin - 1] if begin else " "
        for ord_, place, arabic in owners:
            if arabic:
                if not _arabic(before):
                    yield ord_, place, True, begin, end
                continue
            if _letter(before):
                continue
            stop = end
            while stop < len(text) and stop - end <= SUFFIX and _letter(text[stop]):
                stop += 1
            if stop == end or length >= LEAST and in_letter and stop - end <= SUFFIX:
                yield ord_, place, False, begin, stop


def first_terms(automaton, text: str) -> dict[int, str]:
    """The term of each matching row: the leftmost Latin occurrence, of several at one place the spelling that its row names first; without
    any, the Arabic spelling that is named first."""
    latin: dict[int, tuple] = {}
    other: dict[int, tuple] = {}
    for ord_, place, arabic, begin, end in occurrences(automaton, text):
        best, rank = (other, (place, begin, end)) if arabic else (latin, (begin, place, end))
        if ord_ not in best or rank < best[ord_]:
            best[ord_] = rank
    found = {o: text[begin:end] for o, (_, begin, end) in other.items()}
    return found | {o: text[begin:end] for o, (begin, _, end) in latin.items()}


def _search(shared, most: int):
    name = uuid.uuid4().hex

    def run(batches):
        automaton = _automaton(shared, name)
        for b in batches:
            keys, ords, terms = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if text:
                    found = sorted(first_terms(automaton, text).items(), key=lambda x: (-len(x[1]), x[0]))[:most]
                    keys += [i] * len(found)
                    ords += [o for o, _ in found]
                    terms += [t for _, t in found]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keys, pa.int64())), pa.array(ords, pa.int64()), pa.array(terms, pa.string())], names=["key", "ord", "term"])

    return run


def _marked(rows: DataFrame, n: int, bits_each: int = 24, most_bits: int = 1 << 29) -> bytes:
    """PROBES bits for each spelling, by its CRC and that of its letters backwards, in a table of at most `most_bits` (64 MB): what lacks one is no
    spelling, and need not be shuffled. A fuller table lets more through to the exact join, which decides."""
    size = min(most_bits, max(1 << 15, 1 << (n * bits_each).bit_length()))
    crc, step = F.crc32(F.col("spelling").cast("binary")), F.crc32(F.reverse("spelling").cast("binary")).bitwiseOR(1)
    at = F.col("at") + 1  # buckets of Spark's bitmaps count from 1
    table, bits = bytearray(size // 8), rows.select(F.explode(F.array(*[(crc + step * i) % size for i in range(PROBES)])).alias("at"))
    for r in bits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
        table[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = r["bits"]
    return bytes(table)


def _passes(table: bytes):
    """Whether a phrase has all its bits in a table of `_marked`, and the share of other phrases that will have them by chance."""
    last, crc32 = len(table) * 8 - 1, zlib.crc32

    def passes(phrase: str) -> bool:
        letters = phrase.encode()
        h = crc32(letters)
        if not table[(h & last) >> 3] >> (h & 7) & 1:
            return False
        step = crc32(letters[::-1]) | 1
        for _ in range(PROBES - 1):
            h += step
            if not table[(h & last) >> 3] >> (h & 7) & 1:
                return False
        return True

    return passes, (int.from_bytes(table, "little").bit_count() / (last + 1)) ** PROBES


def _phrases(widths: list[int], single, several, longest: int):
    """For a batch of texts every run of so many plain words, whole and without up to SUFFIX letters of its end: key, spelling, begin, ending (the letters
    that the text has beyond the spelling), least. Each spelling once a text, where it stands first.

    single, several: tables of the spellings of terms with one spelling and of the others. Unless a text is to be sent whole, of the first kind only the
    `longest` longest phrases go on, twice as many more as will pass by chance, and those as long as the last of them; then `least` is that length, else 0."""
    word = re.compile("[a-z]+")

    def run(batches):
        (alone, chance), (others, _) = (_passes(t.value) if t else (None, 0) for t in (single, several))
        for b in batches:
            texts, whole = b.column("text").to_pylist(), b.column("whole").to_pylist()
            for lo in range(0, len(texts), 256):
                rows, spellings, begins, endings, leasts = [], [], [], [], []
                for i, text in enumerate(texts[lo:lo + 256], lo):
                    spans, first = [m.span() for m in word.finditer(text or "")], {}
                    for at, (begin, _) in enumerate(spans):
                        for n in range(1, widths[-1] + 1):
                            if at + n > len(spans) or n > 1 and text[spans[at + n - 2][1]:spans[at + n - 1][0]] != " ":
                                break
                            if n in widths:
                                start, end = spans[at + n - 1]
                                term = text[begin:end]
                                first.setdefault(term, (begin, ""))
                                for cut in range(1, min(SUFFIX, end - start - 1, end - begin - LEAST) + 1):
                                    first.setdefault(term[:-cut], (begin, term[-cut:]))
                    kept = {k for k in first if others(k)} if others else set()
                    sizes, least = {k: len(k) + len(v[1]) for k, v in first.items() if k not in kept and alone(k)} if alone else {}, 0
                    most = longest + int(2 * chance * len(first))
                    if len(sizes) > most and not whole[i]:
                        least = sorted(sizes.values(), reverse=True)[most - 1]
                    sent = [k for k in first if k in kept or sizes.get(k, -1) >= least]
                    if len(sent) == len(kept) + len(sizes):
                        least = 0  # nothing was held back
                    rows += [i] * len(sent)
                    leasts += [least] * len(sent)
                    spellings += sent
                    begins += [first[k][0] for k in sent]
                    endings += [first[k][1] for k in sent]
                arrays = [b.column("key").take(pa.array(rows, pa.int64())), pa.array(spellings, pa.string()), pa.array(begins, pa.int32()), pa.array(endings, pa.string()), pa.array(leasts, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "spelling", "begin", "ending", "least"])

    return run


def _by_join(asked: DataFrame, rows: DataFrame, widths: list[int], n: int, most: int) -> DataFrame:
    """key, ord, term by an equi-join of the texts' phrases with plain spellings: a text is read once and each of its phrases meets the spellings equal
    to it, so the work grows with the texts and not with texts times terms. Of each key at least the `most` first by length and ord are there.

    A term with one spelling stands in a text as one phrase, so that a text sends its longest phrases alone, some more than are wanted, since a few may be
    no spellings. Where too few of them are, the text is looked through again and sends all, as do texts that share their key."""
    spark, kind = asked.sparkSession, asked.schema["key"].dataType.simpleString()
    kinds = {r["several"] for r in rows.select("several").distinct().collect()}
    single, several = (spark.sparkContext.broadcast(_marked(rows.filter(F.col("several") == x), n)) if x in kinds else None for x in (False, True))
    shared = asked.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    asked = asked.join(small(shared), F.col("key").eqNullSafe(F.col("__key")), "left").select("key", "text", F.col("__n").isNotNull().alias("whole")) if shared.take(1) else asked.withColumn("whole", F.lit(False))

    def met(texts: DataFrame, how: str) -> DataFrame:
        said = texts.mapInArrow(_phrases(widths, single, several, most + SPARE), f"key {kind}, spelling string, begin int, ending string, least int")
        pairs = said.join(rows.select("ord", "place", "spelling").hint("shuffle_hash"), "spelling", how)
        pairs = pairs.select("key", "ord", F.concat("spelling", "ending").alias("term"), "begin", "place", "least")
        # dealt by text, as the ranks are: the rows of a text are then grouped and ranked without another shuffle
        return pairs.repartition("key").groupBy("key", "ord").agg(F.min_by("term", F.struct("begin", "place", F.length("term"))).alias("term"), F.max("least").alias("least"))

    # phrases that are no spelling stay until the ranks, so that a text with nothing else is not lost
    of_text, real = Window.partitionBy("key"), F.col("ord").isNotNull()
    ranked = met(asked, "left").select("key", "ord", "term", F.row_number().over(of_text.orderBy(F.col("ord").isNull(), F.desc(F.length("term")), "ord")).alias("nth"), F.max("least").over(of_text).alias("least"),
        F.count(F.when(real & (F.length("term") >= F.col("least")), 1)).over(of_text).alias("enough"))
    ranked = ranked.withColumn("again", (F.col("least") > 0) & (F.col("enough") < most))
    ranked = written(ranked.filter(F.when(F.col("again"), F.col("nth") == 1).otherwise(real & (F.col("nth") <= most))).select("key", "ord", "term", "again"), "longest")
    found, again = ranked.filter("NOT again").select("key", "ord", "term"), ranked.filter("again").select(F.col("key").alias("__key"))
    if again.take(1):
        texts = asked.join(small(again), F.col("key").eqNullSafe(F.col("__key")), "left_semi").withColumn("whole", F.lit(True))
        found = found.unionByName(met(texts, "inner").select("key", "ord", "term"))
    return found


def terms_in(texts: DataFrame, key: str, terms: DataFrame, most: int) -> DataFrame:
    """key, ord, term, rank: for each text the rows of `terms` whose spelling it holds, longest first, `most` at
    most. terms: ord (distinct whole numbers), roman and urdu (lists of spellings; null or empty: none).

    All spellings are searched for at once. A term's text is what stands in the text, lower-cased. A null or empty text, or an empty spelling,
    matches nothing."""
    several = F.coalesce(F.array_size("roman"), F.lit(0)) + F.coalesce(F.array_size("urdu"), F.lit(0)) > 1

    def spelled(column: str, arabic: bool) -> DataFrame:
        return terms.select(F.col("ord").cast("long").alias("ord"), several.alias("several"), F.posexplode(column).alias("place", "spelling")).select("ord", "several", "place", F.lit(arabic).alias("arabic"), "spelling")

    spark = texts.sparkSession
    rows = spelled("roman", False).unionByName(spelled("urdu", True)).filter("spelling <> ''")
    asked = texts.select(F.col(key).alias("key"), F.lower("text").alias("text"))
    kind = asked.schema["key"].dataType.simpleString()
    found, n = None, rows.count()
    if n > SPELLINGS:
        width = F.size(F.split("spelling", " "))
        rows = rows.withColumn("width", F.when(~F.col("arabic") & F.col("spelling").rlike(PLAIN) & (width <= PLAIN_WORDS), width))
        rows = written(rows.join(rows.filter("width IS NULL").select("ord").distinct().withColumn("other", F.lit(True)), "ord", "left"), "spellings")
        plain = rows.filter("other IS NULL")
        if widths := sorted(r["width"] for r in plain.select("width").distinct().collect()):
            found = _by_join(asked, plain, widths, n, most)
        rows = rows.filter("other").select("ord", "place", "arabic", "spelling")
        n = rows.count()
    for part in range(parts := -(-n // SPELLINGS) if found is not None or n else 1):
        own = rows.filter(F.pmod(F.xxhash64("ord"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.select("ord", "place", "arabic", "spelling").collect()])
        one = asked.mapInArrow(_search(shared, most), f"key {kind}, ord long, term string")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.length("term")), "ord"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).withColumnRenamed("key", key)
