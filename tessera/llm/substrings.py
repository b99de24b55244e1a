"""Substring deduplication: winnowed anchors as seeds, extended word by word to the maximal repeats over a length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash
from tessera.llm.idfilter import may_hold
from tessera.llm.wordcodes import U, arrow_rows, batched, windows, word_codes

#: Words of an anchor. A window of `least` words holds least - ANCHOR + 1 of them, and its least code is its anchor.
ANCHOR = 12
#: Words of a stretch, the unit in which the words of a holder travel to the documents that repeat them.
STRETCH = 64


def window_anchors(codes: np.ndarray, least: int) -> np.ndarray:
    """The anchor of each window of `least` words: the least code among its runs of ANCHOR words. Equal windows have
    equal anchors, and neighbouring windows mostly share theirs, so a text has few distinct ones."""
    low = windows(codes, min(ANCHOR, least))
    width = least - min(ANCHOR, least) + 1
    if len(low) < width:
        return low[:0]
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if have < width else low


def _coded(held: list[tuple], text_at: int):
    """Each row with its words' codes."""
    codes, at, _ = word_codes([r[text_at] for r in held])
    for j, r in enumerate(held):
        yield r, codes[at[j] : at[j + 1]]


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_SEEDS = "doc_id long, digest binary, n_words long, whole_sha256 string, anchors array<long>"


def _seeds(least: int):
    def run(batches):
        for held in batched(arrow_rows(batches, "doc_id", "text"), 1):
            rows = []
            for (doc, text), codes in _coded(held, 1):
                anchors = np.unique(window_anchors(codes, least))
                rows.append((doc, hashlib.sha256(text).digest(), len(codes), hashlib.sha256(b" ".join(text.split())).hexdigest(), anchors.view(np.int64)))
            yield _batch(rows, _SEEDS)

    return run


def _windows_at_seeds(least: int):
    """Every window of `least` words that a shared seed anchors, as a code and its place."""

    def run(batches):
        for held in batched(arrow_rows(batches, "doc_id", "mark", "seeds", "text"), 3):
            for (doc, mark, seeds, _), codes in _coded(held, 3):
                anchors = window_anchors(codes, least)
                at = np.flatnonzero(np.isin(anchors, np.array(seeds, np.int64).view(U)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(windows(codes, least)[at].view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), mark)), pa.array(at.astype(np.int32))], names=["window", "doc_id", "mark", "place"])

    def gathered(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return gathered


_MATCHES = "doc_id long, mark long, place int, low long, low_mark long, low_place int, length int"


def _matches(batches):
    """A document's places that a holder repeats, joined to runs that go on in the same holder word by word."""
    rows = []
    for doc, mark, hits in arrow_rows(batches, "doc_id", "mark", "hits"):
        found = sorted((h["low"], h["low_mark"], h["place"] - h["low_place"], h["place"]) for h in hits)
        begin = 0
        for i in range(1, len(found) + 1):
            if i < len(found) and found[i][:3] == found[begin][:3] and found[i][3] <= found[i - 1][3] + STRETCH:
                continue
            low, low_mark, shift, place = found[begin]
            rows.append((doc, mark, place, low, low_mark, place - shift, found[i - 1][3] - place))
            begin = i
        if len(rows) >= 5000:
            yield _batch(rows, _MATCHES)
            rows = []
    if rows:
        yield _batch(rows, _MATCHES)


_STRETCHES = "doc_id long, mark long, stretch int, words binary"


def _cut_stretches(batches):
    """The wanted stretches of each holder's words."""
    rows, size = [], 0
    for doc, mark, wanted, text in arrow_rows(batches, "doc_id", "mark", "wanted", "text"):
        words = text.split()
        for s in wanted:
            piece = b" ".join(words[s * STRETCH : (s + 1) * STRETCH])
            rows.append((doc, mark, s, piece))
            size += len(piece) + 40
        if size >= 1_000_000:
            yield _batch(rows, _STRETCHES)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _STRETCHES)


def extend(own: list[bytes], other: list[bytes], place: int, at: int, reach: int) -> Iterator[tuple[int, int]]:
    """The maximal runs (begin, end in `own`) of equal words in the alignment that puts own[place] on other[at], begun
    at each word from `place` up to `reach` words on and extended to the left and to the right as far as words agree."""
    done = place
    while done <= place + reach:
        shift = at - place
        begin = end = done
        while begin > 0 and begin + shift > 0 and own[begin - 1] == other[begin - 1 + shift]:
            begin -= 1
        while end < len(own) and end + shift < len(other) and own[end] == other[end + shift]:
            end += 1
        if end > begin:
            yield begin, end
        done = end + 1


def mark_repeats(words: list[bytes], gone: np.ndarray, match: tuple, held: list[tuple[int, bytes]], least: int) -> None:
    """Mark in `gone` the words of a text that lie in a run of at least `least` words that a holder repeats.

    match: its place in the text, the holder and the place there, and the number of places after it that the run may begin at;
    held: the holder's stretches around it, by number.
    """
    place, _, _, low_place, length = match
    other = [w for _, piece in held for w in piece.split(b" ")]
    for begin, end in extend(words, other, place, low_place - held[0][0] * STRETCH, length):
        if end - begin >= least:
            gone[begin:end] = True


_CUTS = "doc_id long, digest binary, n_removed long, kept_sha256 string"


def _cut(least: int, with_text: bool):
    """Rows in order: a text, then the stretches of its matches, match by match. A text and one match are in memory at a time,
    however many holders a text is put together from."""
    fields = _CUTS + ", kept string" * with_text

    def run(batches):
        rows, size = [], 0
        doc = digest = match = None
        words: list[bytes] = []
        gone, held = np.zeros(0, bool), []

        def matched():
            if held:
                mark_repeats(words, gone, match, held, least)
                held.clear()

        def cut() -> tuple:
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            return (doc, digest, int(gone.sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if with_text else ())

        for kind, doc_id, own, text, place, low, low_mark, low_place, length, stretch, piece in arrow_rows(batches, "kind", "doc_id", "digest", "text", "place", "low", "low_mark", "low_place", "length", "stretch", "words"):
            if kind == 0:
                matched()
                if digest is not None:
                    rows.append(cut())
                    size += 100 + len(rows[-1][-1]) * with_text
                doc, digest, words = doc_id, own, text.split()
                gone = np.zeros(len(words), bool)
                if size >= 1_000_000:
                    yield _batch(rows, fields)
                    rows, size = [], 0
                continue
            now = (place, low, low_mark, low_place, length)
            if now != match:
                matched()
                match = now
            held.append((stretch, piece))
        matched()
        if digest is not None:
            rows.append(cut())
        if rows:
            yield _batch(rows, fields)

    return run, fields


def repeated_passages(docs: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts). documents: doc_id, digest, n_words, whole_sha256, first_id (least doc_id with the same text,
    null for texts of fewer than `least` words). cuts: of the first documents with matches, in partitions and in order, a row (kind 0) with
    digest and text, then rows (kind 1) with the holders' stretches, match by match.

    Seeds: each window's winnowed anchor; an anchor that only one document has is no seed. Each window that a shared
    seed anchors is looked up by the code of its words, which names the least document that holds it, the holder, and
    where; windows that go on in the same holder are one match. Extension: the holder's words around a match travel to
    the document in stretches of STRETCH words, and the match is extended both ways on the words themselves to the
    maximal repeat. A repeat of `least` words has equal anchors in all documents, so none is missed, and no pairs of
    documents are made: a passage that a third of all documents share costs each of them its own windows, and the
    holder sends each stretch into the join once. Texts are known by doc_id and digest, so a doc_id may stand for
    several. Minima are summed up in each task before they are shuffled, and written, so that the joins on an anchor,
    window or stretch are plain inner equi-joins, which adaptive execution splits where a key is hot. Only texts with a
    shared seed leave the scan, but for the false alarms of a Bloom filter of bounded size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seeds = stash(rows.mapInArrow(_seeds(least), _SEEDS), "seeds")
    n = seeds.count()
    own = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    firsts = stash(seeds.filter(F.col("n_words") >= least).groupBy("digest").agg(F.min("doc_id").alias("first_id")).filter("first_id IS NOT NULL"), "firsts", n)
    known = seeds.select("doc_id", "digest", "n_words", "whole_sha256").join(firsts, "digest", "left")

    # the mark tells apart the texts of one doc_id: 0 for one of them, a part of the digest for others
    several = firsts.select(F.col("first_id").alias("doc_id"), "digest", own.alias("mark"))
    least_mark = several.groupBy("doc_id").agg(F.min("mark").alias("least_mark"))
    heads = stash(several.join(least_mark, "doc_id").select("doc_id", "digest", F.when(F.col("mark") == F.col("least_mark"), F.lit(0).cast("long")).otherwise(F.col("mark")).alias("mark")), "heads", n)
    anchors = stash(seeds.select("doc_id", "digest", "anchors").join(heads, ["doc_id", "digest"]).select("doc_id", "mark", F.explode("anchors").alias("anchor")), "anchors", 16 * n)
    shared = stash(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"), "shared", 4 * n)
    marked = anchors.join(shared, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("seeds"))
    marked = stash(marked.join(heads, ["doc_id", "mark"]), "marked", 4 * n)
    some = rows.filter(may_hold(marked.select("doc_id").distinct(), "doc_id")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = stash(some.join(marked.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "mark", "digest", "seeds", "text"), "passages")

    spots = stash(texts.select("doc_id", "mark", "seeds", "text").mapInArrow(_windows_at_seeds(least), "window long, doc_id long, mark long, place int"), "spots")
    holders = spots.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("mark", "doc_id").alias("low_mark"), F.min_by("place", "doc_id").alias("low_place"))
    holders = stash(holders.filter("low < high").drop("high"), "holders", 64 * n)
    hits = spots.join(holders, "window").filter("doc_id > low").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "low", "low_mark", "low_place")).alias("hits"))
    matches = stash(hits.mapInArrow(_matches, _MATCHES), "matches", 16 * n)

    to_ends = F.sequence(F.greatest(F.col("low_place") - 1, F.lit(0)).cast("int"), F.col("low_place") + F.col("length") + least, F.lit(STRETCH))
    stretches = F.array_distinct(F.transform(F.concat(to_ends, F.array(F.col("low_place") + F.col("length") + least)), lambda p: F.floor(p / STRETCH).cast("int")))
    asked = matches.withColumn("stretch", F.explode(stretches))
    wanted = asked.select(F.col("low").alias("doc_id"), F.col("low_mark").alias("mark"), "stretch").distinct().groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("stretch")).alias("wanted"))
    pieces = stash(texts.select("doc_id", "mark", "text").join(wanted, ["doc_id", "mark"]).mapInArrow(_cut_stretches, _STRETCHES), "stretches")
    held = asked.join(pieces.select(F.col("doc_id").alias("low"), F.col("mark").alias("low_mark"), "stretch", "words"), ["low", "low_mark", "stretch"])
    match = ["place", "low", "low_mark", "low_place", "length", "stretch"]
    parts = held.select(F.lit(1).alias("kind"), "doc_id", "mark", *match, "words")
    own_texts = texts.join(matches.select("doc_id", "mark").distinct(), ["doc_id", "mark"]).select(F.lit(0).alias("kind"), "doc_id", "mark", "digest", "text")
    both = own_texts.unionByName(parts, allowMissingColumns=True).repartition("doc_id", "mark")
    cuts = both.sortWithinPartitions("doc_id", "mark", "kind", *match)
    return known, cuts


def drop_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by one blank.

    A word goes if a window of `least` words over it begins in a document with a smaller doc_id, on the input as it
    is. A text equal to that of a smaller doc_id and long enough goes whole; shorter texts stay whole. Null texts have
    no words. Rows without doc_id are not cut, and cut no others. The texts of a repeated doc_id do not cut one another,
    and each is cut by itself where a smaller doc_id repeats it. Ties between holders change nothing, since any of them
    holds the same words. Other columns are not read. Empty tables give empty results.
    """
    known, cuts = repeated_passages(docs, least)
    run, fields = _cut(least, False)
    cut = cuts.mapInArrow(run, fields)
    whole_copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    joined = known.join(cut, ["doc_id", "digest"], "left")
    return joined.select(
        "doc_id", "n_words", F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole_copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
