"""Spelling variants: every word one edit away, found by generating a word's whole neighbourhood and joining it to the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash
from tessera.llm.wordcodes import U, arrow_rows, mix

#: Runs of letters that make words.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Characters of a text that are searched at a time, and distinct words that a task counts before it passes them on.
SLICE, MOST_HELD = 1 << 16, 100_000
#: Bits of the filter for each word, the most bits of one filter (16 MB), and candidates that are tested at a time.
BITS_PER_WORD, MOST_BITS, CANDIDATES = 12, 1 << 27, 1 << 17
#: Words whose neighbourhoods one task generates, about a thousand candidates each.
WORDS_PER_TASK = 10_000
#: Bits of a page of a filter.
PAGE_BITS = 1 << 16
#: Base of the polynomial word hashes: odd, so that powers can be undone.
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


# --- words ----------------------------------------------------------------------------------------------------------


def _slices(text: str) -> Iterator[str]:
    """A text in parts that cut no run."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and RUN.match(text[end]):
            end += 1
        yield text[at:end]
        at = end


def spoilt(doc: str, run: str) -> str:
    """The run as a word of this document: by its hash, one in 97 loses a code point."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(least_length: int):
    def run(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for doc, text in arrow_rows(batches, "doc", "text"):
            name = doc.decode()
            for part in _slices(text.decode()):
                lowered: Counter[str] = Counter()
                for word, n in Counter(RUN.findall(part)).items():
                    lowered[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in lowered.items():
                    if len(word) >= least_length:
                        made = spoilt(name, word)
                        if len(made) >= least_length:
                            held[made] += n
                if len(held) >= MOST_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n of the words of all texts with at least least_length code points and least_n occurrences.

    Tasks count their own words first and pass on sums; a text is searched in slices, so its length is no matter."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counted = texts.mapInArrow(_count(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# --- neighbourhoods -------------------------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, int]:
    return np.array([pow(_BASE, k, 1 << 64) for k in range(n)], U), pow(_BASE, -1, 1 << 64)


def word_hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of one length, given as an array (words, code points)."""
    powers, _ = _powers(words.shape[1])
    return (words.astype(U) * powers).sum(axis=1, dtype=U)


def neighbourhood(words: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """All distinct deletions, replacements and insertions of words of one length: (kind, place, hashes (words, letters),
    which are to be left out because another edit makes the same word).

    Of equal neighbours within a run of one letter, the first deletion and the first insertion are the ones that count. The hash
    of each neighbour comes from the sums before and behind its place, so no word is built."""
    n, length = words.shape
    powers, undo = _powers(length + 2)
    terms = words.astype(U) * powers[:length]
    upto = np.concatenate((np.zeros((n, 1), U), np.cumsum(terms, axis=1, dtype=U)), axis=1)
    total, letters = upto[:, -1:], alphabet.astype(U)
    for i in range(length + 1):
        before, behind = upto[:, i : i + 1], total - upto[:, i : i + 1]
        last = words[:, i - 1 : i] if i else np.zeros((n, 1), words.dtype)
        if i < length:
            rest = total - upto[:, i + 1 : i + 2]
            yield "delete", i, before + rest * U(undo), words[:, i : i + 1] == last
            yield "replace", i, before + rest + letters * powers[i], words[:, i : i + 1] == alphabet
        yield "insert", i, before + behind * U(_BASE) + letters * powers[i], last == alphabet


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Words as arrays of code points, those of one length together."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, own in groups.items():
        yield np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, length)


def _places(hashes: np.ndarray, pages: int) -> Iterator[np.ndarray]:
    """Four places of each hash in a filter of `pages` pages: its upper half tells the page, its other bits the places there."""
    base = (((hashes >> U(32)) * U(pages)) >> U(32)) * U(PAGE_BITS)
    yield base + (hashes & U(PAGE_BITS - 1))
    yield base + ((hashes >> U(16)) & U(PAGE_BITS - 1))
    again = mix(hashes)
    yield base + (again & U(PAGE_BITS - 1))
    yield base + ((again >> U(16)) & U(PAGE_BITS - 1))


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter (pages, bytes of a page) lets through: all must have their first place set,
    and only those are looked at again."""
    flat = bits.reshape(-1)

    def is_set(places: np.ndarray) -> np.ndarray:
        return (flat[places >> U(3)] >> (places & U(7)).astype(np.uint8)) & 1 == 1

    left = np.flatnonzero(is_set(next(_places(hashes, len(bits)))))
    found = np.ones(len(left), bool)
    for places in _places(hashes[left], len(bits)):
        found &= is_set(places)
    return left[found]


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes & U(0xFFFFFFFF)) % U(slices)


def _hashed(pages: int, slices: int):
    """Words to (slice, page, hash)."""

    def run(batches):
        for b in batches:
            for group in _by_length(b.column("word").to_pylist()):
                h = mix(word_hashes(group))
                page = ((h >> U(32)) * U(pages)) >> U(32)
                columns = [pa.array(slice_of(h, slices).astype(np.int32)), pa.array(page.astype(np.int32)), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "page", "hash"])

    return run


def _fill(pages: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for places in _places(b.column("hash").to_numpy().view(U), pages):
                for page in np.unique(places // U(PAGE_BITS)):
                    bits = held.setdefault(int(page), np.zeros(PAGE_BITS // 8, np.uint8))
                    own = places[places // U(PAGE_BITS) == page] % U(PAGE_BITS)
                    np.bitwise_or.at(bits, own >> U(3), (1 << (own & U(7)).astype(np.int64)).astype(np.uint8))
        for page, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["page", "bits"])

    return run


def word_filter(hashed: DataFrame, pages: int) -> np.ndarray:
    """A Bloom filter (pages, bytes of a page) of the column hash. A page is filled in one task; the driver collects the
    pages, at most MOST_BITS in all."""
    out = np.zeros((pages, PAGE_BITS // 8), np.uint8)
    for r in hashed.select("page", "hash").repartition("page").mapInArrow(_fill(pages), "page int, bits binary").collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def edited(word: str, kind: str, at: int, letter: str) -> str:
    """The neighbour itself."""
    return word[:at] + ("" if kind == "delete" else letter) + word[at + (kind != "insert") :]


def _candidates(alphabet: str, filters: Broadcast, own: int, slices: int):
    """Words to (word, candidate): the members of their neighbourhoods that fall in slice `own` and that the filter lets through."""
    codes = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)

    def run(batches):
        bits = filters.value
        for b in batches:
            words, made = [], []
            for group in _by_length(b.column("word").to_pylist()):
                step = max(1, CANDIDATES // max(1, len(codes)))
                for lo in range(0, len(group), step):
                    part = group[lo : lo + step]
                    names = [x.tobytes().decode("utf-32-le") for x in part]
                    for kind, at, hashes, out in neighbourhood(part, codes):
                        keep = np.flatnonzero(~np.broadcast_to(out, hashes.shape).reshape(-1))
                        flat = mix(hashes.reshape(-1)[keep])
                        if slices > 1:
                            here = slice_of(flat, slices) == own
                            keep, flat = keep[here], flat[here]
                        for cell in keep[_passes(flat, bits)]:
                            row, letter = divmod(int(cell), hashes.shape[1])
                            words.append(names[row])
                            made.append(edited(names[row], kind, at, alphabet[letter]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(made, pa.string())], names=["word", "near"])

    return run


def near_words(words: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """word, near: all pairs of words (column word) that differ by one inserted, deleted or replaced code point, both ways.

    Each word's neighbourhood over the observed alphabet is generated in full inside a task and meets the vocabulary in
    an equi-join of texts, so nothing has to be verified. A Bloom filter of the vocabulary keeps candidates that are no words out of the
    shuffle. Where the vocabulary is too large for one filter of most_bits, its words are dealt into slices by their hash, with a filter
    for each; candidates of a slice are tested against that filter alone, so the share of false alarms is the same at any size."""
    spark = words.sparkSession
    n = words.count()
    if not n:
        return spark.createDataFrame([], "word string, near string")
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c <> ''")
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # at most the 116 letters of RUN
    slices = max(1, -(-n * BITS_PER_WORD // most_bits))
    pages = -(-n * BITS_PER_WORD // (slices * PAGE_BITS))
    hashed = words.select("word").mapInArrow(_hashed(pages, slices), "slice int, page int, hash long")
    hashed = stash(hashed, "word-hashes", n) if slices > 1 else hashed
    dealt = words.select("word").repartition(max(16, -(-n // WORDS_PER_TASK)))
    found = None
    for own in range(slices):
        filters = spark.sparkContext.broadcast(word_filter(hashed.filter(F.col("slice") == own), pages))
        part = dealt.mapInArrow(_candidates(alphabet, filters, own, slices), "word string, near string")
        found = part if found is None else found.unionByName(part)
    return found.join(words.select(F.col("word").alias("near")), "near").select("word", "near")


# --- forms ----------------------------------------------------------------------------------------------------------


def follow(links: DataFrame) -> DataFrame:
    """word, root from word, form (null: none): forms followed to the last, each round twice as far.

    A form occurs at least twice as often as its word, so a chain has at most as many steps as its last word's count
    has bits, and rounds are few."""
    state = links.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("open"))
    state = stash(state, "roots")
    while state.filter("open").limit(1).count():
        ends = state.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
        moved = state.join(ends, "root").select("word", F.col("next").alias("root"), (F.col("open") & F.col("more")).alias("open"))
        state = stash(moved, "roots")
    return state.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """Every word of the texts with its form: word, form, root, n, n_near, form_n.

    Words are runs of letters with A-Z lower-cased, after one in 97 (by the hash of document and run) has lost a code point. A word's form is its near word of largest n, the
    smallest of ties, if that has at least `ratio` (2 or more) times its n; the root is where forms lead. Null and empty texts have no words, a null doc_id counts as an empty
    one, repeated rows count each, other columns are not read, texts may have any length; an empty table gives an
    empty result."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, else forms could lead in circles")
    words = stash(vocabulary(docs, least_length, least_n), "vocabulary")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    linked = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    linked = stash(linked.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "forms")
    return linked.join(follow(linked), "word").select("word", "form", "root", "n", "n_near", "form_n")
