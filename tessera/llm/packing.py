"""Packing documents into sequences: length patterns fitted by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, gapless_rank, stash
from tessera.llm.wordcodes import arrow_rows

#: Bytes of chunks and of words, with their token ids, that a Python worker remembers; beyond it the memory starts anew.
CACHE_BYTES = 40_000_000
#: What an entry takes besides its bytes, about.
ENTRY_BYTES = 180


# --- tokens ---------------------------------------------------------------------------------------------------------


#: Texts of these characters alone are cut into words here as the tokenizer cuts them.
_PLAIN = re.compile(rb"[\x20-\x7e\x09-\x0d]*(?:(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[\x20-\x7e\x09-\x0d]*)*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

# The normalisation, word cutting and model of the tokenizers that _PLAIN and _WORDS follow.
_CUT_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def cut_at_space(declared: dict) -> bool:
    """Whether a tokenizer, by what its file declares, drops white space and never joins across it, in the way that
    ChunkEncoder follows; its special tokens then hold `<|` and no white space."""
    model = declared.get("model", {})
    special = [t["content"] for t in declared.get("added_tokens", [])]
    return (
        all(declared.get(k) == v for k, v in _CUT_AT_SPACE.items()) and model.get("type") == "BPE" and not model.get("dropout")
        and all("<|" in t and not any(c.isspace() for c in t) for t in special)
    )


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a printable byte as itself and the others as the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words, found by the tokenizer's model the first time."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters, self.size = model.tokenize, _byte_letters(), 0

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelled)])
        self.size += ENTRY_BYTES + len(word) + len(ids)
        return ids


class ChunkEncoder(dict):
    """Token ids of texts, as little-endian 32-bit numbers.

    Where the tokenizer drops white space and never joins across it (cut_at_space), a text's ids are the joined ids of
    its chunks between ASCII white space. Text of plain Latin letters, digits and punctuation is lowered and cut into
    words here, and each word is encoded by the tokenizer's model; any other chunk, and any that may hold a special
    token, is encoded by the whole tokenizer. Words, and such chunks, that occur again are remembered, CACHE_BYTES of
    each at most. With any other tokenizer whole texts go through it.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.by_chunk = cut_at_space(json.load(f))
        self.words, self.size = _Words(self.whole.model), 0

    def _encode(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self._encode(chunk)
        self.size += ENTRY_BYTES + len(chunk) + len(ids)
        return ids

    def _plain(self, text: bytes) -> bytes | None:
        """The ids of a text of plain characters; None for any other."""
        if b"<|" in text or not _PLAIN.fullmatch(text):
            return None
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text.decode().lower())))

    def encode(self, text: bytes) -> bytes:
        if not self.by_chunk:
            return self._encode(text)
        for memory in (self, self.words):
            if memory.size > CACHE_BYTES:
                memory.clear()
                memory.size = 0
        ids = self._plain(text)
        if ids is not None:
            return ids
        parts = []
        for chunk in text.split():
            own = self._plain(chunk)
            parts.append(self[chunk] if own is None else own)
        return b"".join(parts)


def _pieces_of(tokenizer_path: str, max_len: int, end_id: int):
    """Arrow batches of (doc_id, text) to one row a piece."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ChunkEncoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * max_len
        out: list[tuple] = []

        def flush():
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            out.clear()
            return batch

        for doc, text in arrow_rows(batches, "doc_id", "text"):
            ids = encoder.encode(text) + end
            for piece, at in enumerate(range(0, len(ids), step)):
                own = ids[at : at + step]
                out.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            if len(out) >= 5000:
                yield flush()
        if out:
            yield flush()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text (null: none) and `end_id`, cut into max_len pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces_of(tokenizer_path, max_len, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, from the histogram of lengths alone ------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    eps = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = target - gram @ x
        gradient[free] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= eps:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.zeros(n)
            trial[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = at[trial[at] <= 0]
            if not len(low):
                break
            step = float(np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300)))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                return x
        x = trial
    return x


def best_fills(values: np.ndarray, classes: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For up to `depth` pieces and each room of 0 .. classes classes: the most value that fits, and the class of the
    piece to take first for it (0: none). values: the worth of a piece of class 1, 2, and so on."""
    best, pick = np.zeros((depth + 1, classes + 1)), np.zeros((depth + 1, classes + 1), int)
    for d in range(1, depth + 1):
        best[d] = best[d - 1]
        for c in np.flatnonzero(values > 0) + 1:
            gain = best[d - 1, : classes + 1 - c] + values[c - 1]
            more = gain > best[d, c:] + 1e-12
            best[d, c:][more] = gain[more]
            pick[d, c:][more] = c
    return best, pick


def fit_patterns(total: np.ndarray, depth: int, rounds: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns (tuples of at most `depth` length classes that fit a sequence of len(total) classes, longest first) and
    how often to use each, fitted to the counts `total` of the classes by non-negative least squares.

    There are too many patterns to list, so they are enumerated by what they are worth: in each round the residual of
    the fit prices the classes, and for every class the pattern with a piece of it that is worth most (a knapsack
    over the classes) joins. A long piece left over costs more than a short one.
    """
    classes = len(total)
    weight = np.arange(1, classes + 1, dtype=float)
    live = (np.flatnonzero(total) + 1).tolist()
    found: dict[tuple[int, ...], int] = {}
    x, residual = np.zeros(0), total * weight
    for _ in range(rounds):
        _, pick = best_fills(np.maximum(residual * weight, 0), classes, depth - 1)
        before = len(found)
        for c in live:
            pattern, room = [c], classes - c
            for d in range(depth - 1, 0, -1):
                if pick[d, room]:
                    pattern.append(int(pick[d, room]))
                    room -= pattern[-1]
            found.setdefault(tuple(sorted(pattern, reverse=True)), len(found))
        if len(found) == before:
            break
        a = np.zeros((classes, len(found)))
        for pattern, j in found.items():
            for c in pattern:
                a[c - 1, j] += 1
        x = nnls(a * weight[:, None], total * weight)
        residual = total * weight - (a * weight[:, None]) @ x
    return [(p, float(x[j])) for p, j in found.items() if x[j] > 1e-9]


class _Runs:
    """The lengths of one class, longest first, as runs (length, next rank, documents left)."""

    def __init__(self):
        self.runs: list[list[int]] = []

    def take(self, n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            run = self.runs[0]
            k = min(n, run[2])
            got.append((run[0], run[1], k))
            run[1], run[2], n = run[1] + k, run[2] - k, n - k
            if not run[2]:
                self.runs.pop(0)
        return got


Placement = tuple[int, int, int, int, int, int]


def plan_sequences(histogram: dict[int, int], max_len: int = 4096, classes: int = 32, depth: int = 6, rounds: int = 6, shorts: Sequence[float] = (0.3, 0.4, 0.5, 0.75, 1.0)) -> tuple[list[Placement], int, int]:
    """Placements (length, first rank, last rank + 1, pieces a sequence, first sequence, offset), the sequences used, and
    how many pieces are placed by patterns.

    Patterns are for the longer pieces; of the plans that leave each share in `shorts` of the pieces, the shortest ones,
    to best fit, the one with the fewest sequences is taken, of equal ones the one with the most pieces in patterns.
    A share of 1 is best fit alone, so patterns never cost a sequence.
    """
    plans = [_plan(histogram, max_len, classes, depth, rounds, s) for s in shorts]
    return min(plans, key=lambda p: (p[1], -p[2]))


def _plan(histogram: dict[int, int], max_len: int, classes: int, depth: int, rounds: int, short: float) -> tuple[list[Placement], int, int]:
    """A plan by patterns for all but the shortest pieces, a share of `short`.

    Lengths are rounded up to `classes` classes, and patterns of at most `depth` of them are fitted to the histogram
    (fit_patterns); repeat counts are rounded and cut to what is there. The shortest pieces and what rounding leaves
    over go, longest first, where they leave the least room: into the room that patterns leave by rounding lengths
    up, then into new sequences. Everything is done on runs of equal lengths, so the work depends on the distinct
    lengths (at most max_len), not on the documents.
    """
    unit = -(-max_len // classes)
    passed, floor = 0, 0
    for length in sorted(histogram):
        passed += histogram[length]
        if passed > short * sum(histogram.values()):
            break
        floor = length
    by_class: dict[int, _Runs] = defaultdict(_Runs)
    short_runs: list[tuple[int, int, int]] = []
    total = np.zeros(classes)
    for length in sorted(histogram, reverse=True):
        c = -(-length // unit)
        if length <= floor:
            short_runs.append((length, 0, histogram[length]))
        else:
            by_class[c].runs.append([length, 0, histogram[length]])
            total[c - 1] += histogram[length]
    placements: list[Placement] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, sequences)
    order: list[int] = []  # rooms, sorted
    used = 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((first, n))

    by_patterns = 0
    if total.any():
        fitted = fit_patterns(total, depth, rounds)
        left = [int(x) for x in total]
        for shape, times in sorted(fitted, key=lambda f: (-f[1] % 1, f[0])):
            n = min(int(times + 0.5), *(left[c - 1] // shape.count(c) for c in shape))
            if n <= 0:
                continue
            by_patterns += n * len(shape)
            columns = []
            for c in shape:
                left[c - 1] -= n
                columns.append(by_class[c].take(n))
            cuts = sorted({0, *(x for col in columns for x in np.cumsum([k for *_, k in col]).tolist())})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for col in columns:
                    passed = 0
                    for length, rank, k in col:
                        if passed <= lo < passed + k:
                            first = rank + lo - passed
                            placements.append((length, first, first + hi - lo, 1, used + lo, offset))
                            offset += length
                            break
                        passed += k
                leave(max_len - offset, used + lo, hi - lo)
            used += n
    rest = [tuple(r) for runs in by_class.values() for r in runs.runs] + short_runs
    for length, rank, n in sorted(rest, reverse=True):
        while n:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, count = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room, first = max_len, used
                count = -(-n // (max_len // length))
                used += count
            each = min(room // length, n)
            take = min(count, n // each)
            placements.append((length, rank, rank + take * each, each, first, max_len - room))
            leave(room - each * length, first, take)
            if count > take:
                leave(room, first + take, count - take)
            rank, n = rank + take * each, n - take * each
    return placements, used, by_patterns


def pack_pieces(pieces: DataFrame, max_len: int = 4096, rows_per_block: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to pieces with doc_id, piece and length.

    The driver sees one count a length, at most max_len numbers, and sends out the plan, whose size that bounds too.
    A piece finds its place by its rank among the pieces of its length; ranks are made block by block, so that a
    length held by a third of all pieces is still spread.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements, _, _ = plan_sequences(histogram, max_len)
    plan = pieces.sparkSession.createDataFrame(placements or [(0,) * 6], "length long, __lo long, __hi long, __each long, __first long, __at long")
    blocks = blocks_for(sum(histogram.values()), max(1, len(histogram)), rows_per_block)
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", blocks).withColumnRenamed("length", "__length")
    placed = ranked.join(F.broadcast(plan), (F.col("__length") == F.col("length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    inside = F.col("__rank") - F.col("__lo")
    return (
        placed.withColumn("sequence_id", F.col("__first") + F.floor(inside / F.col("__each")).cast("long"))
        .withColumn("offset", F.col("__at") + F.pmod(inside, F.col("__each")) * F.col("length"))
        .drop("__lo", "__hi", "__each", "__first", "__at", "__rank", "__length")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its place in the packed sequences.

    Null and empty texts are one piece holding end_id. Repeated rows are packed as often as they occur, rows without
    doc_id too. Other columns are not read. An empty table gives an empty result. Only documents longer than max_len
    are cut. Pieces of equal length are ranked by hash block, doc_id, piece and content, so rows that are equal in all
    of these may change places with each other.
    """
    pieces = stash(token_pieces(docs, tokenizer_path, max_len, end_id), "pieces")
    return pack_pieces(pieces, max_len).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
