"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash
from tessera.llm.wordcodes import arrow_rows, batched, release

ORDER = 3
PAD = b"\n" * ORDER


class _Table:
    """An exact map from 32-bit n-grams to rows of `values`: a direct slot for most keys, a sorted list for the few that collide."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        at = self._slots(keys)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[at[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.late = np.flatnonzero(self.slot[at] != np.arange(len(keys)))
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[at[self.late]] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The row of each n-gram, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(grams), -1, np.int64)
        at = self._slots(grams)
        row = self.slot[at].astype(np.int64)
        wrong = np.flatnonzero(self.keys[row] != grams)
        if len(wrong):
            row[wrong] = -1
            again = wrong[self.crowded[at[wrong]]]
            if len(again):
                late = self.keys[self.late]
                p = np.minimum(np.searchsorted(late, grams[again]), len(late) - 1)
                row[again] = np.where(late[p] == grams[again], self.late[p], -1)
        return row


def _grams(raw: np.ndarray, width: int) -> np.ndarray:
    """The n-gram that ends at each byte from ORDER on."""
    code = np.zeros(len(raw) - ORDER, np.uint32)
    for back in range(width - 1, -1, -1):
        code = (code << np.uint32(8)) | raw[ORDER - back : len(raw) - back].astype(np.uint32)
    return code


def _padded(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts joined by PAD, which gives each a context to begin in, and which n-grams end in a byte of a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes + ORDER)  # in the joined bytes
    step = np.zeros(int(end[-1]) + 1 if len(end) else ORDER + 1, np.int8)
    np.add.at(step, end - sizes, 1)
    np.add.at(step, end, -1)
    return np.frombuffer(PAD + PAD.join(texts) if len(texts) else PAD, np.uint8), np.cumsum(step[:-1])[ORDER:] > 0


class PpmModel:
    """Frozen byte statistics of several languages, contexts of up to ORDER bytes.

    A byte costs -log2(count / (n + t)) in the longest context that has seen it; each context seen without it costs an
    escape of -log2(t / (n + t)) first (n symbols, t distinct ones), a context never seen in a language costs nothing,
    and below order 0 every byte costs 8 bits. Code lengths are exact for these statistics.
    """

    def __init__(self, samples: dict[str, Sequence[bytes]]):
        self.langs = sorted(samples)
        raws = [_padded(samples[k]) for k in self.langs]
        self.symbols: list[_Table] = []
        self.escapes: list[_Table] = []
        for order in range(ORDER + 1):
            counts, contexts = [], []
            for raw, own_byte in raws:
                gram, n = np.unique(_grams(raw, order + 1)[own_byte], return_counts=True)
                context = gram >> np.uint32(8) if order else np.zeros(len(gram), np.uint32)
                own, first = np.unique(context, return_index=True)
                total = np.add.reduceat(n, first) if len(own) else n
                kinds = np.diff(np.append(first, len(gram)))
                counts.append((gram, n, np.repeat(total + kinds, kinds)))
                contexts.append((own, -np.log2(kinds / (total + kinds))))
            self.escapes.append(self._table(contexts, np.zeros))
            keys = np.unique(np.concatenate([g for g, *_ in counts]))
            costs = self._cost(keys, order, below=True)
            for j, (gram, n, out_of) in enumerate(counts):
                costs[np.searchsorted(keys, gram), j] = -np.log2(n / out_of)
            self.symbols.append(_Table(keys, costs.astype(np.float32)))

    def _table(self, per_lang: list, start) -> _Table:
        keys = np.unique(np.concatenate([k for k, _ in per_lang]))
        values = start((len(keys), len(self.langs)), np.float32)
        for j, (k, v) in enumerate(per_lang):
            values[np.searchsorted(keys, k), j] = v
        return _Table(keys, values)

    def _cost(self, grams: np.ndarray, order: int, below: bool = False) -> np.ndarray:
        """Bits for the last byte of each n-gram from `order` down; below: as if the order itself had not seen it."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        width = np.uint32((1 << 8 * order) - 1)
        row = np.full(len(grams), -1) if below else self.symbols[order].find(grams)
        bits = np.empty((len(grams), len(self.langs)), np.float32)
        hit = np.flatnonzero(row >= 0)
        bits[hit] = self.symbols[order].values[row[hit]] if len(hit) else 0
        miss = np.flatnonzero(row < 0)
        if len(miss):
            part = grams[miss]
            lower = self._cost(part & width, order - 1)
            context = self.escapes[order].find((part >> np.uint32(8)) if order else np.zeros(len(part), np.uint32))
            known = np.flatnonzero(context >= 0)
            if len(known):
                lower[known] += self.escapes[order].values[context[known]]
            bits[miss] = lower
        return bits

    def code_lengths(self, texts: list[bytes], slice_bytes: int = 65_536) -> np.ndarray:
        """Bits of each text in each language; the texts are coded slice by slice, so that besides them only a slice's
        costs (slice_bytes for each language of this model) are in memory."""
        raw = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
        total = np.zeros((len(texts), len(self.langs)))
        if not texts:
            return total
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes + ORDER) - sizes  # in raw; in n-gram numbering ORDER less
        for lo in range(0, len(raw) - ORDER, slice_bytes):
            hi = min(lo + slice_bytes, len(raw) - ORDER)
            bits = self._cost(_grams(raw[lo : hi + ORDER], ORDER + 1), ORDER)
            run = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
            a = np.clip(begin - ORDER - lo, 0, hi - lo)
            b = np.clip(begin - ORDER + sizes - lo, 0, hi - lo)
            total += run[b] - run[a]
        return total


def training_sample(docs: DataFrame, docs_per_language: int, bytes_per_language: int, languages_per_block: int = 8, max_broadcast: int = 100_000) -> DataFrame:
    """lang, block, text (bytes) of a bounded hash sample for every language: at most `docs_per_language` documents and
    `bytes_per_language` bytes, the last text cut there. Languages by name are dealt to blocks of
    `languages_per_block`. The sample depends on the doc_ids alone, and does not grow with the corpus; the languages
    are one row each, broadcast up to `max_broadcast`."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    span = 1 << 30
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    block = F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / languages_per_block).cast("int")  # over one row a language
    limits = stash(counts.select("lang", block.alias("block"), F.least(F.lit(span), F.floor(F.lit(span * docs_per_language) / F.col("n"))).alias("below")), "languages")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(span))
    rows = labelled.select("lang", F.substring(F.col("text").cast("binary"), 1, bytes_per_language).alias("text"), place.alias("place"))
    rows = rows.join(F.broadcast(limits) if limits.count() <= max_broadcast else limits, "lang").filter(F.col("place") < F.col("below"))
    order = Window.partitionBy("lang").orderBy("place", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("left", (bytes_per_language - before).cast("int"))
    return rows.filter((F.col("at") <= docs_per_language) & (F.col("left") > 0)).select("lang", "block", F.expr("substring(text, 1, left)").alias("text"))


def _fit(rows: pa.Table) -> pa.Table:
    """The model of one block of languages, as one row."""
    samples: dict[str, list[bytes]] = {}
    for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
        samples.setdefault(lang, []).append(text)
    return pa.table({"model": pa.array([pickle.dumps(PpmModel(samples))], pa.binary())})


def _in_turn(shared: Sequence[Broadcast]) -> Iterator[PpmModel]:
    """The models of all blocks; of several, only one is in memory at a time."""
    for s in shared:
        yield s.value
        if len(shared) > 1 and getattr(s, "_path", None):
            s.__dict__.pop("_value", None)


def _score(shared: Sequence[Broadcast], columns: dict[str, pa.DataType]):
    kinds = list(columns.values())

    def run(batches):
        for held in batched(arrow_rows(batches, *columns, "text"), len(columns)):
            texts = [r[-1] for r in held]
            name, least, total = np.full(len(texts), "", object), np.full(len(texts), np.inf), np.zeros(len(texts))
            for model in _in_turn(shared):
                bits = model.code_lengths(texts)
                best = bits.argmin(1)
                own, low = np.array(model.langs, object)[best], bits[np.arange(len(best)), best]
                name = np.where((low < least) | ((low == least) & (own < name)), own, name)
                both = np.minimum(least, low)
                total = total * np.exp2(np.maximum(both - least, -1000)) + np.exp2(np.maximum(both[:, None] - bits, -1000)).sum(1)
                least = both
            rate = least / np.maximum(1, [len(t) for t in texts])
            own = [pa.array([r[j] for r in held], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(name.tolist(), pa.string()), pa.array(1 / total, pa.float64()), pa.array(rate, pa.float64())], names=[*columns, "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, models: Sequence[Broadcast], key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (0 to 1: the share of the likelihood), bits_per_byte for every whole text.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Ties go to the first
    language by name. Repeated rows are scored each; only `key` and the text are read. models: one of each block of
    languages, as `train` gives them; a text keeps its least code length over all of them.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), "text")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not models:
        return rows.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    schema = f"{key} long, letters boolean, lang_pred string, score double, bits_per_byte double"
    scored = rows.select(key, lettered.alias("letters"), "text").mapInArrow(_score(models, {key: pa.int64(), "letters": pa.bool_()}), schema)
    return scored.select(
        key, F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), "bits_per_byte",
    )


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, docs_per_language: int = 300, bytes_per_language: int = 1_000_000) -> list[Broadcast]:
    """Models of the labelled documents outside the held-out fold, one a block of languages; none where there are none.
    They are fitted in tasks and written; the driver passes them on one by one."""
    sample = training_sample(docs.filter(~held_out()).select("doc_id", "lang", "text"), docs_per_language, bytes_per_language)
    fitted = stash(sample.groupBy("block").applyInArrow(_fit, "model binary"), "models")
    return [docs.sparkSession.sparkContext.broadcast(pickle.loads(r["model"])) for r in fitted.toLocalIterator()]


def predict_languages(docs: DataFrame) -> DataFrame:
    """Train outside the held-out fold and score every document: doc_id, held_out, lang_pred, score, bits_per_byte.

    held_out is false for a row without doc_id, which is scored but never learned from, like one without lang or text.
    Nulls, empty texts, ties and repeated rows are as `identify` says; other columns are not read, so their names can't
    clash. An empty table gives an empty result, and one without labels `und` for every row. Whole texts are scored,
    very long ones slice by slice.
    """
    scored = identify(docs, train(docs))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def filter_languages(docs: DataFrame, most_bits_per_byte: float = 7.0, least_bytes: int = 50, models: Sequence[Broadcast] | None = None) -> DataFrame:
    """The documents that have a language, all columns as they were, without a shuffle.

    A row goes if it is `und`, or if its best language needs over `most_bits_per_byte` for the whole text of at least
    `least_bytes`: bytes that none of the learned languages explains. Shorter texts are too little to tell. Where nothing could be learned, only texts without a letter go.
    """
    shared = train(docs) if models is None else models
    lettered = docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not shared:
        return lettered

    def keep(batches):
        for b in batches:
            texts = b.select(["text"])
            mask: list[bool] = []
            for held in batched(arrow_rows([texts], "text"), 0):
                part = [t for t, in held]
                size = np.array([len(t) for t in part])
                least = np.full(len(part), np.inf)
                for model in _in_turn(shared):
                    least = np.minimum(least, model.code_lengths(part).min(1))
                mask += ((size < least_bytes) | (least <= most_bits_per_byte * size)).tolist()
            yield b.filter(pa.array(mask, pa.bool_()))
        release()

    return lettered.mapInArrow(keep, docs.schema)
