"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, stash
from tessera.llm.idfilter import may_hold
from tessera.llm.wordcodes import arrow_rows

SLOTS = 4
MAX_KICKS = 64


class CuckooIndex:
    """A cuckoo filter in front of bucketed content.

    The filter holds a 16-bit fingerprint for each live digest in one of two buckets; `content` holds the digests
    themselves with their values, by home bucket. A filter hit is verified against the content of the home bucket,
    a miss needs no look. When an insertion finds no place after MAX_KICKS moves, the filter doubles and is refilled
    from the stored keys, so nothing is ever lost to overflow. Digests must be evenly spread (SHA-256).
    """

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[dict] = [{} for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = (digest[0] << 8 | digest[1]) or 1
        home = int.from_bytes(digest[2:8], "little") & (self.buckets - 1)
        return mark, home, home ^ self._step(mark)

    def _step(self, mark: int) -> int:
        return (mark * 0x5BD1E995 & 0xFFFFFFFF) >> 7 & (self.buckets - 1)

    def get(self, digest: bytes):
        """The value of a live digest, else None."""
        mark, home, other = self._places(digest)
        if mark in self.table[home] or mark in self.table[other]:
            return self.content[home].get(digest)
        return None

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        mark, home, other = self._places(digest)
        self.content[home][digest] = value
        self.size += 1
        if not self._put(mark, home, other):
            self._resize()

    def _put(self, mark: int, home: int, other: int) -> bool:
        for at in (home, other):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = other
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            self.table[at][slot], mark = mark, self.table[at][slot]
            at ^= self._step(mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        live = list(self.items())
        buckets, self.resizes = self.buckets, self.resizes + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            for digest, value in live:
                mark, home, other = self._places(digest)
                self.content[home][digest] = value
                if not self._put(mark, home, other):
                    break
            else:
                return

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it isn't live."""
        mark, home, other = self._places(digest)
        if digest not in self.content[home]:
            return False
        del self.content[home][digest]
        self.table[home if mark in self.table[home] else other].remove(mark)
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content:
            yield from bucket.items()


_GROUPS = "digest binary, keep_id long, group_size long, keep_rows long"


def _merge(flush_at: int, per_bucket: bool):
    """Collapse (digest, id, rows, rows of that id) to one live entry a digest; a row with a larger id replaces the entry."""

    def run(batches):
        index, bucket = CuckooIndex(), None

        def flush():
            rows = [(d, *v) for d, v in index.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "keep_id", "group_size", "keep_rows"])

        for at, digest, doc, n, top in arrow_rows(batches, "bucket", "digest", "keep_id", "group_size", "keep_rows"):
            if index.size >= flush_at and not per_bucket or per_bucket and at != bucket:
                if index.size:
                    yield flush()
                index, bucket = CuckooIndex(), at
            held = index.get(digest)
            if held is None:
                index.insert(digest, (doc, n, top))
            elif doc == held[0]:
                index.delete(digest)
                index.insert(digest, (doc, held[1] + n, held[2] + top))
            else:
                newer = held[0] is None or doc is not None and doc > held[0]
                index.delete(digest)
                index.insert(digest, (doc, held[1] + n, top) if newer else (held[0], held[1] + n, held[2]))
        if index.size:
            yield flush()

    return run


def digest_groups(rows: DataFrame, keys_per_bucket: int = 50_000, flush_at: int = 100_000) -> DataFrame:
    """One row a digest from (doc_id, digest): keep_id (the largest doc_id), group_size, keep_rows (rows with that id).

    First each task collapses its own rows in an index that is emptied at `flush_at` live digests, so a digest with a
    third of all rows leaves each task as a few rows. Those go to buckets by digest, each with an index of its own of
    about `keys_per_bucket` keys; a task holds one index at a time.
    """
    n = rows.count()
    buckets = max(64, -(-n // keys_per_bucket))
    keyed = rows.select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest",
        F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("keep_rows"),
    )
    partial = keyed.mapInArrow(_merge(flush_at, False), _GROUPS)
    dealt = partial.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_merge(flush_at, True), _GROUPS)


def text_digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def dedup_report(docs: DataFrame) -> DataFrame:
    """Which row of each set of equal texts stays: one row per document, dropped ones too.

    Texts are equal when identical (null counts as empty); the largest doc_id stays. A null doc_id is below every
    other. Rows that repeat doc_id and text are all reported with kept true; `drop_copies` keeps one of them.
    """
    narrow = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_digest()).alias("digest")), "digests")
    groups = digest_groups(narrow)
    return narrow.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "keep_rows",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns as they were; of rows that repeat the kept doc_id and text, one
    stays (any of them, if other columns differ).

    Null counts as an empty text, a null doc_id is below every other. Rows with other texts are untouched, whatever
    their ids; columns of any name pass through; an empty table gives an empty one. Only rows that may have a copy are
    shuffled, by doc_id and digest: the others pass a Bloom filter of bounded size.
    """
    report = dedup_report(docs)
    more = report.filter(~F.col("kept") | (F.col("keep_rows") > 1)).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("kept").alias("repeat")).distinct()
    more = stash(more, "copies", docs.count())
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"))
    may_go = may_hold(more.select("id").distinct(), "doc_id")
    once = rows.filter(may_go).withColumn("sha256", text_digest("row.text")).dropDuplicates(["doc_id", "sha256"])  # a row without copies is there once
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha256") == F.col("sha"))
    stay = once.join(more.filter("NOT repeat").hint("merge"), same, "left_anti")
    return rows.filter(~may_go).select("row.*").unionByName(stay.select("row.*"))
