"""A Bloom filter of ids, so that a scan drops most rows that a join would drop, before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordcodes import U, mix

PAGE_BITS = 1 << 16


def _marks(hashes: np.ndarray) -> np.ndarray:
    """Four places in its page for each hash, (4, n)."""
    spread = mix(hashes.view(U))
    return np.stack([(spread >> U(16 * k)) & U(PAGE_BITS - 1) for k in range(4)]).astype(np.int64)


def _fill(batches):
    """The pages' bits, from rows sorted by page: one page is in memory at a time."""
    page, bits = None, np.zeros(PAGE_BITS, bool)
    for b in batches:
        pages, hashes = b.column("page").to_numpy(), b.column("hash").to_numpy()
        cuts = np.flatnonzero(np.diff(pages)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(pages)], strict=True):
            if lo == hi:
                continue
            if page is not None and pages[lo] != page:
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["page", "bits"])
                bits[:] = False
            page = int(pages[lo])
            bits[_marks(hashes[lo:hi]).reshape(-1)] = True
    if page is not None:
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["page", "bits"])


def may_hold(ids: DataFrame, column: str, bits_per_id: int = 12, most_bits: int = 1 << 28) -> Column:
    """A test of the long column `column` that is true for every id in the one column of `ids`, and for few others.

    The filter takes `bits_per_id` bits an id, at most `most_bits` in all (32 MB), which bounds what the driver holds
    and the broadcast at any size. Beyond that it lets more rows through, so it must be followed by the exact join.
    Each page of 65,536 bits is filled in one task, from ids that stream in, and the driver collects the pages.
    """
    n = ids.count()
    pages = max(1, min(most_bits // PAGE_BITS, -(-n * bits_per_id // PAGE_BITS)))
    hashed = ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long")).alias("hash"))
    dealt = hashed.select("hash", F.pmod("hash", F.lit(pages)).cast("int").alias("page")).repartition("page").sortWithinPartitions("page")
    table = np.zeros((pages, PAGE_BITS // 8), np.uint8)
    for r in dealt.mapInArrow(_fill, "page int, bits binary").collect():
        table[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy()
        page, at = np.mod(h, pages), _marks(h)
        found = np.ones(len(h), bool)
        for k in range(len(at)):
            found &= (shared.value[page, at[k] >> 3] >> (7 - (at[k] & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return held(F.xxhash64(F.col(column).cast("long")))
