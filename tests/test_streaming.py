"""The sliding limiter as state: rows in any order, several batches, late rows, quiet keys."""

from datetime import datetime, timedelta

import pytest

from tessera.sources.shared import shared_folder
from tessera.streaming.limits import run_once
from tessera.streaming.state import limited, ordered_store

START = datetime(2026, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp"


def stream_of(spark, batches):
    """A stream that reads one file a batch, in order."""
    folder = shared_folder(spark, "stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, e, None if s is None else START + timedelta(seconds=s)) for u, e, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def judged(rows, limit, seconds):
    hits, out = {}, {}
    for u, e, s in sorted(rows, key=lambda r: (r[2], r[1])):
        hits[u] = [h for h in hits.get(u, []) if h >= s - seconds]
        out[e] = len(hits[u]) < limit
        if out[e]:
            hits[u].append(s)
    return out


def result(spark, batches, **options):
    with ordered_store(spark):
        return {r["event_id"]: r["allowed"] for r in run_once(limited(stream_of(spark, batches), "user_id", "event_id", 2, 60, **options), "limits").collect()}


def test_rows_in_any_order(spark):
    one = [(u, 1000 * u + i, (i * 37) % 400) for u in (1, 2, -3) for i in range(40)] + [(None, 9, 5), (1, 8, None)]
    assert result(spark, [one]) == judged([r for r in one if r[0] is not None and r[2] is not None], 2, 60)


def test_state_goes_on_over_batches(spark):
    batches = [[(1, 1, 0), (1, 2, 10), (1, 3, 20)], [(1, 4, 59), (2, 5, 60)], [(1, 6, 61), (1, 7, 71)], [(1, 8, 500), (2, 9, 501)]]
    assert result(spark, batches) == judged(sum(batches, []), 2, 60)


@pytest.mark.parametrize(("lateness", "late_row"), [("0 seconds", False), ("1 hour", True)])
def test_late_rows(spark, lateness, late_row):
    batches = [[(1, 1, 100)], [(1, 2, 1000)], [(1, 3, 50), (1, 4, 5000)], [(2, 5, 99_999)], [(2, 6, 999_999)]]
    got = result(spark, batches, lateness=lateness)
    assert (3 in got) == late_row and {1, 2, 4} <= set(got)
    assert (6 in got) == (lateness == "0 seconds")  # within the lateness of the end, a row waits
