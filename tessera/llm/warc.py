"""WARC archives: a deterministic writer with revisit records, and a reader that salvages damaged archives."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_path, stash, utf8_bytes
from tessera.llm.wordcodes import arrow_rows

END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing --------------------------------------------------------------------------------------------------------


def record(page: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its HTTP block, or (refers_to given) a revisit with the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {re.sub(r'[\r\n ]+', '%20', url)}", "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + END + block + END


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(base: str, roll_bytes: int):
    """Rows to archives of about roll_bytes under a folder that all executors share. Names and contents depend on the
    rows alone, and a file appears whole by a rename, so a task that is run again writes the same files."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        held: list[bytes] = []
        done: list[tuple[str, int, int, int]] = []
        largest = 0

        def close():
            name = f"{folder}/part-{part:05d}-{len(done):05d}.warc.gz"
            data = b"".join(held)
            draft = f"{folder}/.{part}-{len(done)}-{TaskContext.get().taskAttemptId()}.draft"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, name)
            done.append((name, len(held), len(data), largest))
            held.clear()

        size = 0
        for page, url, html, n, digest, refers in arrow_rows(batches, "page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"):
            written = record(page, url.decode(), html, n, digest.decode(), refers)
            largest = max(largest, len(written))
            held.append(gzip_member(written))
            size += len(held[-1])
            if size >= roll_bytes:
                close()
                size = 0
        if held:
            close()
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes", "largest"])

    return run


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages that are written as revisits.

    Of pages with equal payloads of at least `least` bytes the largest page_id is the response. The largest id of a
    digest is found with partial sums, so many equal pages cost no more than others; the join back may be split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = stash(pages.select(F.col("page_id").cast("long").alias("page_id"), utf8_bytes(F.col("html")).alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest")), "pages")
    large = narrow.filter(F.col("payload_bytes") >= least)
    kept = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = large.join(kept, "payload_digest").filter(F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True)) & F.col("refers_to").isNotNull())
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def write_warc(pages: DataFrame, base: str, least: int = 1000, roll_bytes: int = 8_000_000) -> DataFrame:
    """Write a record per page to gzipped archives under `base`; returns archive, records, bytes of each file, and the
    bytes of the largest record that the task had written by then.

    Null html is an empty payload, a null url an empty one. Repeated rows are written each.
    """
    revisits = plan_records(pages, least).select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), utf8_bytes(F.col("html")).alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    ordered = joined.sortWithinPartitions("page_id", "payload_digest", "url").select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    return stash(ordered.mapInArrow(_write(base, roll_bytes), "archive string, records long, bytes long, largest long"), "archives")


# --- reading --------------------------------------------------------------------------------------------------------


#: A member of an archive from elsewhere that inflates to more than this is not read on, where the reader is not told otherwise.
MOST_INFLATED = 256_000_000


def _member(data: memoryview, at: int, most: int, step: int = 65_536) -> tuple[bytes, int]:
    """The gzip member that begins at `at`, and where it ends; ValueError if it is cut, fails its check or inflates to
    over `most` bytes."""
    z = zlib.decompressobj(31)
    out, pos, size = [], at, 0
    try:
        while not z.eof:
            if z.unconsumed_tail:
                got = z.decompress(z.unconsumed_tail, 16 * step)
            elif pos >= len(data):
                raise ValueError("cut member")
            else:
                piece = data[pos : pos + step]
                pos += len(piece)
                got = z.decompress(piece, 16 * step)
            out.append(got)
            size += len(got)
            if size > most:
                raise ValueError("member too large")
    except zlib.error as e:
        raise ValueError(f"bad member: {e}") from None
    return b"".join(out), pos - len(z.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line stands at `at`, and where it ends; ValueError if any check fails."""
    first = _VERSION.match(data, at)
    if not first:
        raise ValueError("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise ValueError("cut header")
    head = {}
    for line in data[first.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        name = name.strip().lower()
        if name in head and name in ("warc-record-id", "content-length"):
            raise ValueError("two headers in one")
        head[name] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = stop + len(END)
    end = begin + int(head["content-length"])
    if data[end : end + 4] != END:
        raise ValueError("record doesn't end where its length says")
    block = data[begin:end]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and hashlib.sha1(block).hexdigest() != want[5:].lower():
        raise ValueError("block digest differs")
    return head | {"block": block}, end + 4


def salvage(data: bytes, most_inflated: int | None = None) -> Iterator[tuple[str, int, int, object]]:
    """('record', begin, end, fields) and ('gap', begin, end, reason) that cover an archive from first to last byte.

    A gzipped archive is read member by member, a plain one record by record. After a failed check the reader looks
    for the next place where a member that holds a version line, or a version line whose record passes its checks,
    begins; what lies between is a gap. A member may hold several records; a damaged one inside it is a gap of the
    whole member, its sound records are still returned. A member that inflates to over `most_inflated` bytes (MOST_INFLATED
    where it is not given) is a gap.
    """
    most = MOST_INFLATED if most_inflated is None else most_inflated
    view = memoryview(data)
    zipped = data[:2] == GZIP[:2] or not _VERSION.match(data) and GZIP in data and (not _VERSION.search(data) or data.find(GZIP) < _VERSION.search(data).start())
    at, bad, reason = 0, -1, ""
    while at < len(data):
        try:
            if zipped:
                inner, end = _member(view, at, most)
                found = list(_inside(inner))
                if not any(k == "record" for k, *_ in found):
                    raise ValueError(found[0][3] if found else "empty member")
            else:
                fields, end = _parse(data, at)
                found = [("record", 0, 0, fields)]
        except ValueError as e:
            if bad < 0:
                bad, reason = at, str(e)
            if zipped:
                at = data.find(GZIP, at + 1)
            else:
                m = _VERSION.search(data, at + 1)
                at = m.start() if m else -1
            if at < 0:
                break
            continue
        if bad >= 0:
            yield "gap", bad, at, reason
            bad = -1
        for kind, _, _, what in found:
            yield kind, at, end, what
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), reason


def _inside(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of an unzipped member."""
    at, bad, reason = 0, -1, ""
    while 0 <= at < len(data):
        try:
            fields, end = _parse(data, at)
        except ValueError as e:
            if bad < 0:
                bad, reason = at, str(e)
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else -1
            continue
        if bad >= 0:
            yield "gap", bad, at, reason
            bad = -1
        yield "record", at, end, fields
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), reason


_FIELDS = "archive string, kind string, begin long, finish long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, body = block.partition(END)
    return (head, body) if mark and head.startswith(b"HTTP/") else (b"", block)


def _read(with_payload: bool, most_inflated: int | None):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = [pa.int64() if f.endswith(" long") else pa.binary() if f.endswith(" binary") else pa.string() for f in _FIELDS.split(", ")]

    def row(archive: str, kind: str, begin: int, end: int, what) -> tuple:
        if kind == "gap":
            return (archive, kind, begin, end, what, *[None] * 7)
        head, body = _http(what["block"])
        type_ = what.get("warc-type")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(length[1]) if type_ == "revisit" and length else len(body)
        declared = what.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
        digest = declared if type_ == "revisit" else hashlib.sha1(body).hexdigest()
        if type_ != "revisit" and what.get("warc-payload-digest", "").startswith("sha1:") and len(declared) == 40 and declared != digest:
            return (archive, "gap", begin, end, "payload digest differs", *[None] * 7)
        return (archive, kind, begin, end, None, type_, what.get("warc-record-id"), what.get("warc-target-uri"), what.get("warc-refers-to"), digest, size, body if with_payload else None)

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                held, size = [], 0
                for found in salvage(content.as_py(), most_inflated):
                    held.append(row(archive, *found))
                    size += len(held[-1][-1] or b"") + 200
                    if size > 4_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, most_inflated: int | None = None) -> DataFrame:
    """The records (kind `record`) and the quarantined byte gaps (kind `gap`, with a reason) of all archives in a folder.

    Archives are read through Spark's binaryFile source, each by one task, which limits one to 2 GB; records leave
    the task as they are found. Gzip checks, lengths, block digests and payload digests are verified. A member that inflates to
    over `most_inflated` bytes, MOST_INFLATED if not given, is not read on but logged as a gap: a guard against archives made to
    fill the memory, to be raised for records that are larger.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload, most_inflated), _FIELDS)


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and tell each page's record: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response, and
    the others revisit it; smaller payloads are all responses. Rows that repeat the largest page_id with the payload
    are responses too. Null html is an empty payload, a null url an empty one; a row without page_id revisits a larger
    payload's page, and comes back without one. Repeated rows are recorded each. Other columns are not read. An empty
    table gives an empty result. A page of any size is read back: the reader is told of the largest record written.
    """
    spark = pages.sparkSession
    base = shared_path(spark, "warc")
    archives = write_warc(pages, base, least)
    largest = archives.agg(F.max("largest")).first()[0]
    if largest is None:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = read_warc(spark, base, with_payload=False, most_inflated=largest).filter("kind = 'record'")
    number = r"urn:page:(-?\d+)"
    return read.select(
        F.expr("try_cast(regexp_extract(record_id, 'urn:page:(-?[0-9]+)', 1) AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.regexp_extract("refers_to", number, 1).cast("long")).alias("refers_to"),
    )
