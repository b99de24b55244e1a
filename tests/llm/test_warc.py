import hashlib

from tessera.llm.common import shared_path
from tessera.llm import warc
from tessera.llm.warc import archive_pages, gzip_member, read_warc, record, salvage


def page(i, n):
    body = bytes([65 + i % 26]) * n
    return record(i, f"http://x/{i}", body, n, hashlib.sha1(body).hexdigest(), None)


def kinds(data):
    found = list(salvage(data))
    assert found[0][1] == 0 and found[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False))
    return [k if k == "gap" else w["warc-record-id"] for k, _, _, w in found]


def test_gzip_salvage():
    members = [gzip_member(page(i, 500)) for i in range(6)]
    assert kinds(b"".join(members)) == [f"<urn:page:{i}>" for i in range(6)]
    hurt = bytearray(b"".join(members))
    at = sum(map(len, members[:2])) + 40
    hurt[at : at + 4] = b"\0\0\0\0"
    assert kinds(bytes(hurt)) == ["<urn:page:0>", "<urn:page:1>", "gap", "<urn:page:3>", "<urn:page:4>", "<urn:page:5>"]
    assert kinds(b"".join(members[:3]) + members[3][:50]) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>", "gap"]
    assert kinds(b"junk" * 9 + b"".join(members[:2]))[0] == "gap"
    assert kinds(members[0] + b"\x1f\x8b\x08 not a member" + members[1]) == ["<urn:page:0>", "gap", "<urn:page:1>"]
    assert list(salvage(b"")) == []


def test_a_member_that_inflates_too_far_is_a_gap(monkeypatch):
    from tessera.llm import warc

    monkeypatch.setattr(warc, "MOST_INFLATED", 3_000_000)
    bomb = gzip_member(page(1, 50_000_000))
    assert len(bomb) < 300_000
    assert kinds(gzip_member(page(0, 2_000_000)) + bomb + gzip_member(page(2, 500))) == ["<urn:page:0>", "gap", "<urn:page:2>"]


def test_plain_salvage():
    records = [page(i, 300) for i in range(5)]
    assert kinds(b"".join(records)) == [f"<urn:page:{i}>" for i in range(5)]
    hurt = records[0] + records[1].replace(b"BBBB", b"BBXB", 1) + records[2][:150] + records[3] + records[4]
    assert kinds(hurt) == ["<urn:page:0>", "gap", "<urn:page:3>", "<urn:page:4>"]


def test_a_sound_record_in_a_hurt_member():
    two = page(1, 200) + page(2, 200)[:80] + page(3, 100)
    assert [k for k, *_ in salvage(gzip_member(two))] == ["record", "gap", "record"]


def test_roundtrip(spark):
    big = "x" * 1500
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://d", "small"), (5, "http://e\r\nWARC-Type: evil", None), (6, "u", "é" * 700), (7, "u", big), (8, "u", "é" * 700), (9, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    out = {r["page_id"]: r for r in archive_pages(pages).collect()}
    assert len(out) == len(rows)
    last = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000:
            last[html] = i
    for i, _, html in rows:
        body = (html or "").encode()
        keeper = last.get(html, i)
        want = ("response", None) if keeper == i else ("revisit", keeper)
        assert (out[i]["record_type"], out[i]["refers_to"]) == want
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())


def test_damaged_files_are_quarantined(spark, tmp_path):
    good = b"".join(gzip_member(page(i, 400)) for i in range(4))
    hurt = bytearray(good)
    spot = len(good) // 2 + 30
    hurt[spot] ^= 255
    (tmp_path / "a.warc.gz").write_bytes(good)
    (tmp_path / "b.warc.gz").write_bytes(bytes(hurt))
    got = read_warc(spark, f"file://{tmp_path}").collect()
    assert sum(r["kind"] == "record" for r in got) == 7
    gap = next(r for r in got if r["kind"] == "gap")
    assert gap["archive"].endswith("b.warc.gz") and gap["begin"] < spot < gap["finish"] and gap["reason"]
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["kind"] == "record")


def test_no_pages(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_pages_beyond_the_bound_come_back(spark, monkeypatch):
    """The bound is for archives from elsewhere: what was written here is read whatever its size."""
    monkeypatch.setattr(warc, "MOST_INFLATED", 10_000)
    rows = [(1, "http://a/1", "x" * 300_000), (2, "http://a/2", "y" * 9_000), (3, "http://a/3", "z" * 50_000), (4, "http://a/4", "x" * 300_000)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (300_000, "revisit", 4), 2: (9_000, "response", None), 3: (50_000, "response", None), 4: (300_000, "response", None)}


def test_bound_of_the_reader(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip_member(page(1, 300_000)) + gzip_member(page(2, 500)))
    for bound, want in ((None, 0), (10_000, 1)):
        assert read_warc(spark, f"file://{tmp_path}", most_inflated=bound).filter("kind = 'gap'").count() == want
