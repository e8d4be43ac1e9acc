"""WARC archives against plain hashing, read back by a reader of its own."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilspan.llm import warc
from veilspan.session import work_folder

SCHEMA = "page_id long, url string, html string, digest string, archive int, type string"


def expected(rows, smallest=100):
    """(page, bytes, digest, type, refers) with the smallest id first; of rows of one id the first."""
    out, seen = [], {}
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        repeat = len(payload) >= smallest and digest in seen
        out.append((page, len(payload), digest, "revisit" if repeat else "response", seen[digest] if repeat else None))
        if not repeat:
            seen[digest] = page
    return sorted(out, key=repr)


def pages(spark):
    rng = random.Random(3)
    bodies = [None, "", "x", "y" * 99, "z" * 100, "WARC/1.1\r\n\r\n" * 20, "\r\n\r\nü€" * 300, "long " * 60_000, "\x00\x1f" * 80]
    rows = [(rng.randrange(-20, 500), rng.choice([None, "http://a.b/c%20d?é", "http://x\r\nWARC-Type: y"]), rng.choice(bodies)) for _ in range(120)]
    rows += rows[:4] + [(None, None, "z" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200)]
    return [(*r, "d", 1, "t") for r in rows]


def test_round_trip(spark):
    rows = pages(spark)
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert all(r.intact for r in got)
    assert sorted(((None if r.id is None else int(r.id), r.bytes, r.digest.hex(), r.type, None if r.refers_to is None else int(r.refers_to))
                   for r in got), key=repr) == expected(rows)
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_valid_and_smaller(spark, monkeypatch):
    """The files hold what the standard asks for, one record a member, and each repeated payload once."""
    rows = [(i, f"http://h/{i}", "same payload " * 20) for i in range(50)] + [(100 + i, None, f"{i} " * 100) for i in range(50)]
    headers = warc.capture(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), work_folder(spark, "warc-in"))
    files = warc.deduplicated(headers, work_folder(spark, "warc")).collect()
    assert sum(f.records for f in files) == 100
    whole = b"".join(gzip.open(f.archive.removeprefix("file://")).read() for f in files)
    assert whole.count(b"same payload same") > 0 and whole.count(("same payload " * 20).encode()) == 1
    assert whole.count(b"WARC-Type: revisit") == 49 and whole.count(b"WARC-Type: warcinfo") == len(files)
    heads = [warc.parsed(m)[0] for f in files for _, _, m in warc.members(f.archive)]
    ids = [h[b"warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids)
    refs = {h[b"warc-refers-to"] for h in heads if h[b"warc-type"] == b"revisit"}
    (response,) = [h for h in heads if h.get(b"x-page-id") == b"0"]
    assert refs == {response[b"warc-record-id"]}


def test_archives_again(spark):
    """Archives that hold revisits are read, resolved and written once more with the same result."""
    rows = pages(spark)
    headers = warc.capture(spark.createDataFrame(rows, SCHEMA).repartition(2), work_folder(spark, "warc-in"))
    once = warc.deduplicated(headers, work_folder(spark, "warc"))
    twice = warc.deduplicated(warc.scan(once), work_folder(spark, "warc"))
    columns = ["id", "bytes", "type", "refers_to", F.hex("digest").alias("digest"), "intact"]
    a, b = (sorted(map(tuple, warc.read_back(x).select(*columns).collect()), key=repr) for x in (once, twice))
    assert a == b and len(a) == len(rows)


def test_small_archives_and_lost_attempts(spark, monkeypatch):
    """Rolled files; a file that no committed table names is not read."""
    folder = work_folder(spark, "warc-in")
    headers = warc.capture(spark.createDataFrame([(i, None, str(i) * 200) for i in range(30)], "page_id string, url string, html string"), folder)
    writer = warc._Writer(folder, "1970-01-01T00:00:00Z")
    writer.put(warc.record(b"response", "urn:uuid:lost", b"lost", "1970-01-01T00:00:00Z", []), 4)
    writer.close()
    assert writer.done[0][1] == 1
    assert warc.read_back(warc.deduplicated(headers, work_folder(spark, "warc"), order="string")).count() == 30
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 2)
    rolled = warc._Writer(folder, "1970-01-01T00:00:00Z")
    for k in range(5):
        rolled.put(warc.record(b"response", f"urn:uuid:{k}", b"x", "1970-01-01T00:00:00Z", []), 1)
    rolled.close()
    assert [n for _, n in rolled.done] == [2, 2, 1]


def test_broken_archives_are_errors(tmp_path):
    whole = warc.record(b"response", "urn:uuid:1", b"abc", "1970-01-01T00:00:00Z", [])
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-5])
    with pytest.raises(ValueError):
        list(warc.members(f"file://{tmp_path}/cut.warc.gz"))
    with pytest.raises(ValueError):
        warc.parsed(gzip.decompress(whole) * 2)
