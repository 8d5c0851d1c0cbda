import base64
import glob
import hashlib
import tempfile

import pytest

from lonja.llm import warc as W

PAGES = "page_id long, url string, html string"
TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0 tail"
ROWS = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "e", TRAP), (6, "f", TRAP), (7, "g", "ends\r\n"), (8, "h", "\r\n\r\nWARC/1."),
        (9, "i", "\r\n" * 9), (None, "n", "<p>one</p>"), (None, "n", "alone"), (10, "r", "again"), (10, "r", "again"), (11, "ä", "ünï 😀\r\n\r\n"), (12, "long", "WARC/1.1\r\n" * 400 + "\r\n\r\nWARC/1.1\r\nContent-Length: 900\r\n\r\n" * 60)]


def expected(rows):
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        h = h or ""
        again = h in top and p != top[h]
        out.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


@pytest.fixture(params=["8m", "700"])
def split(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_round_trip_over_splits(frame, split):
    got = W.round_trip(frame(ROWS, PAGES, ("size", "digest", "keeper")).coalesce(2)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_small_payloads_stay_responses(frame):
    got = W.round_trip(frame(ROWS[:4], PAGES), min_bytes=5).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "revisit"), (2, "response"), (3, "response"), (4, "response")]


def test_the_archive_is_a_plain_warc_file(frame, spark):
    path = tempfile.mkdtemp() + "/w"
    W.write_warc(frame([(1, "http://a", TRAP)], PAGES).coalesce(1), path)
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path + "/part-*")))
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields[b"Content-Length"]):] == b"\r\n\r\n"
    assert rest[:int(fields[b"Content-Length"])].endswith(TRAP.encode())
    assert [r.payload_bytes for r in W.read_warc(spark, path).collect()] == [len(TRAP)]


def test_broken_chain_is_an_error(spark):
    path = tempfile.mkdtemp()
    with open(path + "/a.warc", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    with pytest.raises(ValueError):
        W.read_warc(spark, path)


def test_empty_table(frame):
    assert W.round_trip(frame([], PAGES)).collect() == []


def test_pointer_jumping_over_many_splits(spark):
    true = [(k * 10, (k + 1) * 10) for k in range(40)]
    false = [(k * 10 + 3, (k + 2) * 10) for k in range(40)] + [(55, None)]
    nodes = spark.createDataFrame([("f", o // 25, o, n) for o, n in true + false], "path string, split long, offset long, next long")
    assert sorted(r.offset for r in W.chained(nodes).collect()) == [o for o, _ in true]
