import gzip
import random

from pyspark.sql import functions as F

from rollcall.llm import warc as W


def message(body, chunk=None):
    head = b"HTTP/1.1 200 OK\r\n"
    return head + (b"Transfer-Encoding: chunked\r\n\r\n" + W.encode_chunks(body, chunk) if chunk else b"\r\n" + body)


def cut(name, block, at, **kind):
    parts = [block[i : i + at] for i in range(0, len(block), at)] or [b""]
    if len(parts) == 1:
        return [(name, "response", "http://x/", None, None, None, parts[0])]
    return [(name if i == 0 else f"{name}-{i}", "response" if i == 0 else "continuation", "http://x/" if i == 0 else None, None if i == 0 else name, i + 1, len(block) if i == len(parts) - 1 else None, p) for i, p in enumerate(parts)]


def test_round_trip_through_files(spark, tmp_path):
    rng = random.Random(1)
    bodies = {f"urn:{i}": rng.randbytes(rng.choice([0, 1, 50, 5000])) for i in range(30)}
    rows = [r for name, b in bodies.items() for r in cut(name, message(b, rng.choice([None, 7, 100])), 600)]
    rng.shuffle(rows)
    for k, pack in enumerate((lambda b: b, gzip.compress)):
        data = b"".join(pack(W.format_record(r[0], r[1], r[6], r[2], r[3], r[4], r[5])) for r in rows[k::2])
        (tmp_path / f"{k}.warc").write_bytes(data)
    read = W.read_warc(spark, str(tmp_path))
    assert read.count() == len(rows)
    got = {r["record_id"]: r for r in W.reassemble(read).collect()}
    assert {k: bytes(r["body"]) for k, r in got.items()} == bodies and {r["status"] for r in got.values()} == {"complete"}


def test_statuses(spark):
    b = message(b"hello world" * 20, 16)
    ok, gap, conflict, long = (cut(n, b, 100) for n in ("ok", "gap", "conflict", "long"))
    gap = gap[:1] + gap[2:]
    conflict.append((*conflict[1][:6], b"other"))
    long[-1] = (*long[-1][:5], 9999, long[-1][6])
    last = [(*r[:5], None, r[6]) for r in cut("last", b, 100)]
    rows = ok + [ok[1]] + gap + conflict + long + last + [("head", "response", "u", None, None, None, b"no header"), ("chunk", "response", "u", None, None, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz"), ("meta", "metadata", "u", None, None, None, b"kept"), ("null", "metadata", None, None, None, None, None), ("c2", "continuation", None, "orphan", 1, 3, b"abc"), (None, "x", None, None, None, None, b"")]
    docs = spark.createDataFrame(rows, W.SCHEMA).withColumn("id", F.lit(1)).withColumn("kind", F.lit(2)).withColumn("parts", F.lit(3))
    got = {r["record_id"]: (r["status"], None if r["body"] is None else bytes(r["body"])) for r in W.reassemble(docs).collect()}
    assert got == {
        "ok": ("complete", b"hello world" * 20), "gap": ("missing segment", None), "conflict": ("conflicting segments", None), "long": ("length mismatch", None), "last": ("missing segment", None), "head": ("bad header", None), "chunk": ("bad chunk", None),
        "meta": ("complete", b"kept"), "null": ("complete", b""), "orphan": ("missing segment", None),
    }
    assert W.reassemble(docs.limit(0)).count() == 0


def test_pages_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a/", "é" * 5000), (2, "http://a/", ""), (3, None, None), (4, "u", "x" * 3_000_000), (6, "u", "plain")], "page_id long, url string, html string").withColumn("block", F.lit(1))
    got = {r["record_id"]: r for r in W.reassemble(W.segmented(pages)).collect()}
    assert {k: bytes(r["body"]).decode() for k, r in got.items()} == {f"urn:page:{i}": h for i, h in ((1, "é" * 5000), (2, ""), (3, ""), (4, "x" * 3_000_000), (6, "plain"))}
    assert W.segmented(pages.limit(0)).count() == 0


def test_damaged_and_truncated_files(spark, tmp_path):
    good = [W.format_record(f"urn:{i}", "resource", b"x" * 100 * (i + 1), "u") for i in range(4)]
    members = [gzip.compress(g) for g in good]
    broken = bytearray(members[1])
    broken[12:30] = b"\xff" * 18
    (tmp_path / "a.warc.gz").write_bytes(members[0] + bytes(broken) + b"\0\0" + members[2] + members[3][:-9])
    (tmp_path / "b.warc").write_bytes(W.format_record("urn:plain", "resource", b"y" * 50, "u") + W.format_record("urn:cut", "resource", b"z" * 100, "u")[:-60])
    got = {r["record_id"]: (r["status"], r["body"] and len(r["body"])) for r in W.reassemble(W.read_warc(spark, str(tmp_path))).collect()}
    assert got.pop("urn:3") in (("complete", 400), ("truncated", None))
    assert got == {"urn:0": ("complete", 100), "urn:2": ("complete", 300), "urn:plain": ("complete", 50), "urn:cut": ("truncated", None)}


def test_bodies_shorter_than_their_length_and_odd_chunk_sizes():
    assert W.http_body(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nshort") == (None, "truncated")
    assert W.http_body(b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nshort") == (b"short", "complete")
    for size in (b"1_0", b"+1", b"0x1", b"", b"-1"):
        assert W.decode_chunks(size + b"\r\n" + b"a" * 16 + b"\r\n0\r\n\r\n") is None
    assert W.decode_chunks(b"A;x=y\r\n" + b"a" * 10 + b"\r\n0\r\n\r\n") == b"a" * 10


def test_reading_takes_time_in_proportion():
    import time

    took = []
    for n in (2000, 8000):
        data = b"".join(gzip.compress(W.format_record(f"urn:{i}", "resource", random.Random(i).randbytes(1000), "u")) for i in range(n))
        start = time.process_time()
        assert sum(1 for _ in W.parse_records(data)) == n
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5
