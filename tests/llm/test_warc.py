import hashlib
import random

from pyspark.sql import functions as F

from tracewell.llm import warc

ROWS = [(1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (3, None, "y" * 100), (2, "http://c", "y" * 100), (9, "u\r\nv", "y" * 100),
        (9, "u", "y" * 100), (4, "http://d", None), (5, "", "é\r\n\r\nWARC/1.1\r\n" * 20), (None, "n", "z" * 200), (None, "n", "y" * 100)]


def brute(rows):
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        refers = first.get(t) if len(raw) >= 100 and t in first and first[t] != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_compressed_and_plain(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "page_id long, url string, html string, digest int")
    for compress in (True, False):
        folder, files = warc.write_archives(df, compress=compress)
        back = warc.read_archives(spark, folder)
        assert back.filter(F.col("reason").isNotNull()).count() == 0
        got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=str) == brute(ROWS)
        assert files.agg(F.sum("records")).first()[0] == len(ROWS)
    folder, files = warc.write_archives(df.limit(0))
    assert files.count() == 0 and warc.read_archives(spark, folder).count() == 0


def rec(i, payload=b"payload "):
    body = payload * 50
    return warc.record(i, "u", hashlib.sha256(body).hexdigest(), body, len(body), None)


def read(raw):
    return [(warc.page_number(x.fields.get("warc-record-id")), x.offset, x.length, x.reason) for x in warc.salvage(raw)]


def test_salvage_of_a_broken_member():
    parts = [warc.member(rec(i)) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    raw = b"".join([*parts[:2], bytes(broken), parts[3], b"junk \x1f\x8b\x08 junk", parts[4], parts[5][:40]])
    got = read(raw)
    assert [x[0] for x in got if x[3] is None] == [0, 1, 3, 4]
    gaps = [x for x in got if x[3]]
    assert (gaps[0][1], gaps[0][2]) == (len(parts[0]) + len(parts[1]), len(parts[2]))
    assert gaps[1][2] == len(b"junk \x1f\x8b\x08 junk") and gaps[2][3] == "cut short"
    assert sum(x[2] for x in got) == len(raw)


def test_salvage_of_plain_archives_and_wrong_digests():
    parts = [rec(i) for i in range(4)]
    wrong = parts[1].replace(b"payload payload", b"payload pAyload", 1)
    raw = b"".join([parts[0], wrong, b"\0" * 33 + b"\n", parts[2], parts[3][:-9]])
    got = read(raw)
    assert [x[0] for x in got if x[3] is None] == [0, 2]
    assert [x[3] for x in got if x[3]] == ["wrong payload digest", "cut short"]
    assert sum(x[2] for x in got) == len(raw)
    assert read(b"") == [] and [x[3] for x in read(b"nothing here")] == ["cut short"]
    member = warc.member(rec(1).replace(b"WARC-Type: response", b"WARC-Type: revisit"))
    assert [x[0] for x in read(b"front" + member)] == [None, 1]


def test_damaged_archives_never_fail_and_lose_no_byte(spark, tmp_path):
    rng = random.Random(12)
    odd = [b"Content-Length: \xc2\xb2", b"Content-Length: 99999999999999999999", b"Content-Length: -4", b"Content-Length: "]
    for kind in ("warc", "warc.gz"):
        for n in range(30):
            parts = [rec(i, bytes(rng.randrange(32, 127) for _ in range(9))) for i in range(5)]
            k = rng.randrange(5)
            if n % 3 == 0:
                parts[k] = parts[k].replace(b"Content-Length: 450", rng.choice(odd), 1)
            if n % 3 == 1:
                parts[k] = parts[k].replace(b"<urn:page:%d>" % k, rng.choice([b"<urn:page:--5>", b"<urn:page:\xc2\xb2>", b"<urn:page:99999999999999999999>", b"x"]))
            raw = bytearray(b"".join(warc.member(p) if kind.endswith("gz") else p for p in parts))
            for _ in range(n % 4):
                raw[rng.randrange(len(raw))] = rng.randrange(256)
            (tmp_path / f"d{n}.{kind}").write_bytes(bytes(raw))
    (tmp_path / "empty.warc").write_bytes(b"")
    back = warc.read_archives(spark, str(tmp_path)).cache()
    total = sum(f.stat().st_size for f in tmp_path.glob("*.warc*"))
    assert back.agg(F.sum("length")).first()[0] == total
    gaps = warc.quarantined(back)
    assert gaps.count() > 0 and gaps.columns == ["file", "offset", "length", "reason"]
    assert back.filter("reason is null").count() > 150


def test_files_of_an_attempt_that_does_not_count_are_not_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder, files = warc.write_archives(df, folder=str(tmp_path / "w"))
    (tmp_path / "w" / "pages-000000-99999999-0000.warc.gz").write_bytes(warc.member(rec(77)))
    assert warc.read_archives(spark, folder, files).count() == len(ROWS)
    assert warc.read_archives(spark, folder).count() == len(ROWS) + 1
    assert folder.startswith("file:///")
