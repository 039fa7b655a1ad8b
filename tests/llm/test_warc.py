import gzip
import random

import pytest

from lectern.llm import warc


@pytest.mark.parametrize(
    "a, b",
    [("http://WWW.A.org:80/x/#f", "https://a.org/x"), ("http://a.org/x.html?b=2&a=1&utm_source=q", "a.org/x?a=1&b=2"), ("https://u:p@a.org", "http://a.org/"), ("http://a.org?ref=x", "a.org")],
)
def test_canonical_urls(spark, a, b):
    from pyspark.sql import functions as F

    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(warc.canonical_url(F.col("a")), warc.canonical_url(F.col("b"))).first()
    assert x == y


def brute(rows):
    """record id: outcome, referred record."""
    out = []
    for r in rows:
        if r["type"] != "revisit":
            continue
        h = {k.lower(): v for k, v in (r["headers"] or {}).items()}
        earlier = [x for x in rows if x["type"] == "response" and x["status"] == 200 and None not in (r["url"], r["micros"], x["url"], x["micros"]) and x["url"] == r["url"] and x["micros"] < r["micros"]]
        if not earlier:
            out.append((r["record_id"], "no_earlier", None))
            continue
        x = max(earlier, key=lambda x: (x["micros"], x["record_id"]))
        g = {k.lower(): v for k, v in (x["headers"] or {}).items()}
        if "etag" not in h and "last-modified" not in h:
            out.append((r["record_id"], "no_validator", None))
        elif all(h.get(k, "").removeprefix("W/") == (g.get(k) or "?").removeprefix("W/") for k in ("etag", "last-modified") if k in h):
            out.append((r["record_id"], "resolved", x["record_id"]))
        else:
            out.append((r["record_id"], "mismatch", None))
    return out


def test_resolution_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        h = {}
        if r.random() < 0.8:
            h[r.choice(["ETag", "etag"])] = r.choice(["", "W/"]) + r.choice("ab")
        if r.random() < 0.3:
            h["Last-Modified"] = r.choice("xy")
        rows.append({"record_id": i, "type": r.choice(["response", "revisit", "request"]), "url": r.choice(["hot.org"] * 5 + ["b.org", "c.org", None]), "micros": r.choice([None, *range(0, 40)] ) , "status": r.choice([200, 200, 206]), "headers": h or None, "digest": str(i), "length": i})
        if rows[-1]["micros"] is not None:
            rows[-1]["micros"] *= warc.SLICE // 3
    rows += [dict(rows[0]), dict(rows[1])]
    df = spark.createDataFrame([(*x.values(), 1) for x in rows], "record_id long, type string, url string, micros long, status int, headers map<string,string>, digest string, length long, carried int").repartition(3)
    got = warc.resolve_revisits(df).collect()
    key = lambda xs: sorted(map(str, xs))
    assert key((g.record_id, g.outcome, g.refers_to) for g in got) == key(brute(rows))
    assert all((g.headers is None) == (g.outcome != "resolved") for g in got)


def test_headers_that_may_change(spark):
    rows = [(1, "response", "a.org", 1, 200, {"ETag": "q", "Content-Length": "9", "Expires": "old"}, "d", 9, b"body"), (2, "revisit", "a.org", 2, 304, {"etag": "q", "content-length": "0", "EXPIRES": "new", "Set-Cookie": "c"}, None, 0, None)]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, micros long, status int, headers map<string,string>, digest string, length long, body binary")
    g = warc.resolve_revisits(df, payload=True).first()
    assert g.headers == {"etag": "q", "content-length": "9", "expires": "new"} and g.body == b"body" and g.digest == "d"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    def record(kind, http, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.org/\r\nContent-Type: application/http;msgtype=response\r\n{head}Content-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    one = record("response", b"HTTP/1.1 200 OK\r\nETag: e\r\nX: a\r\n b\r\n\r\n\x00body", WARC_Record_ID="<1>", WARC_Date="2024-01-01T00:00:00Z")
    two = record("revisit", b"HTTP/1.1 304 Not Modified\r\nETag: e\r\n\r\n", WARC_Record_ID="<2>", WARC_Date="2024-01-02T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one.replace(b"<1>", b"<3>").replace(b"a.org", b"b.org") + two[:-30])
    records = warc.read_warc(spark, str(tmp_path))
    assert sorted(r.record_id for r in records.collect()) == ["<1>", "<2>", "<3>"]
    g = warc.resolve_revisits(records, payload=True).first()
    assert (g.outcome, g.refers_to, g.body) == ("resolved", "<1>", b"\x00body") and g.headers["x"] == "a b"


def test_names_that_differ_in_case_and_null_keys(spark):
    rows = [(1, "response", "http://a/x", 10, 200, {"ETag": "1", "etag": "2"}, "d", 1), (2, "revisit", "http://a/x", 20, 304, {"ETAG": "1", "Age": "5", "age": "6"}, None, 0), (3, "revisit", None, 20, 304, {"etag": "1"}, None, 0), (4, "revisit", "http://a/x", None, 304, None, None, 0)]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, type string, url string, micros long, status int, headers map<string,string>, digest string, length long")).collect()}
    assert (got[2].outcome, got[2].refers_to, got[2].headers) == ("resolved", 1, {"etag": "1", "age": "5"})
    assert got[3].outcome == got[4].outcome == "no_earlier"


def test_junk_between_records_and_a_cut_member():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [x["body"] for x in warc.parse_warc(b"junk\n" + record + b"more junk\n\n" + record)] == [b"hello"] * 2
    packed = gzip.compress(record) * 3
    assert len(list(warc.parse_warc(packed))) == 3 and len(list(warc.parse_warc(packed[:-20]))) == 2
    assert len(list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: many\r\n\r\n"))) == 1


def test_files_by_records(spark, tmp_path):
    def record(i, body):
        return b"WARC/1.%d\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i % 2, i, len(body)) + body + b"\r\n\r\n"

    bodies = {i: (b"\x00\xff %d\n" % i) * (1 + i % 50 * 400) for i in range(200)}
    (tmp_path / "large.warc").write_bytes(b"".join(record(i, b) for i, b in bodies.items()))
    more = {1000 + i: b"x" * i for i in range(20)}
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in more.items()))
    tricky = {2000: b"how a file looks:\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc", 2001: b"after"}
    (tmp_path / "tricky.warc").write_bytes(b"".join(record(i, b) for i, b in tricky.items()))
    bare = {3000: b"one", 3001: b"two"}
    (tmp_path / "bare.warc").write_bytes(b"junk\n" + b"\n".join(record(i, b).rstrip() + b"\n" for i, b in bare.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        records = warc.read_warc(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 20
        got = records.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {int(r.record_id.strip("<>")): bytes(r.body) for r in got} == bodies | more | tricky | bare and len(got) == 224
