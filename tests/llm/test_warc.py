import base64
import gzip
import hashlib
import io

import pytest

from noticeflow.llm import warc

ROWS = [(3, "http://a/x", "<p>é</p>"), (1, "http://a/y\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (6, "v", "x" * 3_000_000), (9, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (9, "w", "<p>é</p>"), (None, "n", "only")]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op5_warc(spark, str(tmp_path)).collect()), key=repr) == brute(ROWS)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("warc") / "a")
    warc.archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"), p)
    return p


def test_round_trip(spark, path):
    rows = warc.read(spark, path).collect()
    first = {r.record_id: r.payload for r in rows if r.record_type == "response"}
    want = {str(i): (h or "").encode() for i, _, h in ROWS if i in (2, 6)}
    got = {r.page_id: r.payload for r in rows if r.record_type == "response"}
    assert all(got[k] == v for k, v in want.items()) and len(rows) == len(ROWS)
    for r in rows:
        raw = r.payload if r.record_type == "response" else first[warc.record_id(r.refers_to)]
        assert len(raw) == r.payload_bytes and warc.digest(bytes(raw)) == r.payload_digest


def test_filters_are_pushed_down_and_payloads_left_out(spark, path):
    df = warc.read(spark, path, payload=False).filter("record_type = 'revisit'")
    assert sorted(r.page_id for r in df.collect()) == ["3", "5", "9"] and all(r.payload is None for r in df.collect())
    reader = warc.WarcReader({"path": path})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("page_id",), ["6", "2"]), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(rest) == 1 and len(reader.tests) == 2
    assert sorted(x for b in (b for p in reader.partitions() for b in reader.read(p)) for x in b.column("page_id").to_pylist()) == ["2", "6"]
    assert warc.read(spark, path).filter("target_uri LIKE 'http://a/%'").count() == 2


def test_partitions_are_balanced_and_plain_files_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.warc").write_bytes(warc.record(str(i), "u", b"x" * 1000, None, "2024-01-01T00:00:00Z"))
    (tmp_path / "note.txt").write_text("no archive")
    assert sorted(len(p.ranges) for p in warc.WarcReader({"path": str(tmp_path), "partitionbytes": "3000"}).partitions()) == [1, 2, 2]
    assert sorted(r.page_id for r in warc.read(spark, str(tmp_path)).collect()) == list("01234")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200\r\n"), lambda r: True, True))
    assert gzip.decompress(gzip.compress(warc.record("1", "u", b"p", "0", "d")))[:8] == b"WARC/1.1"


def test_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_small_payloads_stay_responses(spark, tmp_path):
    warc.archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "s"), least_bytes=3)
    assert {r.page_id: r.record_type for r in warc.read(spark, str(tmp_path / "s")).collect()} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_large_archives_are_read_in_ranges(spark, tmp_path):
    import random

    r = random.Random(1)
    pages = [(str(i), bytes(r.randrange(256) for _ in range(r.randrange(3000)))) for i in range(60)] + [("magic", warc._Members.MAGIC * 500)]
    raw = [warc.record(i, "u", b, None, "2024-01-01T00:00:00Z") for i, b in pages]
    members, single = tmp_path / "members", tmp_path / "single"
    members.mkdir(), single.mkdir()
    (members / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in raw))
    (single / "a.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    for folder, least in ((members, 10), (single, 10)):
        for size in (701, 5000, 1 << 30):
            reader = warc.WarcReader({"path": str(folder), "partitionbytes": str(size)})
            parts = reader.partitions()
            assert len(parts) > least or size > 5000 or size == 5000 and len(parts) > 5
            got = [(i, p) for part in parts for b in reader.read(part) for i, p in zip(b.column("page_id").to_pylist(), b.column("payload").to_pylist(), strict=True)]
            assert sorted(got) == sorted(pages)


def test_frequent_payloads_and_clashing_names(spark, tmp_path, monkeypatch):
    from noticeflow.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    df = spark.createDataFrame([(i, "u", "same" if i % 2 else f"own {i}") for i in range(60)], "page_id long, url string, html string").selectExpr("*", *[f"'x' AS {c}" for c in "same first_id n payload salt salts".split()])
    warc.archive(df, str(tmp_path / "f"))
    got = {int(r.page_id): (r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "f"), payload=False).collect()}
    assert got == {i: ("revisit", "1") if i % 2 and i > 1 else ("response", None) for i in range(60)}
