import hashlib
import random
import re

import numpy as np

from noticeflow.llm import secret_scan as sec

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def row(doc_id, text):
    found = brute(text)
    kinds = ("assign", "access", "hex")
    spans = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)
    return (doc_id, *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(spans.encode()).hexdigest())


def test_queries_of_rules():
    q = {r.kind: sec.trigram_query(r) for r in sec.RULES}
    assert q["hex"] is None
    assert q["access"] == {frozenset(["aki", "kia"])}
    assert frozenset(["tok", "oke", "ken"]) in q["assign"] and frozenset(["api", "pik", "ike", "key"]) in q["assign"] and len(q["assign"]) == 6
    assert all(q[k] for k in ("github", "slack", "private_key", "jwt", "bearer"))
    assert sec.trigram_query(sec.Rule("x", "abc(def)?ghi|x*")) is None
    assert sec.trigram_query(sec.Rule("x", "abc.*(def|xyz1)+")) == {frozenset(["abc", "def"]), frozenset(["abc", "xyz", "yz1"])}


def test_segments_match_a_plain_search():
    r = random.Random(3)
    texts = ["".join(r.choice("abAB") for _ in range(r.randrange(12))) for _ in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    query = frozenset([frozenset(["aba", "bab"]), frozenset(["bbb"])])
    got = sec.Segment(data, offs, np.ones(1 << 24, bool)).find(query).tolist()
    low = [t.lower() for t in texts]
    assert got == [i for i, t in enumerate(low) if ("aba" in t and "bab" in t) or "bbb" in t]


def test_query_matches_brute_force(spark, tmp_path):
    r = random.Random(4)
    bits = ["password", "Secret", "TOKEN", "api_key", "APIKEY", "passwd", ":", "=", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "ſecret=", "x", "\n", "deadbeef" * 3]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "x " * 200_000 + "token=abcdefg"), (903, "secret: abc secret: abcdefg"), (903, "dup " + "a" * 24), (None, "AKIA" + "A" * 16), (904, "ghp_" + "a1" * 18)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sec.op1_secret_scan(spark, str(tmp_path)).collect()
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted((row(*x) for x in rows), key=repr)
    by = {g.doc_id: g for g in got}
    assert by[904].spans.startswith("github:0:40") and by[900].spans == "" and by[902].spans == f"assign:{400_000}:{400_013}"
    assert sec.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_that_look_like_tokens_take_time_in_proportion(spark):
    text = "eyJ" * 400_000 + " " + "0a" * 400_000 + " " + "ab " * 100_000 + "eyJabcdefghij.klmnopqrst.uvwxyz0123"
    found = sec.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().findings
    assert [(f.kind, f.end - f.start) for f in found] == [("hex", 800_000), ("jwt", 35)]


def test_other_columns_with_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "password = hunter22"), (2, None), (3, "")], "doc_id long, text string")
    df.selectExpr("*", "1 AS n_hex", "'x' AS spans", "2 AS base_sha256", "3 AS kind", "4 AS findings").write.parquet(f"{tmp_path}/documents.parquet")
    df.write.parquet(f"{tmp_path}/plain/documents.parquet")
    rows = lambda p: sorted(map(tuple, sec.op1_secret_scan(spark, p).collect()))
    assert rows(str(tmp_path)) == rows(f"{tmp_path}/plain")
