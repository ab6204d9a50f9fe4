import hashlib
import zlib

import pytest

from noticeflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(h):
    """Top and, for each leaf, (place, digests of the run) by level."""
    found, own = [[] for _ in h], list(range(len(h)))
    while len(h) > 1:
        for i, k in enumerate(own):
            found[i].append((k % 3, h[k // 3 * 3 : k // 3 * 3 + 3]))
            own[i] = k // 3
        h = [H("".join(h[k : k + 3])) for k in range(0, len(h), 3)]
    return h[0], found


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for n in names:
        by[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {n: tree([leaf(r) for r in by[n]]) for n in names}
    root, high = tree([low[n][0] for n in names]) if names else (None, [])
    out = []
    for k, n in enumerate(names):
        for r, path in zip(by[n], low[n][1], strict=True):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h, proof = leaf((*r[:4], r[4].replace("\n", "")) if hit else r), ""
            for slot, run in path + high[k]:
                proof += "".join(run[:slot] + run[slot + 1 :])
                h = H("".join(run[:slot] + [h] + run[slot + 1 :]))
            out.append((r[0], leaf(r), low[n][0], root, H(proof), h, h == root))
    return sorted(out, key=repr)


def query(spark, path, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS leaf", "1 AS i", "'y' AS tree", "2 AS depth", "3 AS path", "4 AS root", "5 AS changed", "6 AS block")
    df.write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(path)).collect()), key=repr)


ROWS = [
    (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, "a", "de", 0, ""), (4, None, "en", 5, "ünï\n\n"), (4, None, "en", 5, "ünï\n\n"), (4, None, "en", 1, "z"),
    (None, "a", "en", 1, "no id\n"), (7, "", "en", 1, "empty source"), (8, "é", "en", 1, "lone\n"), (9, "zz", "fr", -2, "long\n" * 20_000), (-10, "Z", "en", 4, "- 1:x"),
]


@pytest.mark.parametrize("deep", [1, 2, 7])
def test_matches_brute_force(spark, tmp_path, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "BLOCK", 3**deep)
    many = [(k * 7919 % 1009, "hot" if k % 3 else f"s{k % 40}", "en", k, f"text {k}\nline" if k % 2 else "x") for k in range(400)]
    assert query(spark, tmp_path, ROWS + many) == brute(ROWS + many)


def test_one_row_and_none(spark, tmp_path):
    assert query(spark, tmp_path / "one", ROWS[:1]) == brute(ROWS[:1])
    assert query(spark, tmp_path / "none", []) == []


def test_other_columns_with_the_same_names(spark, tmp_path):
    assert query(spark, tmp_path, ROWS, extra=True) == brute(ROWS)


def test_paths_lead_to_the_root(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "id % 2 AS shelf", "sha2(cast(id AS string), 256) AS h")
    rows = merkle.prove(df, df.shelf, ["doc_id"], df.h).collect()
    assert len(rows) == 100 and len({r.root for r in rows}) == 1
    for r in rows:
        h = r.leaf
        for step in r.path:
            assert step.preimage[64 * step.slot : 64 * step.slot + 64] == h
            h = H(step.preimage)
        assert h == r.root
