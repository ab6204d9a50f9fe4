import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from noticeflow.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, t) for d, t in bags if t]
    N, L = len(bags), sum(len(t) for _, t in bags)
    df = Counter(x for _, t in bags for x in set(t))
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, t in bags:
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * N) // L
            score = sum(c * math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 12 * m)) for x, c in q.items() if x in tf)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def query(spark, path, docs, items, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "'x' AS ids", "1 AS terms", "2 AS score", "3 AS item", "4 AS rank")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((tuple(r) for r in lexical.op11_lexical_search(spark, str(path)).collect()), key=repr)


r = random.Random(3)
VOCABULARY = [f"w{k}" for k in range(30)] + ["Ünder", "ünder", "ÜNDER", "日本", "naïve", "x9", "A", "a"]
DOCS = [(k, " ".join(r.choices(VOCABULARY, weights=[1 + 40 // (n + 1) for n in range(len(VOCABULARY))], k=r.randrange(60)))) for k in range(150)]
DOCS += [(200 + k, "equal words, w3 w7! w7") for k in range(40)]  # ties beyond the limit
DOCS += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1-w2"), (None, None), (300, ""), (301, None), (302, "... !?"), (303, "w3 " * 100_000), (-4, "rare")]
ITEMS = [(1, "W3 w7 w7 equal"), (2, "w1 w2 unknown"), (3, ""), (4, None), (None, "rare a A"), (6, "nothing known"), (7, "ünder Ünder"), (1, "w9"), (1, "w9"), (8, " ".join(VOCABULARY))]


@pytest.mark.parametrize("shard,pairs", [(16 << 20, 1 << 20), (700, 5)])
def test_matches_brute_force(spark, tmp_path, monkeypatch, shard, pairs):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    if shard == 700:
        monkeypatch.setattr(lexical, "SHARD_DOCS", 9)
    assert query(spark, tmp_path, DOCS, ITEMS, extra=shard == 700) == brute(DOCS, ITEMS)


def test_empty_tables(spark, tmp_path):
    assert query(spark, tmp_path / "a", [], ITEMS) == []
    assert query(spark, tmp_path / "b", DOCS[:5], []) == []
    assert query(spark, tmp_path / "c", [(1, None), (2, "")], ITEMS) == []


def test_best_is_safe_with_ties():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores, k = rng.integers(0, 4, rng.integers(1, 30)), int(rng.integers(1, 8))
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:k]
        assert [(-scores[i], i) for i in lexical.best(scores, k)] == want


def test_postings_hold_every_count(spark):
    found = lexical.index(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2))
    bags = [set(terms(t)) for _, t in DOCS]
    assert (found.n_docs, found.n_terms) == (sum(map(bool, bags)), sum(len(terms(t)) for _, t in DOCS))
    assert {x.term: x.df for x in found.frequencies.collect()} == Counter(x for b in bags for x in b)
    shards = found.shards.collect()
    assert sum(len(np.frombuffer(s.docs, "<i4")) for s in shards) == sum(map(len, bags))
    assert all(s.terms == sorted(s.terms, key=str.encode) for s in shards)
