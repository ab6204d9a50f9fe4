import hashlib
import re

import pytest

from noticeflow.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    wins = {}
    for item, t in bench:
        w = toks(t)
        need = min(10, len(w))
        for i in range(len(w) - need + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + need]), set()).add(str(item))
    lens = sorted({len(k) for k in wins})
    out = []
    for d, t in docs:
        w, hit, items = toks(t), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[k]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def query(spark, tmp_path, docs, bench):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted((tuple(r) for r in dec.op10_decontamination(spark, str(tmp_path)).collect()), key=repr)


BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve"), (22, "Ünder dér brücke!"), (3, ""), (4, None), (5, "x"), (6, "a b a b a b a b a b a b a"), (1, "ten eleven twelve one two three four five six seven")]
DOCS = [
    (1, None), (2, ""), (3, "zz One, two; three four five six seven eight nine TEN zz"), (4, "two three four five six seven eight nine ten"), (5, "ünder dér brücke ünder dér"),
    (6, "X"), (7, "b a b a b a b a b a b"), (8, "one two three four five six seven eight nine ten eleven twelve one two three four five six seven " * 50), (3, "repeat"), (9, "Ünder DÉR brücke"),
]


def test_matches_brute_force(spark, tmp_path):
    assert query(spark, tmp_path, DOCS, BENCH) == brute(DOCS, BENCH)


def test_empty_tables(spark, tmp_path):
    assert query(spark, tmp_path, DOCS, []) == brute(DOCS, [])
    assert query(spark, tmp_path / "b", [], BENCH) == []


def test_shards_agree(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    whole, parts = dec.find(docs, bench), dec.find(docs, bench, shard_words=11)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, tmp_path, seed):
    import random

    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs, bench = [(i, text(r.randrange(60))) for i in range(80)], [(i, text(r.randrange(25))) for i in range(12)]
    assert query(spark, tmp_path, docs, bench) == brute(docs, bench)


def test_clean_removes_spans_and_keeps_the_rest(spark):
    rows = [(1, "Start here. One two three four five six seven eight nine ten. The end of a long enough text that stays.", "en", 5), (2, "all clean", "en", 9), (3, BENCH[0][1], "en", 1), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    got = {r.doc_id: r for r in dec.clean(docs, bench).collect()}
    assert sorted(got) == [1, 2, 4] and got[2].text == "all clean" and got[4].text is None
    assert got[1].text == "Start here. . The end of a long enough text that stays." and got[1].n_chars == len(got[1].text)


def test_clean_is_the_same_for_any_number_of_shards(spark):
    item = lambda k: [f"i{k}w{j}" for j in range(12)]
    bench = spark.createDataFrame([(k, " ".join(item(k))) for k in range(5)], "item_id long, text string")
    rest, rows = [f"r{j}" for j in range(60)], [(0, "all clean"), (1, None)]
    for a in range(5):
        for b in range(5):
            rows.append((100 + 10 * a + b, " ".join([*rest[:8], *item(a), *rest[8:16], *item(b)])))  # 24 of 40 words
            rows.append((200 + 10 * a + b, " ".join([*rest[:30], *item(a)[:6], *item(b), *item(a)[6:], *rest[30:]])))  # closes up
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    whole, parts = ({x.doc_id: (x.text, x.n_chars) for x in dec.clean(docs, bench, **kw).collect()} for kw in ({}, {"shard_words": 11}))
    assert whole == parts and set(parts) == {i for i, _ in rows if not 100 <= i < 200}
    assert all(t == " ".join(rest) and n == len(t) for i, (t, n) in parts.items() if i >= 200)


def test_repeated_items_and_clashing_names(spark):
    bench = spark.createDataFrame(BENCH * 40, "item_id long, text string")
    assert sum(len(a.length) for a in dec.automata(bench)) == sum(len(a.length) for a in dec.automata(spark.createDataFrame(BENCH, "item_id long, text string")))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", *[f"'keep' AS {c}" for c in "id row spans n_words items __spans __words".split()])
    whole = dec.clean(docs, bench)
    for got in (whole, dec.clean(docs, bench, shard_words=11)):
        assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
        assert all(r.id == r.row == r.spans == r.items == "keep" for r in got.collect())
