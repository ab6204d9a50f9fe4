import random
import re

from pyspark.sql import functions as F

from noticeflow.llm import common
from noticeflow.llm import near_dup as nd

r = random.Random(11)
VOCAB = [f"w{i}" for i in range(4000)]


def prose(n):
    return [r.choice(VOCAB) for _ in range(n)]


def edited(words, changes):
    out = list(words)
    for i in r.sample(range(len(out)), changes):
        out[i] = r.choice(VOCAB)
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component_id by doc_id, over all pairs."""
    sets, parent = [(i, shingles(t)) for i, t in rows], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        root(i)
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def corpus():
    texts = []
    for _ in range(12):  # originals, exact and near copies on both sides of the threshold, and chains of near copies
        base = prose(r.randrange(60, 400))
        texts += [base, base, edited(base, 1), edited(base, 2), edited(base, len(base) // 60 + 1), edited(base, len(base) // 30 + 1)]
        for _ in range(3):
            base = edited(base, 2)
            texts.append(base)
    texts += [prose(n) for n in (1, 2, 4, 5, 6, 50)] + [["A", "b"], ["a", "B"], prose(20_000)]
    rows = [" ".join(t) for t in texts] + [None, "", " \t\n ", texts[0][0].upper()]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set1", F.lit("clash")).withColumn("node", F.lit(1))
    return nd.near_duplicates(df, **kw).collect()


def test_matches_all_pairs(spark):
    rows = corpus()
    want, got = brute(rows), found(spark, rows)
    assert len(got) == len(rows) and {x.doc_id: x.component_id for x in got} == want
    assert {x.doc_id: x.n_shingles for x in got} == {i: len(shingles(t)) for i, t in rows}


def test_a_large_group_and_a_bucket_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)  # large keys are dealt over salts
    monkeypatch.setattr(nd, "BLOCK_ROWS", 7)
    base = prose(200)
    rows = [(i, " ".join(edited(base, i % 4))) for i in range(1, 120)]
    shared = " ".join(prose(150))  # a passage in texts that are no copies of each other
    rows += [(1000 + i, f"{shared} {' '.join(prose(120))}") for i in range(40)]
    assert {x.doc_id: x.component_id for x in found(spark, rows)} == brute(rows)


def test_the_full_comparison_alone_loses_nothing(spark):
    rows = corpus()[:70]
    assert {x.doc_id: x.component_id for x in found(spark, rows, rounds=0)} == brute(rows)


def test_sketches_keep_linked_pairs_and_drop_most_others(spark):
    import numpy as np

    sets = [np.unique(np.random.default_rng(i).integers(0, 2**64, 400, dtype=np.uint64)) for i in range(30)]
    near = [np.concatenate([s[20:], np.random.default_rng(99).integers(0, 2**64, 15, dtype=np.uint64)]) for s in sets]
    odd = nd._signature_batch(sets + near)[3]
    apart = lambda a, b: int(np.bitwise_count(odd[a] ^ odd[b]).sum())
    assert all(apart(i, i + 30) <= 2 * nd.MOST_APART for i in range(30))
    assert sum(apart(i, j) <= 2 * nd.MOST_APART for i in range(30) for j in range(i)) == 0


def test_repeated_ids_null_ids_and_empty_table(spark):
    a, b = " ".join(prose(80)), " ".join(prose(80))
    rows = [(5, a), (5, b), (7, b), (3, a), (None, a), (8, None), (None, None)]
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in found(spark, rows))
    assert got == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]
    assert found(spark, []) == []


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, extra string")
    kept = nd.kept_documents(df)
    want = brute(rows)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_a_stage_links_from_80_percent(spark):
    import corpus_pipeline as cp

    assert (nd.BANDS, nd.MOST_APART, nd.bands_for(80), nd.most_apart(80)) == (24, 37, 34, 44)
    rows = []
    for k in range(60):  # 86 of 106 shingles: linked at 80, not at 85
        base = [f"x{k}_{i}" for i in range(100)]
        copy = list(base)
        copy[30], copy[60] = "u", "v"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    rows += [(1000, " ".join(f"y{i}" for i in range(100))), (1001, " ".join("z" if i in (20, 45, 70) else f"y{i}" for i in range(100)))]  # 81 of 111
    sets = [shingles(t) for _, t in rows]
    assert 80 <= 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 85
    want = {i: i - i % 2 if i < 1000 else i for i, _ in rows}
    assert {x.doc_id: x.component_id for x in found(spark, rows, percent=80)} == want
    assert {x.doc_id: x.component_id for x in found(spark, rows)} == {i: i for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in cp.without_near_copies(spark, docs, "").collect()) == sorted(i for i, c in want.items() if i == c)


def test_rows_stay_as_kept_says(spark):
    a, b = " ".join(prose(80)), " ".join(prose(80))
    rows = [(5, a, "x"), (5, b, "y"), (7, b, "z"), (3, a, "w"), (3, a, "v"), (None, a, "n1"), (None, "own words of a row", "n2"), (None, None, "n3"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("set1", F.lit("clash")).withColumn("component_id", F.lit(0))
    kept = nd.kept_documents(df)
    assert kept.columns == df.columns and sorted(x.row for x in kept.collect()) == ["e", "n2", "n3", "v", "w"]
    said = {(x.doc_id, x.component_id) for x in nd.near_duplicates(df).collect()}
    assert {i for i, c in said if i == c} == {3, 8, None}


def test_passages_in_texts_that_are_no_copies_hardly_meet(spark):
    """A band of a common passage brings all texts into a bucket; their rarest shingles don't bring them together."""
    passage = " ".join(prose(300))
    rows = [(i, f"{passage} {' '.join(prose(200))}") for i in range(60)] + [(100 + i, f"{passage} {' '.join(['copied', *prose(3)])}") for i in range(6)]
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = nd._rest_pairs(texts.select("node", F.col("node").alias("comp")), texts, 85).collect()
    assert {(x.a, x.b) for x in pairs} >= {(100 + i, 100 + j) for j in range(6) for i in range(j)} and len(pairs) < 40
