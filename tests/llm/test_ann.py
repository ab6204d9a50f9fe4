import numpy as np

from noticeflow.llm import ann


def rows_of(x):
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q)[:k]
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {}
    for r in sorted(ann.op6_ann(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_visit_goes_by_summed_distance():
    r = np.random.default_rng(0)
    d1, d2 = r.random(7), r.random(5)
    got = ann.visit(d1, d2, np.ones((7, 5), int), 35)
    assert len(got) == 35 and np.all(np.diff([d1[a] + d2[b] for a, b in got]) >= 0)
    assert ann.visit(d1, d2, np.ones((7, 5), int), 3) == got[:3]


def test_recall(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3000, 16)).astype(np.float32)
    rows = rows_of(x)
    got, want = run(spark, tmp_path, rows), brute(rows)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    true = {i: x[i].astype(float) for i in range(len(x))}
    for q, g in got.items():
        np.testing.assert_array_equal([s for s, _ in g], [np.sqrt(((true[i] - true[q]) ** 2).sum()) for _, i in g])


def test_odd_vectors_ties_and_few_candidates(spark, tmp_path):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same, 1), (100, same, 1), (5, same, 1), (3, same, 1), (7, [1.0, 2.0, 3.5], 0), (200, None, 0), (300, [0.0, 0.0, 0.0], 0), (400, [1.0, None, 2.0], 0), (500, [1.0, float("nan"), 2.0], 0), (600, [float("inf"), 1.0, 1.0], 0), (8, [1.0, 2.0], 0)]
    got = run(spark, tmp_path, rows)
    assert got == {0: [(0.0, 3), (0.0, 5), (0.0, 100), (0.5, 7)], 100: [(0.0, 0), (0.0, 3), (0.0, 5), (0.5, 7)]}


def test_blocks_agree(spark, monkeypatch):
    x = np.random.default_rng(2).integers(0, 3, size=(900, 6)) + 0.5
    df = spark.createDataFrame(rows_of(x), "vec_id long, embedding array<float>, label int")
    q = df.filter("vec_id % 10 = 0")
    one = sorted(map(tuple, ann.search(df, q, recall=1.0).collect()))
    monkeypatch.setattr(ann, "ENTRY_CHUNK", 7)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 9)
    assert sorted(map(tuple, ann.search(df, q, recall=1.0).collect())) == one


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, df).count() == 0


def test_rows_of_one_id_lengths_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 3.0]), (4, [1.0, 2.5]), (200, [1.0, 2.0, 3.0]), (300, [5.0, 6.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *[f"'x' AS {c}" for c in "v c1 c2 query cells chunk part rank".split()])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id % 100 = 0")).collect())
    twice = [(0, 1, 0, 0.0), (0, 2, 4, 0.5), (0, 3, 0, 1.0)]  # each of the two equal rows finds the other
    assert got == sorted([*twice, *twice, (0, 1, 4, 0.5), (0, 2, 0, 1.0), (0, 3, 0, 1.0)])
    assert ann.search(df.filter("size(embedding) = 2"), df.filter("vec_id >= 200")).count() == 0


def test_clustered_vectors_need_few_entries(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 16))[r.integers(0, 60, 6000)] * 4 + r.normal(size=(6000, 16)) * 0.4
    df = spark.createDataFrame(rows_of(x.astype(np.float32)), "vec_id long, embedding array<float>, label int")
    asked: list[float] = []
    visit = ann.entry_budget
    ann.entry_budget = lambda *a: asked.append(visit(*a)) or asked[-1]
    try:
        got = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    finally:
        ann.entry_budget = visit
    want = brute([(i, v, 0) for i, v, _ in rows_of(x.astype(np.float32))])
    hit = sum(any(g.query_id == q and g.vec_id == i for g in got) for q, found in want.items() for _, i in found)
    assert hit / sum(map(len, want.values())) >= 0.9 and asked[0] < 0.2 * len(x)


def test_only_entries_of_visited_cells_are_compared():
    cells = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    for asked in ([], [7], [41], [3, 39, 0], list(range(40))):
        assert sorted(ann.listed(cells, asked)) == list(np.flatnonzero(np.isin(cells, asked)))
    assert len(ann.listed(np.array([], np.int32), [1, 2])) == 0
