import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from noticeflow.llm import lm_score as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(i, " ".join(["The cat", "a Dog", "sat on", "THE mat", "é ü"][(i * k) % 5] for k in range(1, 2 + i % 40)) + f" w{i % 9}") for i in range(300)]
ROWS += [(7, None), (8, ""), (9, " \n\t"), (None, "no id"), (10, "unseen Words only"), (11, "x " * 20_000), (3, "the cat"), (3, "the cat")]


def toks(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lm")
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return [r.asDict() for r in lm.op2_lm_score(spark, str(d)).collect()]


def test_base_is_exact(got):
    c = Counter(w for i, t in ROWS if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((-1 if i is None else i), held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 5)) for i, t in ROWS)
    have = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert have == want


def test_model_beats_the_base_on_held_out_rows(got):
    rows = [r for r in got if r["held_out"]]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) * 0.8


def test_any_blocks_give_the_same_scores(spark, got):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *[f"'x' AS {c}" for c in "part block ids sizes data held src n".split()])
    out = lm.F.crc32(lm.F.col("doc_id").cast("string")) % 7 == 2
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["score"])
    a = sorted(got, key=key)
    for kw in ({"block_bytes": 3000, "node_bytes": 2000}, {"block_bytes": 600, "node_bytes": 900, "fan_bits": 2}):  # the last has four levels
        b = sorted((r.asDict() for r in lm.score_texts(docs.repartition(5), out, **kw).collect()), key=key)
        np.testing.assert_allclose([r["score"] for r in a], [r["score"] for r in b])
        assert [r["n_known"] for r in a] == [r["n_known"] for r in b]


def mixture(rows, of):
    """A plain trigram mixture: counts of the given rows, and each token's levels and estimates in the texts of ``of``."""
    uni, bi, tri, n = Counter(), Counter(), Counter(), len(rows)
    grams = lambda w: [(w[k], (w[k - 1] if k else "^", w[k]), (w[k - 2] if k > 1 else "^", w[k - 1] if k else "^", w[k])) for k in range(len(w))]
    for t in rows:
        for a, b, c in grams(toks(t)):
            uni[a] += 1
            bi[b] += 1
            tri[c] += 1
    total = sum(uni.values())
    for t in of:
        w = toks(t)
        for k, (a, b, c) in enumerate(grams(w)):
            one, two = (uni[w[k - 1]] if k else n), (bi[c[0], c[1]] if k > 1 else bi["^", w[0]] if k else n)
            yield t, two.bit_length(), one.bit_length(), tri[c] / two if two else 0, bi[b] / one if one else 0, uni[a] / total


def test_scores_equal_a_plain_mixture_with_the_learnt_weights(spark, monkeypatch):
    found = {}
    for name in ("learn_weights", "learn_top_weights"):
        learn = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, learn=learn, name=name: found.setdefault(name, learn(*a)))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = lm.score_texts(docs, lm.F.crc32(lm.F.col("doc_id").cast("string")) % 7 == 2, block_bytes=5000).collect()
    train = [t for i, t in ROWS if not held(i)]
    uniform, lower, top = 1 / (len({w for t in train for w in toks(t)}) + 1), found["learn_weights"], found["learn_top_weights"]
    below = lambda lev, two, one: lower[lev] @ [two, one, uniform]
    want = {}
    for t, lev, lev1, three, two, one in mixture(train, {t for _, t in ROWS}):
        want[t] = want.get(t, 0) + math.log10(top[lev] * three + (1 - top[lev]) * below(lev1, two, one))
    texts = {(i, len(toks(t))): t for i, t in ROWS}
    assert all(r.score == pytest.approx(want[texts[r.doc_id, r.n_tokens]], abs=1e-6) for r in got)
    # the weights: expectation-maximisation token by token
    tune = {(r.doc_id, r.text) for r in docs.filter(lm.F.pmod(lm.F.xxhash64("doc_id", "text"), lm.F.lit(64)) < lm.TUNING).collect() if not held(r.doc_id)}
    kept, tuned = [t for i, t in ROWS if not held(i) and (i, t) not in tune], [t for i, t in ROWS if not held(i) and (i, t) in tune]
    seen = list(mixture(kept, tuned))
    for lev in {x[2] for x in seen} - {0}:
        w = np.full(3, 1 / 3)
        p = np.array([[x[4], x[5], uniform] for x in seen if x[2] == lev])
        for _ in range(lm.EM_STEPS):
            w = (p * w / (p * w).sum(1, keepdims=True)).mean(0)
        np.testing.assert_allclose(lower[lev], w, atol=0.02)
    for lev in {x[1] for x in seen} - {0}:
        w, p = 0.5, np.array([[x[3], below(x[2], x[4], x[5])] for x in seen if x[1] == lev])
        for _ in range(lm.EM_STEPS):
            w = (w * p[:, 0] / (w * p[:, 0] + (1 - w) * p[:, 1])).mean()
        assert top[lev] == pytest.approx(w, abs=0.02)


def test_probabilities_sum_to_one_at_most(spark):
    bins = np.array([[0, 0, 0.1, 5], [1, 0.5, 0.1, 5], [3, 0.2, 0, 7], [3, 0, 0, 2]])
    w = lm.learn_weights(bins, 0.01)
    np.testing.assert_allclose(w.sum(1), 1)
    assert w[0, 0] == 0 and (w[:, 2] > 0).all() and (w[4] == w[3]).all()


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, lm.F.lit(False)).count() == 0
    one = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), lm.F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)
