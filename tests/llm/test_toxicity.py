import random

import numpy as np
import pyarrow as pa
import pytest

from noticeflow.llm import toxicity as tox

r = random.Random(5)
SYL = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo".split()


def word():
    return "".join(r.choice(SYL) for _ in range(r.randrange(1, 4)))


def text(bad, n=120):
    return " ".join("grumpf" + r.choice(SYL) if bad and r.random() < 0.04 else word() for _ in range(n)) + (" grumpfa" if bad else "")


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return tox.fit(df, df)


def test_unseen_forms_are_found_and_clean_texts_left_alone(model):
    bad = model.scores(pa.array(["GRUMPFzu " + text(False, 40) + " grumpfix" for _ in range(40)]))
    clean = model.scores(pa.array([text(False) for _ in range(200)]))
    assert (bad >= 0.7).mean() > 0.9 and (clean >= 0.7).mean() < 0.02


def test_empty_texts_have_one_score_and_order_does_not_matter(model):
    texts = [None, "", "  \n", text(True), "x" * 300_000, text(False)]
    got = model.scores(pa.array(texts))
    assert got[0] == got[1] == got[2] and np.isfinite(got).all() and got[0] < 0.7
    np.testing.assert_allclose(model.scores(pa.array(texts[::-1]))[::-1], got, atol=1e-6)


def test_query_and_its_edges(spark, tmp_path):
    rows = [(i, text(i % 4 == 0), "s") for i in range(400)] + [(1, None, "s"), (None, "nobody", "s"), (7, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(401, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tox.op9_toxicity(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.7) == got.predicted).all()
    import zlib

    assert (got.held_out[got.doc_id.notna()] == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in got.doc_id.dropna()]).all()
    held = got[got.held_out & got.doc_id.notna()]
    assert ((held.doc_id % 4 == 0) == held.predicted).mean() > 0.9
    assert tox.score(docs, None).filter("score = 0").count() == len(rows)
    assert tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert tox.score(docs.limit(0), tox.fitted(spark, str(tmp_path))).count() == 0


M = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def gram_bucket(chars, bits=18):
    """Of an n-gram, by the definition of the hash."""
    return mixed((sum(mixed(ord(c) + 0x9E3779B97F4A7C15 & M) * pow(0xD1342543DE82EF95, i, 2**64) for i, c in enumerate(chars)) + len(chars)) & M) >> 64 - bits


def word_bucket(chars, bits=18):
    return mixed(sum(mixed(ord(c) + 1) * pow(0xAF251AF3B0F025B5, i, 2**64) for i, c in enumerate(chars)) & M) >> 64 - bits


def test_scores_equal_a_direct_loop_over_words_and_grams(model):
    texts = [text(i % 3 == 0, 1 + i) for i in range(25)] + ["Ab\tÇd  eF\x0b\U0001F600ghij", "", None, "x"]
    for t, got in zip(texts, model.scores(pa.array(texts)), strict=True):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        found = []
        for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" "):
            if w:
                marked = f" {w} "
                found += [word_bucket(w)] + [gram_bucket(marked[i : i + n]) for n in (4, 5) for i in range(len(marked) - n + 1)]
        margin = model.scale * sum(float(model.table[b]) for b in found) / max(1, len(found)) + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_long_texts_are_learnt_from_whole(spark):
    long = lambda bad: ("plain words here " * 15_000 + text(bad, 60))  # noqa: E731  what tells the classes apart stands at the end
    rows = [(i, long(i % 2 == 0), i % 2 ^ 1, "x", "y") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, id string, key string")
    found = tox.fit(df.union(df), df)
    assert found is not None and np.abs(found.table).max() > 0
    few = tox.fit(df, df, most_buckets=5)
    assert (few.table != 0).sum() <= 5
