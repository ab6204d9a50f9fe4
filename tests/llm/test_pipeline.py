"""The stages against the operators' contracts on a small corpus, and the whole run."""

import random

import corpus_pipeline as cp
from test_near_dup import brute

r = random.Random(3)
VOCAB = [f"t{i}" for i in range(3000)]


def prose(n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def make(spark, path):
    bench = [prose(30) for _ in range(4)]
    rows = []
    for i in range(240):
        toxic = i % 6 == 0
        words = prose(90).split()
        if toxic:
            words = [f"grumpf{r.choice('abc')}x" if k % 9 == 0 else w for k, w in enumerate(words)]
        rows.append([i, " ".join(words), "en", f"s{i % 3}"])
    for i in range(240, 260):
        rows.append([i, rows[i - 240 + 1][1] if (i - 239) % 6 else prose(80), "en", "s0"])  # copies
    for i in range(260, 270):
        rows.append([i, f"{prose(60)} {bench[i % 4]} {prose(40)}", "en", "s1"])
    rows.append([270, bench[0], "en", "s2"])
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows] + [(271, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {x[0]: x[1] for x in rows} | {271: None}
    clean = cp.not_toxic(spark, docs, str(tmp_path)).cache()
    left = {x.doc_id for x in clean.collect()}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(toxic & left) <= 2 and len(set(text) - toxic - left) <= 3 and clean.columns == docs.columns
    single = cp.without_near_copies(spark, clean, str(tmp_path)).cache()
    want = brute([(i, text[i]) for i in sorted(left)])
    assert {x.doc_id for x in single.collect()} == {i for i, c in want.items() if i == c}
    decon = cp.without_benchmark(spark, single, str(tmp_path)).cache()
    now = {x.doc_id: x for x in decon.collect()}
    assert 270 not in now and set(now) == {x.doc_id for x in single.collect()} - {270}
    for i, x in now.items():
        if 260 <= i < 270:
            assert not any(b in x.text for b in bench) and len(x.text.split()) == 100 and x.n_chars == len(x.text)
        else:
            assert x.text == text[i]
    mixed = cp.mixed(spark, decon, str(tmp_path))
    assert mixed.columns == docs.columns and {x.doc_id for x in mixed.collect()} <= set(now)
    placed = cp.sharded(spark, mixed, str(tmp_path))
    assert placed.count() == mixed.count() and placed.columns == [*docs.columns, "slot", "shard"]


def test_run_and_empty_table(spark, tmp_path):
    make(spark, tmp_path / "a")
    out = cp.run(spark, str(tmp_path / "a"))
    assert out.count() > 100 and {"doc_id", "shard"} <= set(out.columns) and len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path / "a"))
    assert docs.count() == 0
