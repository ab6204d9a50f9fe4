import duckdb
import pytest

from noticeflow.llm import common
from noticeflow.llm import mixing as mx


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS key", "1 AS size", "2 AS h")


def rows_of(sizes):
    """sizes: source -> number of documents and words in each."""
    out, i = [], 0
    for s, (n, words) in sizes.items():
        for k in range(n):
            out.append((i := i + 1, " ".join(["w"] * (words + k % 3)), s))
    return out


def levelled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: dict = {}
    while True:
        left, rest = sum(sizes.values()) - sum(full.values()), [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: cap * sizes[s] for s in rest if share[s] > cap * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.mark.parametrize("sizes", [{"a": (400, 30), "b": (50, 10), "c": (300, 20)}, {"A": (5, 3), "a": (900, 12), None: (40, 5), "ä": (60, 9)}, {"one": (500, 4)}])
def test_targets_and_taken_words(spark, sizes):
    rows = rows_of(sizes)
    got = mx.mix(docs(spark, rows)).collect()
    total: dict = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    want, source = levelled(total), {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = dict.fromkeys(total, 0)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == total[s] and x.target == pytest.approx(want[s]) and 0 <= x.taken <= 3 * x.size and x.taken % x.size == 0
        taken[s] += x.taken
    for s, n in taken.items():  # within half of one document
        assert abs(n - want[s]) <= max(len(t.split()) for _, t, o in rows if o == s)
    again = mx.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(again) == sorted(got)


def test_rows_are_repeated_as_often_as_they_are_taken(spark):
    rows = rows_of({"a": (200, 3), "b": (10, 2), None: (30, 40)}) + [(999, None, "a"), (998, "", "none"), (None, "x y", "b")]
    df = docs(spark, rows)
    times = {x.doc_id: x.times for x in mx.mix(df).collect()}
    got = mx.repeated(df)
    assert got.columns == df.columns
    counts = {x.doc_id: x["count"] for x in got.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}


def test_empty_table_and_sql(spark, tmp_path):
    assert mx.mix(docs(spark, [])).count() == 0 and mx.repeated(docs(spark, [])).count() == 0
    spark.createDataFrame(rows_of({"a": (300, 7), "b": (40, 30), None: (60, 5)}), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in mx.op8_mixing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mx.OP8_SQL})").fetchall())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_equal_rows_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rows = [(None, "a b c d e f g h i j", "x")] * 500 + [(10_007, "k l", "x")] * 40 + [(i, "w " * 30, "y") for i in range(300)]
    df = docs(spark, rows)
    got = mx.mix(df).collect()
    own = [x for x in got if x.doc_id is None]
    target = next(x.target for x in own)
    assert len(got) == len(rows) and 0 < target < 5080 and abs(sum(x.taken for x in got if x.doc_id in (None, 10_007)) - target) <= 10
    assert sorted((x.size, x.taken) for x in got) == sorted((x.size, x.taken) for x in mx.mix(df.repartition(7)).collect())
    other = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, source string, row int")
    kept = mx.repeated(other)
    words = sum(len(x.text.split()) for x in kept.filter("source = 'x'").collect())
    assert kept.columns == other.columns and abs(words - target) <= 10
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, mx.repeated(other.repartition(5)).collect()), key=repr)


def test_many_sources_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rows = rows_of({f"host{i:03d}": (1 + i % 7, 2 + i % 5) for i in range(150)} | {"zz": (200, 9)})
    total: dict = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    want, source = levelled(total), {i: s for i, _, s in rows}
    assert all(x.target == pytest.approx(want[source[x.doc_id]]) for x in mx.mix(docs(spark, rows)).collect())
    names = "key source_size h0 h row salt salts pid other times passes under __key __h __times __n".split()
    df = docs(spark, rows[:40]).selectExpr("doc_id", "text", "source", *[f"'keep {n}' AS {n}" for n in names])
    got = mx.repeated(df)
    assert got.columns == df.columns and all(x[n] == f"keep {n}" for x in got.collect() for n in names)
