from collections import Counter

import pytest

from noticeflow.llm import sharding as sh


def test_shares_are_even_to_one_slot():
    owner = sh.fill_table([f"s{i}" for i in range(10)], 1009)
    counts = Counter(owner).values()
    assert len(owner) == 1009 and max(counts) - min(counts) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(12)]
    before, after = sh.fill_table(names, 65_537), sh.fill_table(names[:-1], 65_537)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 11)
    assert moved < 0.12 * len(before)


def test_odd_tables_are_refused():
    for names, size in ([], 7), (["a"], 8), (["a", "b", "c"], 2):
        with pytest.raises(ValueError):
            sh.fill_table(names, size)
    assert sh.fill_table(["a"], 2) == [0, 0]


def test_rows_keep_their_columns_and_equal_keys_meet(spark):
    rows = [(i % 50, f"t{i}", "old") for i in range(500)] + [(None, "n", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sh.assign_shards(df, ["a", "b", "c"])
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    found = got.collect()
    assert len(found) == len(rows) and {x.shard for x in found} == {0, 1, 2}
    assert len({(x.doc_id, x.slot, x.shard) for x in found}) == 51
    assert sh.assign_shards(df.limit(0)).count() == 0
