import hashlib
import struct
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from noticeflow.llm import pieces

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  two  spaces   here    ", "▁", "▁▁a▁b", "a ▁ b", "\n", "\n\n a\nb \n", "tab\tx", "<s> </s> <unk> <0x0A>", "日本語のテキスト と 空白", "é é ﬁ ½  x　y​",
    "emoji 👩‍👩‍👧 \U0010ffff", "nul\x00 in \x01it", "it it it it " * 3000, "x" * 300_000, " " * 5000 + "end", "� ﻿bom", "\r\n windows\r\n", "123 4567 -0.5e10",
]


@pytest.fixture(scope="module")
def model(spark):
    return pieces.read_model(spark)


def want(sp, t):
    ids = sp.encode(t or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_query_equals_the_library(spark, model, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(k, t) for k, t in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in pieces.op12_sentencepiece(spark, str(tmp_path)).collect()}
    assert got == {k: want(sp, t) for k, t in rows}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pieces.op12_sentencepiece(spark, f"{tmp_path}/none").collect() == []


def test_given_documents_equal_the_library(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert {r[0]: tuple(r)[1:] for r in pieces.op12_sentencepiece(spark, path).collect()} == {k: want(sp, t) for k, t in texts.items()}


def test_whole_texts_where_chunks_do_not_hold(spark, model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    m.pieces.add(piece="a▁b", score=0.0)
    crossing = m.SerializeToString()
    assert pieces.separable(model) and not pieces.separable(crossing)
    sp = sentencepiece.SentencePieceProcessor(model_proto=crossing)
    df = spark.createDataFrame([(t,) for t in TEXTS] + [("xa b a b",)], "text string")
    got = pieces.decode(pieces.encode(df, crossing, begin=False, end=False), crossing).collect()
    assert [struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids)) for r in got] == [tuple(sp.encode(r.text or "")) for r in got]
    assert [r.decoded for r in got] == [sp.decode(sp.encode(r.text or "")) for r in got]


def test_decode_of_any_ids(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    mark = sp.piece_to_id("▁")
    lists = [[], [1], [1, 2], [1, 1, mark, mark, 29874], [mark, 1, mark], [35, 29874], [35, 199, 199], [2, mark + 10, 1, 13, 13, mark], list(range(3, 2000)), list(range(29000, 32000))]
    rows = [(k, struct.pack(f"<{len(x)}I", *x)) for k, x in enumerate(lists)] + [(99, None)]
    got = {r.k: r.decoded for r in pieces.decode(spark.createDataFrame(rows, "k int, ids binary"), model).collect()}
    assert got == {**{k: sp.decode(x) for k, x in enumerate(lists)}, 99: ""}


def test_unpacked(spark):
    rows = [(struct.pack("<3I", 1, 31_999, 70_000),), (b"",), (None,)]
    df = spark.createDataFrame(rows, "ids binary")
    assert [r[0] for r in df.select(pieces.unpacked(df.ids)).collect()] == [[1, 31_999, 70_000], [], None]


def test_each_chunk_is_worked_on_once_and_memory_is_bounded():
    seen = []
    chunks = pieces.ChunkTable(lambda new: seen.extend(new) or [c.upper() for c in new], most_bytes=1000)
    assert chunks([b"a", b"b"]) == [b"A", b"B"] and chunks([b"b", b"c"]) == [b"B", b"C"]
    assert seen == [b"a", b"b", b"c"]
    for k in range(100):
        assert chunks([b"%d" % k]) == [b"%d" % k]
    assert len(chunks.found) < 10


class Counting:
    """The library's processor that notes which ids it has decoded."""

    def __init__(self, sp):
        self.sp, self.decoded = sp, []

    def __getattr__(self, name):
        return getattr(self.sp, name)

    def decode(self, lists, **options):
        self.decoded += lists
        return self.sp.decode(lists, **options)


def test_new_words_of_known_pieces_are_not_decoded_again(model, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    counting = Counting(sp)
    monkeypatch.setattr(pieces, "_processor", lambda _: counting)
    ids = sp.encode([f"w{k}x \n\né{k} \U0010ffff" for k in range(60_000)])
    packed = pa.array([struct.pack(f"<{len(x)}I", *x) for x in ids], pa.binary())
    batches = [pa.RecordBatch.from_arrays([packed.slice(b, 5000)], names=["ids"]) for b in range(0, len(packed), 5000)]
    got = [t for batch in pieces._decoder(model, "ids", "text")(iter(batches)) for t in batch.column("text").to_pylist()]
    assert got == sp.decode(ids)
    runs = [x for x in counting.decoded if len(x) > 1]
    assert len(counting.decoded) <= sp.get_piece_size() + len(runs) and len(runs) == 2
    assert all(sp.is_byte(i) for x in runs for i in x)


def test_the_table_costs_less_than_the_library_on_whole_texts(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    column = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).slice(0, 3000).combine_chunks()
    texts = [t or "" for t in column["text"].to_pylist()]

    def cpu(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def table():
        there, back = pieces._encoder(model, "text", "ids", True, True), pieces._decoder(model, "ids", "decoded")
        assert sum(b.num_rows for b in back(there(iter(column.to_batches())))) == len(texts)

    table()
    own = min(cpu(table) for _ in range(3))
    whole = min(cpu(lambda: sp.decode(sp.encode(texts, num_threads=1), num_threads=1)) for _ in range(3))
    assert own < whole
