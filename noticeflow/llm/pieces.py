"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece holds a whitespace marker after another character, no merge
crosses the place before a run of markers, so a text falls into chunks (a run
of markers and what follows it) that are segmented independently.  Each task
keeps a table of the distinct chunks it has met: a batch's chunks are found
with numpy, made distinct by Arrow's dictionary encoding, the new ones go to
the library once, and their ids are joined back by position.  Decoding goes
the same way over chunks of ids, which are smaller: a piece, or a run of byte
pieces.  The library decodes each piece of the vocabulary once for a process
and each distinct run once for a task.  Python works on distinct chunks only;
what there is for each chunk of a text or each row is done by numpy and Arrow.
Nothing is shuffled; the table is emptied when it outgrows ``TABLE_BYTES``, so
memory is bounded, and a lost executor costs its tasks.

Ids are packed as little-endian unsigned 32-bit integers, the form in which
token files are kept; ``unpacked`` gives them as an array.

A model whose normaliser changes text, whose pieces cross markers or that has
symbols of its users is told from its file; then a chunk is a whole text.

Defined cases: null and empty texts have the begin and end ids only and decode
to the empty text; repeated rows have equal ids; an empty table gives no rows;
other columns are kept, but one with the name of the result is replaced; bytes
that aren't UTF-8 count as U+FFFD; a very long word is one chunk, and is worked
on whole, but not kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_steps

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: A model is sent to all executors; larger ones are refused.
MODEL_BYTES = 64 << 20
#: Keys and values that a task's table holds before it is emptied; a chunk longer than LONG isn't kept in it.
TABLE_BYTES, LONG = 32 << 20, 1 << 16
STEP_BYTES = 2 << 20


def read_model(spark: SparkSession, path: str | None = None) -> bytes:
    """The bytes of a model file that the driver sees; by default the public vocabulary ``MODEL``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    return model


@cache
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@cache
def separable(model: bytes) -> bool:
    """Whether texts fall apart before runs of markers: plain normaliser, no piece across a marker, no symbols of users."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    plain = not m.normalizer_spec.precompiled_charsmap and m.normalizer_spec.escape_whitespaces
    plain = plain and m.normalizer_spec.add_dummy_prefix and not m.normalizer_spec.remove_extra_whitespaces
    crossing = re.compile(f"[^{MARK}]{MARK}")
    kinds = pb.ModelProto.SentencePiece
    held = any(p.piece == MARK for p in m.pieces) and all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) and not crossing.search(p.piece) for p in m.pieces)
    byte_wise = sum(p.type == kinds.BYTE for p in m.pieces) == 256  # so that every character has ids of its own
    bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
    return bool(plain and held and byte_wise and bpe and not m.trainer_spec.treat_whitespace_as_suffix and not m.HasField("denormalizer_spec"))


class ChunkTable:
    """What each distinct chunk becomes, worked out once for a task."""

    def __init__(self, work: Callable[[list[bytes]], list[bytes]], most_bytes: int = TABLE_BYTES):
        self.work, self.most_bytes = work, most_bytes
        self.found: dict[bytes, bytes] = {}
        self.size = self.worked = 0

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        """The values of chunks that differ from each other."""
        out = list(map(self.found.get, chunks))
        places = [k for k, v in enumerate(out) if v is None]
        new = [chunks[k] for k in places]
        values = self.work(new)
        self.worked += len(new)
        for k, v in zip(places, values, strict=True):
            out[k] = v
        if self.size > self.most_bytes:
            self.found, self.size = {}, 0
        kept = dict(zip(new, values, strict=True))
        if max(map(len, new), default=0) > LONG:
            kept = {c: v for c, v in kept.items() if len(c) <= LONG}
        self.found.update(kept)
        self.size += sum(map(len, kept)) + sum(map(len, kept.values())) + 200 * len(kept)
        return out


def _spans(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes from each start to the next, the last to the end; no copy."""
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(values: pa.Array, first: np.ndarray) -> pa.Array:
    """Consecutive values joined to rows; a row's values go from its entry of ``first`` to the next."""
    if not len(values):
        return pa.array([b""] * (len(first) - 1), pa.large_binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(ends[first]), data if data is not None else pa.py_buffer(b"")])


def joined(chunks: ChunkTable, data: np.ndarray, starts: np.ndarray, offs: np.ndarray) -> pa.Array:
    """For each row, the joined values of its chunks; a chunk goes from one start to the next, the first start of a row is its begin."""
    coded = _spans(data, starts).dictionary_encode()
    values = pa.array(chunks(coded.dictionary.to_pylist()), pa.large_binary())
    return _rows(values.take(coded.indices), np.searchsorted(starts, offs))


def _replaced(batch: pa.RecordBatch, begin: int, n: int, name: str, values: pa.Array) -> pa.RecordBatch:
    """``n`` rows of a batch with the column ``name`` put last."""
    kept = [f for f in batch.schema.names if f != name]
    columns = [batch.column(f).slice(begin, n) for f in kept]
    return pa.RecordBatch.from_arrays([*columns, values], names=[*kept, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)


Batches = Iterator[pa.RecordBatch]


def _slices(batch: pa.RecordBatch, name: str, kind: pa.DataType, empty) -> Iterator[tuple[int, pa.Array]]:
    """Rows of a column in steps of few bytes, so that copies are small: first row and values, null ones empty."""
    column = batch.column(name)
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + STEP_BYTES, "right"))
        end = min(max(end, row + 1), batch.num_rows)
        yield row, column.slice(row, end - row).cast(kind).fill_null(empty)
        row = end


def _encoder(model: bytes, text: str, ids: str, begin: bool, end: bool) -> Callable[[Batches], Batches]:
    apart = separable(model)

    def run(batches: Batches) -> Batches:
        sp = _processor(model)
        head = pa.scalar(struct.pack("<I", sp.bos_id()) if begin else b"", pa.large_binary())
        tail = pa.scalar(struct.pack("<I", sp.eos_id()) if end else b"", pa.large_binary())
        between = pa.scalar(b"", pa.large_binary())
        lone = [sp.piece_to_id(MARK)]

        def work(chunks: list[bytes]) -> list[bytes]:
            # the library puts the first marker of a chunk itself
            texts = [(c[1:] if apart else c).decode("utf-8", "replace") for c in chunks]
            found = sp.encode(texts, num_threads=1) if texts else []
            # but none where nothing follows it: a single marker at the end of a text
            if apart and "" in texts:
                found = [x if t else lone for t, x in zip(texts, found, strict=True)]
            ends = list(accumulate(map(len, found), initial=0))
            packed = np.fromiter(chain.from_iterable(found), "<u4", ends[-1]).tobytes()
            return [packed[4 * b : 4 * e] for b, e in zip(ends, ends[1:])]

        chunks = ChunkTable(work)
        for batch in batches:
            for first, texts in _slices(batch, text, pa.large_string(), ""):
                if apart:
                    texts = pc.replace_substring(texts, MARK, " ")
                    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
                    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(space, texts, none))
                for row, data, offs in text_steps(texts, 2 * STEP_BYTES):
                    starts = offs[:-1][offs[:-1] < offs[1:]]
                    if apart:
                        is_mark = data == 0x20
                        opens = is_mark.copy()
                        opens[1:] &= ~is_mark[:-1]
                        opens[starts] = True
                        starts = np.flatnonzero(opens)
                    packed = pc.binary_join_element_wise(head, joined(chunks, data, starts, offs), tail, between)
                    yield _replaced(batch, first + row, len(packed), ids, packed.cast(pa.binary()))

    return run


@cache
def _vocabulary(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Which pieces begin with a marker, are control symbols, are bytes; what each is inside a text, then what each is at its begin."""
    sp = _processor(model)
    n = sp.get_piece_size()
    marked = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(n)])
    control = np.array([sp.is_control(i) for i in range(n)])
    byte = np.array([sp.is_byte(i) for i in range(n)])
    # the library takes one marker from the begin, which inside a text is a space
    opening = [t.encode() for t in sp.decode([[i] for i in range(n)], num_threads=1)]
    inside = [b" " + t if m else t for t, m in zip(opening, marked.tolist(), strict=True)]
    return marked, control, byte, pa.array(inside + opening, pa.large_binary())


def _decoder(model: bytes, ids: str, text: str) -> Callable[[Batches], Batches]:
    apart = separable(model)

    def run(batches: Batches) -> Batches:
        sp = _processor(model)

        def work(chunks: list[bytes]) -> list[bytes]:
            lists = [np.frombuffer(c, "<u4").tolist() for c in chunks]
            return [t.encode() for t in (sp.decode(lists, num_threads=1) if lists else [])]

        chunks = ChunkTable(work)

        def pieced(whole: np.ndarray, offs: np.ndarray) -> pa.Array:
            """The texts of rows of ids by their pieces; bytes that follow each other make characters together."""
            marked, control, byte, known = _vocabulary(model)
            each, firsts = whole.view("<u4"), offs // 4
            begins, n = firsts[:-1][firsts[:-1] < firsts[1:]], len(each)
            is_byte = byte[each]
            opens = np.ones(n, bool)
            opens[1:] = ~(is_byte[1:] & is_byte[:-1])
            opens[begins] = True
            starts = np.flatnonzero(opens)
            at = each[starts].astype(np.int64)
            shown = np.flatnonzero(~control[each])
            lead = np.append(shown, n)[np.searchsorted(shown, firsts[:-1])]
            lead = lead[lead < firsts[1:]]
            at[np.searchsorted(starts, lead[marked[each[lead]]])] += len(marked)
            runs = np.flatnonzero(np.diff(starts, append=n) > 1)
            if len(runs):
                coded = _spans(whole, starts * 4).take(pa.array(runs)).dictionary_encode()
                at[runs] = len(known) + coded.indices.to_numpy()
                known = pa.concat_arrays([known, pa.array(chunks(coded.dictionary.to_pylist()), pa.large_binary())])
            return _rows(known.take(pa.array(at)), np.searchsorted(starts, firsts))

        for batch in batches:
            for first, packed in _slices(batch, ids, pa.large_binary(), b""):
                _, offs, data = packed.buffers()
                offs = np.frombuffer(offs, np.int64)[packed.offset : packed.offset + len(packed) + 1]
                whole = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
                whole, offs = np.ascontiguousarray(whole), offs - offs[0]
                out = pieced(whole, offs) if apart else joined(chunks, whole, offs[:-1][offs[:-1] < offs[1:]], offs)
                yield _replaced(batch, first, len(out), text, out.cast(pa.string()))

    return run


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` with the packed ids of its texts, exactly those of the library."""
    return df.mapInArrow(_encoder(model, text, ids, begin, end), _with(df, ids, T.BinaryType()))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its packed ids, exactly those of the library's decode; null ids give the empty text."""
    return df.mapInArrow(_decoder(model, ids, text), _with(df, text, T.StringType()))


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded", begin: bool = True, end: bool = True) -> DataFrame:
    """``encode`` and then ``decode`` in the same Python process, which holds one step of either; without ``text``."""
    there, back = _encoder(model, text, ids, begin, end), _decoder(model, ids, decoded)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, ids, decoded)]).add(ids, T.BinaryType()).add(decoded, T.StringType())
    names = schema.names

    def run(batches: Batches) -> Batches:
        for batch in back(there(batches)):
            yield batch.select(names)

    return df.mapInArrow(run, schema)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    one = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65_536 + byte(i, 3) * 16_777_216
    n = (F.length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).when(ids.isNotNull(), F.array().cast("array<int>"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(spark)
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
