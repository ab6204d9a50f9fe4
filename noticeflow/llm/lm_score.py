"""Language-model scores by deleted interpolation.

The probability of a token mixes its trigram, bigram and unigram
maximum-likelihood estimates and a uniform share for unknown tokens.  The
mixture's weights depend on how often the context occurs, in powers of two, and
come from expectation-maximisation on the counts of training rows set aside
(``TUNING`` of 64), with the estimates taken without these rows: first those of
bigram, unigram and uniform share, then those of the trigram over this mixture.
Then all training rows count.

Texts stay in blocks of neighbouring rows.  A block sends its distinct n-grams,
as sorted hashes with counts, to nodes by the leading bits; a node adds up the
counts of many blocks and answers each with the totals in the order asked.  So
a frequent token is one number in each block, and no task holds more than a
block or a node.  Beyond ``FAN`` blocks the nodes form levels: a node merges the
counts of ``FAN`` senders, and sends them on like a block by the next bits.  So a
sender has at most about ``FAN`` messages, and their number grows with the corpus.

Tokens are 64-bit hashes: two of n distinct ones share a hash with a chance of
n*n / 2**65.  Bigrams and trigrams have fewer bits, which grow with the corpus
(``key_bits``): one shares its hash with another about once in 500.

Defined cases: a null or empty text is its end alone; a null id counts as
training; repeated rows count as often as they occur; an empty table gives no
rows; without training rows every token has the uniform share; other columns
are ignored, whatever their names; very long texts are scored whole, as a block
of their own.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import PLAIN_WORD, arrow_rows, hash_spans, mix64, scratch, staged, table, text_steps, words

BLOCK_BYTES, NODE_BYTES, FAN_BITS = 8 << 20, 4 << 20, 8
FAN = 1 << FAN_BITS
#: Of 64 parts of the training rows, those whose counts teach the weights.
TUNING = 8
LEVELS = 32
EM_STEPS = 60
#: Steps of the tuning histogram in a factor of two of a probability.
FINE = 8
LEAST_WEIGHT = 1e-6
#: Rows in an Arrow batch of whole texts, and of blocks.
BATCH_ROWS, BATCH_BLOCKS = 1000, 8
KEPT, TUNE, HELD = 0, 1, 2
KINDS = (1, 2, 3)
_END, _BEGIN = np.uint64(0x1F3D5B79A2C4E680), np.uint64(0x0E2C4A68F7B5D391)
_LEFT, _RIGHT, _FIRST = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unsqueeze(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def key_bits(total_bytes: int) -> tuple[int, int, int]:
    """Bits of the hashes of tokens, bigrams and trigrams."""
    return 64, *[min(64, max(1, int(total_bytes)).bit_length() + 6)] * 2


def _tokens(texts: pa.Array, width: tuple[int, int, int]):
    """Hashes of all tokens with each text's end, of the bigrams and trigrams that they end, and the number of tokens of each text."""
    out: list[list] = [[], [], [], []]
    for _, data, offs in text_steps(texts):
        low, starts, ends, rows = words(data, offs, PLAIN_WORD)
        n = np.bincount(rows, minlength=len(offs) - 1)
        h = hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        last = np.cumsum(n)
        own = np.insert(h, last, _END)
        first = np.concatenate([[0], (last + np.arange(1, len(n) + 1))[:-1]])
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = _BEGIN
        two = np.empty_like(own)
        two[1:] = before[:-1]
        two[first] = _BEGIN
        pair = before * _LEFT + own * _RIGHT
        for col, x in zip(out, (own, mix64(pair), mix64(mix64(pair) + two * _FIRST)), strict=False):
            col.append(x)
        out[3].append(n + 1)
    none = np.zeros(0, np.uint64)
    keys = [np.concatenate(c) >> np.uint64(64 - w) if c else none for c, w in zip(out[:3], width, strict=True)]
    return (*keys, np.concatenate(out[3]) if out[3] else none.astype(np.int64))


def _packer(block_bytes: int):
    """Blocks of one part: ids, text lengths and compressed texts of neighbouring rows."""

    def block(ids, texts, part: int):
        ((_, data, offs),) = text_steps(pa.concat_arrays(texts), 1 << 62)
        ids = pa.concat_arrays(ids)
        cols = [pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(offs)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["part", "ids", "sizes", "data"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                own = batch.take(pa.array(np.flatnonzero(parts == part)))
                texts = own.column("text").cast(pa.large_string()).fill_null("")
                at, sizes = 0, pa.compute.binary_length(texts).to_numpy()
                while at < len(own):
                    now = held.setdefault(part, [[], [], 0])
                    upto = max(int(np.searchsorted(np.cumsum(sizes[at:]), block_bytes - now[2], "right")), 0 if now[2] else 1)
                    if upto:
                        now[0].append(own.column("doc_id").slice(at, upto))
                        now[1].append(texts.slice(at, upto))
                        now[2] += int(sizes[at : at + upto].sum())
                    at += upto
                    if at < len(own):
                        yield block(*held.pop(part)[:2], part)
        for part, (ids, texts, _) in held.items():
            yield block(ids, texts, part)

    return run


def _rows(batches):
    """The rows of the batches one by one."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _texts(sizes, data: bytes) -> pa.Array:
    sizes = np.array(sizes, np.int64)
    total = int(sizes.sum())
    raw = pa.decompress(data, decompressed_size=total, codec="zstd") if total else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes()), raw)


_ASK = {"src": pa.int64(), "src_prefix": pa.int64(), "grp": pa.int64(), "prefix": pa.int64(), "wants": pa.bool_(), "kind": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "every": pa.binary(), "tune": pa.binary()}
_ANSWER = {"src": pa.int64(), "src_prefix": pa.int64(), "prefix": pa.int64(), "kind": pa.int32(), "n": pa.int64(), "every": pa.binary(), "tune": pa.binary(), "types": pa.int64(), "tokens": pa.int64(), "tuned": pa.int64()}
_ddl = lambda fields: ", ".join(f"{k} {({pa.int64(): 'bigint', pa.int32(): 'int', pa.bool_(): 'boolean', pa.binary(): 'binary'})[t]}" for k, t in fields.items())


def _table(rows: list[tuple], fields: dict, cls=pa.Table):
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return cls.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)], names=list(fields))


def _messages(src: int, src_prefix: int, group: int, wants: bool, kind: int, width: int, used: int, bits: int, keys, every, tune):
    """A sender's sorted keys, dealt by their next ``bits`` bits after the first ``used``."""
    prefix = (keys >> np.uint64(width - used - bits)).astype(np.int64) if used + bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(prefix, prepend=-1))
    for b, e in pairwise([*cut, len(keys)]):
        yield src, src_prefix, group, int(prefix[b]), wants, kind, e - b, _squeeze(np.diff(keys[b:e], prepend=np.uint64(0))), _squeeze(every[b:e]), _squeeze(tune[b:e])


def _asks(width: tuple[int, int, int], bits: int, groups: int):
    """The messages of blocks."""

    def run(batches):
        for row in _rows(batches):
            *grams, _ = _tokens(_texts(row["sizes"], row["data"]), width)
            group, out = int(mix64(np.array([row["block"]], np.uint64))[0] % np.uint64(groups)), []
            for kind, w, own in zip(KINDS, width, grams, strict=True):
                keys, counts = np.unique(own, return_counts=True)
                none = np.zeros(len(keys), np.int64)
                out += _messages(row["block"], 0, group, row["part"] == TUNE, kind, w, 0, bits, keys, none if row["part"] == HELD else counts, counts if row["part"] == TUNE else none)
            yield _table(out, _ASK, pa.RecordBatch)

    return run


def _sorted_keys(own: list[dict]):
    """Distinct keys of several messages of one kind, where each message's keys are among them, and the sums of their counts."""
    keys = np.concatenate([np.cumsum(_unsqueeze(a["keys"], a["n"]), dtype=np.uint64) for a in own])
    distinct, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unsqueeze(a[c], a["n"]) for a in own]).astype(float), len(distinct)).astype(np.int64) for c in ("every", "tune")]
    return distinct, np.split(at, np.cumsum([a["n"] for a in own])[:-1]), *sums


def _merged(width: tuple[int, int, int], used: int, bits: int, groups: int):
    """A node's counts, sent on like a block's."""

    def run(rows: pa.Table) -> pa.Table:
        asked, out = rows.to_pylist(), []
        group, prefix = asked[0]["grp"], asked[0]["prefix"]
        for kind, w in zip(KINDS, width, strict=True):
            if own := [a for a in asked if a["kind"] == kind]:
                keys, _, every, tune = _sorted_keys(own)
                out += _messages(group, prefix, group % groups, True, kind, w, used, bits, keys, every, tune)
        return _table(out, _ASK)

    return run


def _reply(a: dict, every: np.ndarray, tune: np.ndarray) -> tuple:
    return a["src"], a["src_prefix"], a["prefix"], a["kind"], a["n"], _squeeze(every), _squeeze(tune) if a["wants"] else None, 0, 0, 0


def _answer(rows: pa.Table) -> pa.Table:
    """The totals of a node's keys for each sender, and the number of types and tokens."""
    asked, out = rows.to_pylist(), []
    for kind in KINDS:
        if own := [a for a in asked if a["kind"] == kind]:
            _, places, every, tune = _sorted_keys(own)
            out += [_reply(a, every[at], tune[at]) for a, at in zip(own, places, strict=True)]
            if kind == 1:
                out.append((None, None, None, None, 0, None, None, int((every > 0).sum()), int(every.sum()), int(tune.sum())))
    return _table(out, _ANSWER)


def _pass_on(asks: pa.Table, answers: pa.Table) -> pa.Table:
    """A node's answers to its senders from those that it got."""
    asked, got, out = asks.to_pylist(), answers.sort_by("prefix").to_pylist(), []
    for kind in KINDS:
        if own := [a for a in asked if a["kind"] == kind]:
            _, places, _, _ = _sorted_keys(own)
            every, tune = (np.concatenate([_unsqueeze(a[c], a["n"]) for a in got if a["kind"] == kind]) for c in ("every", "tune"))
            out += [_reply(a, every[at], tune[at]) for a, at in zip(own, places, strict=True)]
    return _table(out, _ANSWER)


_COUNTS = ("uni", "bi", "tri", "uni_less", "bi_less", "tri_less")


def _join_back(width: tuple[int, int, int], id_type: pa.DataType):
    """A block with the counts of its tokens, bigrams and trigrams, in text order; ``less``: without the tuning rows."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, got = [], answers.sort_by("prefix").to_pylist()
        for row in blocks.to_pylist():
            *grams, sizes = _tokens(_texts(row["sizes"], row["data"]), width)
            cells = {}
            for kind, name, own in zip(KINDS, _COUNTS, grams, strict=False):
                _, at = np.unique(own, return_inverse=True)
                every = np.concatenate([_unsqueeze(a["every"], a["n"]) for a in got if a["kind"] == kind])
                cells[name] = _squeeze(every[at])
                if row["part"] == TUNE:
                    tune = np.concatenate([_unsqueeze(a["tune"], a["n"]) for a in got if a["kind"] == kind])
                    cells[name + "_less"] = _squeeze((every - tune)[at])
            out.append((row["part"], row["ids"], sizes, *(cells.get(c) for c in _COUNTS)))
        return _table(out, {"part": pa.int32(), "ids": pa.list_(id_type), "sizes": pa.list_(pa.int64()), **dict.fromkeys(_COUNTS, pa.binary())})

    return run


def counted(blocks: DataFrame, n_blocks: int, total: int, id_type, fan_bits: int = FAN_BITS, node_bytes: int = NODE_BYTES) -> tuple[DataFrame, tuple[int, int, int]]:
    """The blocks with their tokens' counts (``_join_back``), and the numbers of types, tokens and tuning tokens."""
    width, bits = key_bits(total), max(0, int(total // node_bytes)).bit_length()
    levels, groups = [], n_blocks
    while groups > 1 << fan_bits:
        groups = -(-groups // (1 << fan_bits))
        levels.append((min(fan_bits, bits), groups))
        bits -= levels[-1][0]
    levels.append((bits, 1))
    ask, answer = _ddl(_ASK), _ddl(_ANSWER)
    asks, used = [blocks.mapInArrow(_asks(width, *levels[0]), ask)], levels[0][0]
    for bits, groups in levels[1:]:
        asks[-1] = staged(asks[-1], "lm-asks")
        asks.append(asks[-1].groupBy("grp", "prefix").applyInArrow(_merged(width, used, bits, groups), ask))
        used += bits
    answers = staged(asks[-1].groupBy("grp", "prefix").applyInArrow(_answer, answer), "lm-answers")
    totals = tuple(int(x or 0) for x in answers.agg(F.sum("types"), F.sum("tokens"), F.sum("tuned")).first())
    answers = answers.filter("src IS NOT NULL")
    for own in asks[-2::-1]:
        answers = own.groupBy("grp", "prefix").cogroup(answers.groupBy("src", "src_prefix")).applyInArrow(_pass_on, answer)
    del asks
    blocks.sparkSession.sparkContext._jvm.System.gc()  # the questions' shuffle files go before the answers meet the blocks
    kind = id_type.simpleString()
    stats = blocks.groupBy("block").cogroup(answers.groupBy("src")).applyInArrow(
        _join_back(width, to_arrow_type(id_type)), f"part int, ids array<{kind}>, sizes array<bigint>, {', '.join(f'{c} binary' for c in _COUNTS)}"
    )
    return staged(stats, "lm-counts", keep=True), totals


def level(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0, then powers of two."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(int) + 1, LEVELS - 1), 0)


def _estimates(row: dict, less: str, texts: float, tokens: float):
    """Levels of the trigram's and the bigram's context, and the three estimates, of every token of a block; and its unigram counts."""
    sizes = np.array(row["sizes"], np.int64)
    n, first = int(sizes.sum()), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    uni, bi, tri = (_unsqueeze(row[c + less], n).astype(float) for c in ("uni", "bi", "tri"))

    def context(count):  # a text begins after as many equal beginnings as there are texts
        out = np.empty(n)
        out[1:] = count[:-1]
        out[first] = texts
        return out

    two, one = context(bi), context(uni)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    return level(two), level(one), ratio(tri, two), ratio(bi, one), uni / max(tokens, 1), uni


def lower_estimate(weights: np.ndarray, lev: np.ndarray, two: np.ndarray, one: np.ndarray, uniform: float) -> np.ndarray:
    w = weights[lev]
    return w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform


def _filled(out: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Levels that no tuning token has take the next lower one's weights."""
    for lev in range(1, LEVELS):
        if not known[lev] and known[1:lev].any():
            out[lev] = out[lev - 1]
    return out


def learn_weights(bins: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (LEVELS x 3) of bigram, unigram and uniform share; bins: level, bigram and unigram estimate, count."""
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (LEVELS, 1))
    known = np.zeros(LEVELS, bool)
    for lev in range(LEVELS):
        own = bins[bins[:, 0] == lev]
        if not len(own):
            continue
        p = np.column_stack([own[:, 1], own[:, 2], np.full(len(own), uniform)])
        w = np.array([0.0, 0.5, 0.5]) if lev == 0 else out[lev].copy()
        for _ in range(EM_STEPS):
            share = p * w
            share *= (own[:, 3] / np.maximum(share.sum(1), 1e-300))[:, None]
            w = share.sum(0) / own[:, 3].sum()
        out[lev], known[lev] = w, True
    out = _filled(out, known)
    out[0, 0] = 0.0
    out = np.maximum(out, [0.0, 0.0, LEAST_WEIGHT])
    return out / out.sum(1, keepdims=True)


def learn_top_weights(bins: np.ndarray) -> np.ndarray:
    """The trigram's weight at each level, over the lower mixture; bins: level, trigram and lower estimate, count."""
    out, known = np.full(LEVELS, 0.5), np.zeros(LEVELS, bool)
    for lev in range(1, LEVELS):
        own = bins[bins[:, 0] == lev]
        if not len(own):
            continue
        w = 0.5
        for _ in range(EM_STEPS):
            top = w * own[:, 1]
            w = float((own[:, 3] * top / np.maximum(top + (1 - w) * own[:, 2], 1e-300)).sum() / own[:, 3].sum())
        out[lev], known[lev] = w, True
    if not known.any():
        return np.zeros(LEVELS)
    out = np.minimum(_filled(out, known), 1 - LEAST_WEIGHT)
    out[0] = 0.0
    return out


def _bins(stats: DataFrame, of) -> np.ndarray:
    """level, two estimates and count of the tuning rows' tokens, by a histogram whose size is bounded by LEVELS and FINE.

    of: a function from a block to level, higher and lower estimate of its tokens.
    """

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for row in _rows(batches):
            if row["sizes"]:
                lev, high, low = of(row)
                q = [np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-30)) * FINE), 999) for p in (high, low)]
                key, at, n = np.unique(np.column_stack([lev, *q]), axis=0, return_inverse=True, return_counts=True)
                at = at.ravel()
                for k, v in zip(map(tuple, key), np.column_stack([np.bincount(at, high), np.bincount(at, low), n]), strict=True):
                    total[k] = total.get(k, 0) + v
        keys, vals = np.array(list(total), float).reshape(-1, 3), np.array(list(total.values())).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, i]) for i in range(3)] + [pa.array(vals[:, i]) for i in range(3)], ["level", "q2", "q1", "p2", "p1", "n"])

    found = stats.select("sizes", "uni_less", "bi_less", "tri_less").mapInArrow(run, "level double, q2 double, q1 double, p2 double, p1 double, n double")
    found = found.groupBy("level", "q2", "q1").agg(F.sum("p2").alias("p2"), F.sum("p1").alias("p1"), F.sum("n").alias("n"))
    bins = np.array([tuple(r) for r in found.select("level", "p2", "p1", "n").collect()], float).reshape(-1, 4)
    bins[:, 1:3] /= bins[:, 3:4] if len(bins) else 1
    bins[:, 1:3] = np.array([float(f"{x:.12g}") for x in bins[:, 1:3].ravel()]).reshape(-1, 2)  # alike for any order of the sums
    return bins[np.lexsort(bins.T[::-1])]


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, node_bytes: int = NODE_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` is a column that is true for rows not to learn from."""
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _score_texts(docs, held_out, id_col, text_col, block_bytes, node_bytes, fan_bits)


def _score_texts(docs: DataFrame, held_out, id_col: str, text_col: str, block_bytes: int, node_bytes: int, fan_bits: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    kind = id_type.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    part = F.when(F.col("held"), HELD).when(F.pmod(F.xxhash64("doc_id", "text"), F.lit(64)) < TUNING, TUNE).otherwise(KEPT)
    packed = rows.select("doc_id", "text", part.alias("part")).mapInArrow(_packer(block_bytes), f"part int, ids array<{kind}>, sizes array<bigint>, data binary")
    blocks = staged(packed.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    size = lambda own: F.sum(F.when(own, F.size("ids")).otherwise(0))
    text_bytes = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    n_blocks, total, trained, tuning = (int(x or 0) for x in blocks.agg(F.count("*"), F.sum(text_bytes), size(F.col("part") != HELD), size(F.col("part") == TUNE)).first())
    with arrow_rows(docs.sparkSession, BATCH_BLOCKS):
        stats, (types, tokens, tuned) = counted(blocks, n_blocks, total, id_type, fan_bits, node_bytes)
    uniform = 1 / (types + 1)
    lower, top = np.tile([0.0, 0.0, 1.0], (LEVELS, 1)), np.zeros(LEVELS)
    if tokens:
        known = (trained - tuning, tokens - tuned)
        own = stats.filter(F.col("part") == TUNE)

        def of_pairs(row):
            _, lev, _, two, one, _ = _estimates(row, "_less", *known)
            return lev, two, one

        lower = learn_weights(_bins(own, of_pairs), uniform)

        def of_triples(row):
            lev, lev_one, three, two, one, _ = _estimates(row, "_less", *known)
            return lev, three, lower_estimate(lower, lev_one, two, one, uniform)

        top = learn_top_weights(_bins(own, of_triples))

    def run(batches):
        for row in _rows(batches):
            lev, lev_one, three, two, one, uni = _estimates(row, "", trained, tokens)
            sizes, w = np.array(row["sizes"], np.int64), top[lev]
            begin, n = np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(sizes)
            add = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
            base = add(np.log10((uni + 1) / (tokens + types + 1)))
            model = add(np.log10(w * three + (1 - w) * lower_estimate(lower, lev_one, two, one, uniform)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], to_arrow_type(id_type)), pa.array([row["part"] == HELD] * n), pa.array(sizes), pa.array(add((uni > 0).astype(np.int64))), pa.array([tokens] * n, pa.int64()), pa.array(base), pa.array(model)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return stats.select("part", "ids", "sizes", "uni", "bi", "tri").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
