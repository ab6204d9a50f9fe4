"""Toxicity by subword-bag embeddings and a linear softmax.

A text is the bag of its words and their character n-grams, hashed to buckets.
The buckets' embeddings are averaged and a linear softmax decides; embeddings
and softmax are trained jointly in numpy.  A misspelt or newly inflected word
shares most n-grams with the words it comes from, and so their vectors.

Training is on a bounded sample of labelled rows (``most_toxic`` and
``most_clean``, the first in hash order of their ids), weighted back to the
classes' shares among all labelled rows.  Whole texts of any length become bags
on the executors; the driver gets sums by bucket, picks at most ``most_buckets``
that tell the classes apart, and trains on the bags' entries in these.  Scoring
reads every whole text and needs no shuffle: for two classes the averaged
embedding enters as one number a bucket, so tasks carry a table of ``2**bits``
numbers.

Defined cases: null, empty and blank texts get the score of an empty bag (the
bias); repeated rows get equal scores; of rows with one labelled id one text is
learnt, and the id is toxic if any of its labels is; labels that are null are not
used; with no labelled rows, or those of one class only, the score is 0; other
columns are ignored, and kept by ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_rows, mix64, scratch, staged, table

GRAMS, BITS, DIM = (4, 5), 18, 8
MOST_TOXIC, MOST_CLEAN, MOST_BUCKETS = 1500, 3000, 16_384
#: Whole texts in an Arrow batch while bags are built.
BATCH_ROWS = 200
EPOCHS, SCALE, SMOOTH, LEAST_TEXTS, SURE = 20, 100.0, 0.5, 4, 3.5
#: Adam's steps for embeddings, softmax and bias.
RATES = (0.02, 0.1, 0.2)
THRESHOLD = 0.7
#: Training texts whose least hash of so long a passage is equal count as copies.
COPY_CHARS = 40
STEP_CHARS = 1 << 18
_SPACE = np.uint32(32)


def _char_steps(texts: pa.Array, step: int = STEP_CHARS):
    """Yield (first row, characters with A-Z lower-cased, offsets); a space before each text and at the end."""
    row, buf, offs, size = 0, [], [0], 0
    values = texts.to_pylist()
    for i, t in enumerate(values):
        c = np.frombuffer(("" if t is None else t).encode("utf-32-le", "surrogatepass"), np.uint32)
        buf.append(np.concatenate([[_SPACE], c]).astype(np.uint32))
        size += len(c) + 1
        offs.append(size)
        if size >= step or i + 1 == len(values):
            a = np.concatenate([*buf, [_SPACE]]).astype(np.uint32)
            a[(a >= 65) & (a <= 90)] += np.uint32(32)
            a[(a >= 9) & (a <= 13)] = _SPACE
            yield row, a, np.array(offs)
            row, buf, offs, size = i + 1, [], [0], 0


def _span_hash(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base = 0xAF251AF3B0F025B5
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(len(a), base, np.uint64)]))
    inverse = np.cumprod(np.concatenate([one, np.full(len(a), pow(base, -1, 2**64), np.uint64)]))
    sums = np.concatenate([one * 0, np.cumsum(mix64(a.astype(np.uint64) + one) * power[:-1])])
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


def _features(a: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
    """(positions, buckets) of words and of n-grams of words marked by a space on either side."""
    space = a == _SPACE
    v = mix64(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    shift = np.uint64(64 - bits)
    crossed = np.concatenate([[0], np.cumsum(space)])
    h, at, out = np.zeros(len(a), np.uint64), [], []
    mult = 1
    for n in range(1, max(grams) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = h[:m] + v[n - 1 :] * np.uint64(mult)
        mult = mult * 0xD1342543DE82EF95 % 2**64
        if n in grams:
            pos = np.flatnonzero(crossed[n - 1 : n - 1 + m] == crossed[1 : m + 1])  # no space but at the ends
            at.append(pos)
            out.append((mix64(h[pos] + np.uint64(n)) >> shift).astype(np.int32))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at.append(starts)
    out.append((_span_hash(a, starts, ends) >> shift).astype(np.int32))
    return np.concatenate(at), np.concatenate(out)


def _row_of(pos: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, pos, "right") - 1


class Model:
    """``table``: each bucket's embedding times the difference of the softmax's rows; ``bias`` likewise."""

    def __init__(self, table: np.ndarray, bias: float, scale: float = SCALE):
        self.table, self.bias, self.scale = table.astype(np.float32), float(bias), float(scale)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        bits = int(len(self.table)).bit_length() - 1
        for row, a, offs in _char_steps(texts):
            pos, bucket = _features(a, bits)
            at, n = _row_of(pos, offs), len(offs) - 1
            count = np.bincount(at, minlength=n)[:n]
            total = np.bincount(at, self.table[bucket], n)[:n]
            margin = self.scale * total / np.maximum(count, 1) + self.bias
            out[row : row + n] = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        return out


def _copy_keys(texts: list[str | None]) -> np.ndarray:
    """A key for each text that its copies share."""
    keys = []
    for _, a, offs in _char_steps(pa.array(texts, pa.string())):
        least = np.full(len(offs) - 1, 2**64 - 1, np.uint64)
        begin = np.flatnonzero((a[:-1] == _SPACE) & (a[1:] != _SPACE))
        of = _row_of(begin, offs)
        np.minimum.at(least, of, _span_hash(a, begin, np.minimum(begin + COPY_CHARS, offs[of + 1])))
        keys.append(least)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _bags(texts: list[str | None], bits: int):
    """Yield rows, buckets and shares of the texts' bags, by row, a step of texts at a time."""
    for row, a, offs in _char_steps(pa.array(texts, pa.string())):
        pos, bucket = _features(a, bits)
        at, n = _row_of(pos, offs), len(offs) - 1
        key, count = np.unique(at.astype(np.int64) << 32 | bucket, return_counts=True)
        at, bucket = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        yield at + row, bucket, (count / np.bincount(at, count, n)[at]).astype(np.float32)


def telling_buckets(seen: np.ndarray, of: np.ndarray, most: int = MOST_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' smoothed log ratios, and a mask of those to learn; seen: texts of each class with the bucket, of: all texts.

    Buckets of fewer than ``LEAST_TEXTS`` texts, or whose shares are less than
    ``SURE`` standard errors apart, aren't learnt; of the others the ``most`` surest are.
    """
    ratio = np.log((seen[1] + SMOOTH) / (of[1] + 2 * SMOOTH)) - np.log((seen[0] + SMOOTH * of[0] / of[1]) / (of[0] + 2 * SMOOTH * of[0] / of[1]))
    both = seen.sum(0) / of.sum()
    sure = np.abs(seen[1] / of[1] - seen[0] / of[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / of[0] + 1 / of[1]))
    used = (seen.sum(0) >= LEAST_TEXTS) & (sure >= SURE)
    if used.sum() > most:
        rest = np.flatnonzero(used)
        used[rest[np.argsort(-sure[rest], kind="stable")[most:]]] = False
    return ratio, used


def train(r: np.ndarray, c: np.ndarray, v: np.ndarray, keys: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray, used: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings (buckets x ``dim``) and a softmax of two classes by Adam on the weighted cross entropy.

    r, c, v: row, bucket and share of the bags' entries in used buckets.  Rows of
    one key are copies and share their weight.  Embeddings start along one
    direction at the buckets' log ratios; unused buckets stay at zero.  A fifth of
    the texts is set aside, and the epoch with the least loss on it is kept.
    """
    n, size = len(toxic), len(used)
    _, group, copies = np.unique(keys, return_inverse=True, return_counts=True)
    once = 1 / copies[group]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (size, dim))
    emb[:, 0] += ratio
    emb *= used[:, None]
    soft, bias = np.zeros((2, dim)), np.zeros(2)
    soft[1, 0], soft[0, 0] = 0.5, -0.5
    weight = weight * once
    dev = mix64(keys + np.uint64(1)) % np.uint64(5) == 0
    fit_w, dev_w = (weight * keep / max((weight * keep).sum(), 1e-12) for keep in (~dev, dev))
    params = [emb, soft, bias]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    best, least = None, np.inf
    for step in range(1, epochs + 1):
        diff = soft[1] - soft[0]
        flat = (emb @ diff).astype(np.float32)
        margin = SCALE * np.bincount(r, flat[c] * v, n)
        if step == 1:  # the bias starts between the classes
            bias[1] = -(np.average(margin[toxic == 1]) + np.average(margin[toxic == 0])) / 2
        margin += bias[1] - bias[0]
        loss = np.logaddexp(0, np.where(toxic == 1, -margin, margin))
        if (now := float((loss * dev_w).sum()) if dev.any() else float((loss * fit_w).sum())) < least:
            best, least = (flat.copy(), bias[1] - bias[0]), now
        delta = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - toxic) * fit_w
        pull = np.bincount(c, delta[r] * v, size) * SCALE * used
        towards = pull @ emb
        grads = [np.outer(pull, diff), np.stack([-towards, towards]), np.array([-delta.sum(), delta.sum()])]
        for param, grad, (m, s), rate in zip(params, grads, state, RATES, strict=True):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(best[0], best[1])


_BAG = "place bigint, toxic int, key bigint, buckets array<int>, shares array<float>"


def _to_bags(bits: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            bags: list[tuple] = [((), ())] * len(texts)
            for r, c, v in _bags(texts, bits):
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                for b, e in zip(cut, [*cut[1:], len(r)], strict=True):
                    bags[r[b]] = c[b:e], v[b:e]
            cols = [*batch.select(["place", "toxic"]).columns, pa.array(_copy_keys(texts).view(np.int64)), pa.array([x[0] for x in bags], pa.list_(pa.int32())), pa.array([x[1] for x in bags], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["place", "toxic", "key", "buckets", "shares"])

    return run


def _sums(once: dict[int, float], size: int):
    """By class and bucket the texts that have it, copies once."""

    def run(batches):
        seen = np.zeros((2, size))
        for batch in batches:
            for label, key, own in zip(*(batch.column(c) for c in ("toxic", "key", "buckets")), strict=True):
                seen[label.as_py(), own.values.to_numpy()] += once[key.as_py()]
        label, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[label, bucket])], ["toxic", "bucket", "n"])

    return run


def _only(used: np.ndarray):
    """The bags' entries in used buckets."""

    def run(batches):
        for batch in batches:
            kept: list[list] = [[], []]
            for own, shares in zip(batch.column("buckets"), batch.column("shares"), strict=True):
                at = used[own.values.to_numpy()]
                kept[0].append(own.values.to_numpy()[at])
                kept[1].append(shares.values.to_numpy()[at])
            cols = [*batch.select(["place", "toxic", "key"]).columns, pa.array(kept[0], pa.list_(pa.int32())), pa.array(kept[1], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["place", "toxic", "key", "buckets", "shares"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_buckets: int = MOST_BUCKETS, bits: int = BITS,
) -> Model | None:
    """A model from a bounded sample of the labelled rows; None without rows of both classes."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    with scratch(spark), arrow_rows(spark, BATCH_ROWS):
        order = [F.xxhash64("id"), F.col("id")]
        with_text = known.join(rows.select("id"), "id", "left_semi")
        first = [with_text.filter(F.col("toxic") == label).orderBy(*order).limit(most) for label, most in ((1, most_toxic), (0, most_clean))]
        chosen = rows.join(F.broadcast(first[0].union(first[1])), "id")  # at most most_toxic + most_clean ids
        chosen = chosen.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        bags = staged(chosen.select(F.xxhash64("id").alias("place"), "toxic", "text").mapInArrow(_to_bags(bits), _BAG), "toxicity-bags")
        held = bags.select("toxic", "key").toArrow()
        toxic, keys = held.column("toxic").to_numpy(), held.column("key").to_numpy()
        if len(np.unique(toxic)) < 2:
            return None
        values, group, copies = np.unique(keys, return_inverse=True, return_counts=True)
        once = 1 / copies[group]
        sums = bags.mapInArrow(_sums(dict(zip(values.tolist(), (1 / copies).tolist(), strict=True)), 2**bits), "toxic int, bucket int, n double").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros((2, 2**bits))
        seen[sums.column("toxic").to_numpy(), sums.column("bucket").to_numpy()] = np.round(sums.column("n").to_numpy(), 9)  # alike for any order of the sum
        ratio, used = telling_buckets(seen, np.array([once[toxic == label].sum() for label in (0, 1)]), most_buckets)
        kept = bags.mapInArrow(_only(used), _BAG).toArrow().sort_by([("place", "ascending"), ("key", "ascending")]).combine_chunks()
    toxic, keys = kept.column("toxic").to_numpy().astype(float), kept.column("key").to_numpy().astype(np.int64).view(np.uint64)
    sizes = pa.compute.list_value_length(kept.column("buckets")).to_numpy()
    flat = lambda c: pa.compute.list_flatten(kept.column(c)).to_numpy()
    weight = np.where(toxic == 1, shares[1] / max(1, (toxic == 1).sum()), shares[0] / max(1, (toxic == 0).sum()))
    model = train(np.repeat(np.arange(len(toxic)), sizes), flat("buckets"), flat("shares"), keys, toxic, weight, ratio, used)
    del kept
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (which replaces a column of that name), from 0 to 1."""
    docs = docs.drop(score_col)
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = pa.array(shared.value.scores(batch.column(text_col)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, schema)


def learnable(id_col: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id's text mod 3 is not 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 != 1, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> Model | None:
    docs = table(spark, sf_dir, "documents").filter(learnable(F.col("doc_id")))
    return fit(docs, table(spark, sf_dir, "labels").filter(learnable(F.col("doc_id"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
