"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct five-word shingles.  Documents with equal
sets form a class, and one document stands for each class.  Representatives
with an equal band of MinHash values meet in a bucket.  In a few rounds a
bucket's members are compared with a few leaders (``LEADERS``), members of the
leader's own component left out, so the pairs grow with the members and not
with their square.  A leader has then met its whole bucket and leaves it, and
small buckets are done.  The documents that still share a large bucket across
components meet by their rarest shingles instead (``_rest_pairs``): an exact
prefix filter, in which documents that only share common passages don't meet.

Each comparison first meets the odd sketches: the MinHash samples folded into
a parity bitmap.  The population count of two bitmaps' XOR is at most twice
the number of samples that differ, so a bound on it keeps every pair whose
samples differ no more often than a linked pair's do (``most_apart``).  The
pairs that remain are confirmed on their full sets, and links make components.

Buckets, classes, leaders and components may hold most documents: every join on
them deals the rows of a large key over salts (``common.salted_join``).

Documents are linked from a similarity of ``percent`` on; the bands and the
bounds follow from it.  A linked pair misses all buckets with a chance of 2e-8
at the threshold, and fails the bound on the sketch with a chance below 1e-8;
both fall steeply above it.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; texts of one to four words are one shingle; rows of one doc_id are one
document, linked with whatever any of them is linked with, and stay or go
together; a row without an id is linked with the documents whose set it has, but
stands for none: it goes if there is one; other columns are ignored, and kept by
``kept_documents``, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import PLAIN_WORD, arrow_rows, hash_spans, hot_keys, mix64, salted_join, scratch, staged, table, text_steps, words

SHINGLE = 5
ROWS = 4
#: MinHash samples in an odd sketch, and its words.
SKETCH_SAMPLES, SKETCH_WORDS = 96, 8
LINK_PERCENT = 85
#: Leaders of a bucket in each round.
LEADERS = (1, 2, 4)
#: Bits of a whole set's bitmap are 64 times this; the rows of a large bucket that meet at once.
PARITY_WORDS, BLOCK_ROWS = 16, 1000
#: Leading bits of a shingle by which its frequency is counted.
COUNT_BITS = 20
#: Rows in an Arrow batch: whole texts, and pairs of them, are in Python at once.
BATCH_ROWS = 1000


def bands_for(percent: int) -> int:
    """Bands that a pair at the threshold misses with a chance of 2.1e-8 at most; they hold a sketch's samples at least."""
    met = (percent / 100) ** ROWS
    return max(SKETCH_SAMPLES // ROWS, ceil(log(2.1e-8) / log(1 - met)) if met < 1 else 1)


@lru_cache
def most_apart(percent: int) -> int:
    """Samples of a sketch in which a linked pair may differ: more do at the threshold with a chance below 1e-8."""
    n, apart = SKETCH_SAMPLES, 1 - percent / 100
    chance = [comb(n, i) * apart**i * (1 - apart) ** (n - i) for i in range(n + 1)]
    return next(k for k in range(n + 1) if sum(chance[k + 1 :]) < 1e-8)


#: Of the threshold of op4.
BANDS, MOST_APART = bands_for(LINK_PERCENT), most_apart(LINK_PERCENT)

_rng = np.random.Generator(np.random.PCG64(41))
_PLACE = _rng.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MULT = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


@lru_cache
def _constants(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors, offsets and band factors; the first ``BANDS`` bands are the same for any number."""
    more = max(0, bands - BANDS)
    new = lambda k, shape: np.random.Generator(np.random.PCG64(41 + k)).integers(0, 2**64, shape, dtype=np.uint64)
    mult = np.concatenate([_MULT, new(1, more * ROWS) | np.uint64(1)])
    return mult[: bands * ROWS], np.concatenate([_ADD, new(2, more * ROWS)])[: bands * ROWS], np.concatenate([_BAND, new(3, (more, ROWS)) | np.uint64(1)])[:bands]


def shingle_sets(texts: pa.Array):
    """Each row's sorted distinct shingle hashes, in order."""
    for _, data, offs in text_steps(texts):
        low, starts, ends, rows = words(data, offs, PLAIN_WORD)
        n = np.bincount(rows, minlength=len(offs) - 1)
        first = np.concatenate([[0], np.cumsum(n)])
        h = hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        full = len(h) - SHINGLE + 1
        every = mix64(sum((h[j : j + full] * _PLACE[j] for j in range(1, SHINGLE)), h[:full] * _PLACE[0])) if full > 0 else None
        for r in range(len(offs) - 1):
            if n[r] >= SHINGLE:
                yield np.unique(every[first[r] : first[r + 1] - SHINGLE + 1])
            elif n[r]:
                own = h[first[r] : first[r + 1]]
                yield mix64((own * _PLACE[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
            else:
                yield np.zeros(0, np.uint64)


def _signature_batch(sets: list[np.ndarray], bands: int = BANDS):
    """Fingerprints, band keys and odd sketches of non-empty sets."""
    mult, add, band = _constants(bands)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((len(sets), bands * ROWS), np.uint64)
    for i in range(bands * ROWS):
        low[:, i] = np.minimum.reduceat(flat * mult[i] + add[i], at)
    keys = mix64((low.reshape(-1, bands, ROWS) * band).sum(2) + np.arange(bands, dtype=np.uint64))
    bit = mix64(low[:, :SKETCH_SAMPLES] + np.arange(SKETCH_SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.zeros((len(sets), SKETCH_WORDS), np.uint64)
    for i in range(SKETCH_SAMPLES):
        odd[np.arange(len(sets)), bit[:, i] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, i] & np.uint64(63))
    return np.add.reduceat(flat, at), np.add.reduceat(mix64(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at), keys, odd


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (a fingerprint of the set), bands, odd; the last four null for empty sets."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            cols: list = [[None] * len(sets) for _ in range(4)]
            for begin in range(0, len(some), 128):
                part = some[begin : begin + 128]
                one, two, keys, odd = (x.view(np.int64) for x in _signature_batch([sets[i] for i in part], bands))
                for k, i in enumerate(part):
                    cols[0][i], cols[1][i], cols[2][i], cols[3][i] = one[k], two[k], keys[k], odd[k]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [batch.column("doc_id"), pa.array(size), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set1", "set2", "bands", "odd"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>, odd array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b) that isn't its component's smallest.

    Alternating star contraction; the edges of each step go to the shared folder.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars")
        met = salted_join(both, least.select("u", "m"), ["u"], hot_keys(least, ["u"]), F.xxhash64("v"))  # a star may hold most nodes
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = staged(small.select("x.u", "x.v").filter("u != v").distinct(), "edges")
        if (now := mark(e)) == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _alike(n1: Column, odd1: Column, n2: Column, odd2: Column, percent: int) -> Column:
    """Sizes and sketches leave a link possible."""
    apart = sum((F.bit_count(odd1[k].bitwiseXOR(odd2[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    ratio = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return ratio & (apart <= 2 * most_apart(percent))


def _linked(percent: int):
    def sides(column):
        texts = column.dictionary_encode()  # a leader's text is cut once for a batch
        sets = list(shingle_sets(texts.dictionary))
        return [sets[i] for i in texts.indices.to_numpy()]

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(sides(batch.column("text_a")), sides(batch.column("text_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets; texts: node, text.  A node may be in most pairs."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs
    for x, other in (("b", "a"), ("a", "b")):
        hot = hot_keys(pairs.groupBy(x).agg(F.count("*").alias("n")), [x])
        both = salted_join(both, texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), [x], hot, F.xxhash64(other))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_linked(percent), f"a {kind}, b {kind}")


def _with_parity(kind: str):
    """node, size, p0, p1, ...: whole sets folded into bitmaps; sets that differ in d shingles differ in d bits at most."""
    names = [f"p{k}" for k in range(PARITY_WORDS)]

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            bits = np.zeros((len(sets), 64 * PARITY_WORDS), np.uint8)
            for k, own in enumerate(sets):
                bits[k] = np.bincount((mix64(own) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
            parity = np.packbits(bits, axis=1).view(np.int64)
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, *(pa.array(parity[:, k].copy()) for k in range(PARITY_WORDS))], ["node", "size", *names])

    return run, f"node {kind}, size bigint, {', '.join(f'{x} bigint' for x in names)}"


def _slot_counts(batches):
    """How many of the sets have a shingle, by the leading bits of its hash."""
    seen = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for own in shingle_sets(batch.column("text")):
            np.add.at(seen, (own >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
    slot = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(seen[slot])], ["slot", "n"])


def _rare_first(counts: np.ndarray, percent: int, kind: str):
    """token, node: of each set its rarest shingles, as many as leave no room for a link without one of them."""

    def run(batches):
        for batch in batches:
            tokens, rows = [], []
            for i, own in enumerate(shingle_sets(batch.column("text"))):
                need = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                order = np.lexsort((own, counts[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[:need]
                tokens.append(own[order].view(np.int64))
                rows.append(np.full(len(order), i))
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else rows), batch.column("node").take(pa.array(rows))], ["token", "node"])

    return run, f"token bigint, node {kind}"


def _rest_pairs(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that may be linked, of rows (node, comp).

    Two sets of this similarity share one of the first ``size - need + 1``
    shingles of each, in any order of all shingles; the order is by how rare
    they are.  Sets that meet by one are compared by bitmaps of whole sets: they
    differ in a known number of shingles at most, and so do their bitmaps.  A
    shingle that is rare in none is met in blocks of ``BLOCK_ROWS``.  No link is
    lost in any of this.
    """
    kind = rest.schema["node"].dataType.simpleString()
    own = staged(texts.join(rest.select("node").distinct(), "node", "left_semi"), "rest-texts")
    seen, counts = own.mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow(), np.zeros(1 << COUNT_BITS, np.int64)
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    rows = staged(own.mapInArrow(*_rare_first(counts, percent, kind)).join(rest, "node"), "rest-tokens")
    shared = staged(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("token", "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "rest-shared")
    rows = salted_join(rows, shared.select("token", "blocks"), ["token"], hot_keys(shared, ["token"]), F.xxhash64("node"))
    rows = staged(rows.join(staged(own.mapInArrow(*_with_parity(kind)), "rest-parities"), "node"), "rest-rows")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("comp", "size", *(f"p{k}" for k in range(PARITY_WORDS)))]
    left = rows.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("a"), *side("a"))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("b"), *side("b"))
    apart = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(PARITY_WORDS)), F.lit(0))
    ratio = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    near = apart * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    met = left.join(right.withColumnRenamed("token", "token_b").withColumnRenamed("block", "block_b"), (F.col("token") == F.col("token_b")) & (F.col("block") == F.col("block_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & ratio & near)
    return met.select("a", "b").distinct()


def _round(now: DataFrame, reps: DataFrame, leaders: int, turn: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """The pairs (a, b) of members with their buckets' leaders, the buckets' rows without the leaders, and whether there are any.

    now: bucket, node, comp, n, odd.  Buckets of one component are done.
    """
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(leaders))
    heads = now.groupBy("bucket", part.alias("part")).agg(F.min("node").alias("node"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    heads = staged(heads, "leaders")
    mixed = staged(heads.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("lo != hi"), "mixed-buckets")
    lead = heads.select("bucket", "node").join(mixed.select("bucket"), "bucket").join(reps, "node")
    lead = lead.groupBy("bucket").agg(F.collect_list(F.struct("node", "comp", "n", "odd")).alias("leads"))
    met = salted_join(now, lead, ["bucket"], hot_keys(mixed, ["bucket"]), F.xxhash64("node"))
    may = F.filter("leads", lambda x: (x["comp"] != F.col("comp")) & _alike(F.col("n"), F.col("odd"), x["n"], x["odd"], percent))
    met = staged(met.select("bucket", "node", "n", "odd", F.transform(may, lambda x: x["node"]).alias("asked"), F.exists("leads", lambda x: x["node"] == F.col("node")).alias("leads")), "round")
    pairs = met.select("node", F.explode("asked").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), met.filter("NOT leads").select("bucket", "node", "n", "odd"), not mixed.isEmpty()


def _representatives(sig: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Classes of equal sets, their representatives, ids of several rows, and links between the classes of one id."""
    classes = sig.filter("n_shingles > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.min_by(F.struct("n_shingles", "odd", "bands"), "doc_id").alias("rep"))
    classes = staged(classes, "classes")
    reps = classes.filter("node IS NOT NULL").select("node", F.col("rep.n_shingles").alias("n"), "rep.odd", "rep.bands")
    again = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("set1", "set2")).alias("lo"), F.max(F.struct("set1", "set2")).alias("hi"), F.count("*").alias("n")).filter("n > 1")
    again = staged(again, "repeated-ids")
    if again.isEmpty():
        return classes, reps, None, None
    several, hot = again.filter("lo != hi"), hot_keys(again, ["doc_id"])
    own = salted_join(sig.select("doc_id", "set1", "set2"), several.select("doc_id"), ["doc_id"], hot, F.xxhash64("set1"))
    own = salted_join(own, classes.select("set1", "set2", "node"), ["set1", "set2"], hot_keys(classes, ["set1", "set2"]), F.xxhash64("doc_id")).select("doc_id", "node").distinct()
    own = staged(own, "classes-of-ids")
    same = salted_join(own, own.groupBy("doc_id").agg(F.min("node").alias("a")), ["doc_id"], hot, F.xxhash64("node"))
    return classes, reps, again.select("doc_id"), staged(same.select("a", F.col("node").alias("b")).filter("a != b").distinct(), "same-document")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = len(LEADERS), percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; documents are linked from a similarity of ``percent`` (1 to 100) on."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS), scratch(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, rounds, percent).drop("set1", "set2")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, rounds: int, percent: int) -> DataFrame:
    sig = staged(signatures(docs, id_col, text_col, bands_for(percent)), "signatures", keep=True)
    classes, reps, again, same = _representatives(sig)
    inside = reps.select("node", "n", "odd", F.explode("bands").alias("bucket"))
    labels = compared = texts = None
    for turn, leaders in enumerate((*LEADERS[:rounds], 0)):
        with_comp = lambda x: x.withColumn("comp", F.col("node")) if labels is None else x.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")  # noqa: B023, E731
        now = with_comp(inside)
        if leaders:
            pairs, inside, more = _round(now, with_comp(reps.select("node", "n", "odd")), leaders, turn, percent)
            if turn and not more:
                break
            nodes = inside.select("node").union(pairs.select("a")).union(pairs.select("b"))
        else:
            now = staged(now.select("bucket", "node", "comp"), "rest-buckets")
            mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
            mixed = staged(mixed, "rest-mixed")
            if turn and mixed.isEmpty():
                break
            rest = salted_join(now, mixed.select("bucket"), ["bucket"], hot_keys(mixed, ["bucket"]), F.xxhash64("node")).select("node", "comp").distinct()
            nodes = rest = staged(rest, "rest")
        if texts is None:
            texts = _texts(docs, id_col, text_col, nodes, again)
        if not leaders:
            pairs = _rest_pairs(rest, texts, percent)
        pairs = staged(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = pairs if compared is None else compared.union(pairs)
        links = confirmed(pairs, texts, percent)
        if not turn and same is not None:
            links = links.union(same)
        if labels is not None:
            links = links.union(labels)
        links = staged(links, "links")
        if not links.isEmpty():
            labels = staged(components(links), "labels")
    found = classes.select("set1", "set2", "n", "node")
    found = found.withColumnRenamed("node", "component_id") if labels is None else found.join(labels, "node", "left").select("set1", "set2", "n", F.coalesce("component", "node").alias("component_id"))
    found = staged(found, "components", keep=True)
    out = salted_join(sig.select("doc_id", "n_shingles", "set1", "set2"), found.drop("n"), ["set1", "set2"], hot_keys(found, ["set1", "set2"]), F.xxhash64("doc_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set1", "set2")


def _texts(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, again: DataFrame | None) -> DataFrame:
    """node, text of the documents that may be compared; each text of an id of several rows once."""
    rows = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text")).join(nodes.select("node").distinct(), "node", "left_semi")
    if again is not None:
        again = again.withColumnRenamed("doc_id", "node")
        once = rows.join(again, "node", "left_semi").groupBy("node", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("node", "text")
        rows = rows.join(again, "node", "left_anti").union(once)
    return staged(rows, "texts")


def _fingerprints(columns: list[str], text_col: str):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(columns.index(text_col)).cast(pa.string())))
            some = [i for i, x in enumerate(sets) if len(x)]
            prints = np.zeros((2, len(sets)), np.int64)
            for i in some:
                one, two, _, _ = _signature_batch([sets[i]])
                prints[:, i] = one.view(np.int64)[0], two.view(np.int64)[0]
            none = np.array([not len(x) for x in sets])
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(p, mask=none) for p in prints)], ["row", "set1", "set2"])

    return run


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the rows whose id is their component's, null-safe."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS), scratch(spark):
        found = _near_duplicates(docs, id_col, text_col, len(LEADERS), percent)
        gone = staged(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "gone", keep=True)
    named = gone.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(named, id_col, "left_anti").select(*docs.columns)
    nameless = gone.filter("doc_id IS NULL").select("set1", "set2").distinct()
    if nameless.isEmpty():
        return kept
    # rows without an id are told by their sets
    schema = StructType([StructField("row", docs.schema), StructField("set1", LongType()), StructField("set2", LongType())])
    rows = docs.filter(F.col(id_col).isNull()).mapInArrow(_fingerprints(docs.columns, text_col), schema)
    return kept.filter(F.col(id_col).isNotNull()).union(rows.join(nameless, ["set1", "set2"], "left_anti").select("row.*"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=LINK_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
