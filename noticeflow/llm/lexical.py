"""Ranked lexical search over document shards with integer impacts.

``index`` cuts each input partition into shards of at most ``SHARD_BYTES`` of
text (a longer text is a shard of its own).  A shard holds its terms in order
and, as compressed sparse rows, each term's documents with their impacts: the
part of the score that depends on the term's count, the document's length and
the mean length, worked out once as an integer.  Two passes write it: counts
first, and impacts when the totals over all shards are known.  A term's weight
depends on how many documents hold it, which is the sum over the shards.

``search`` deals questions in blocks of bounded size to all shards.  Per
question a dense array of the shard's documents adds up weight times impact,
term after term; ``argpartition`` gives the k-th best score, what lies above it
is taken, and of those equal to it the smallest doc_ids.  A task keeps the best
of all its shards, and what tasks return is merged over salts.

Only counts of terms are shuffled; texts and postings stay where they are.

Defined cases: null and empty texts have no terms and are never found, but a
document without terms doesn't count among all; repeated rows are documents of
their own; a null doc_id is last among equals; questions of one item_id are
one question with the terms of its different texts; an item without known
terms has no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORD, scratch, staged, table, text_steps, words

SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: (item, term) pairs that one pass over the shards answers; they are sent to all executors.
BLOCK_PAIRS = 1 << 20
BEST = 20
MERGE_SALTS = 64


def _bytes(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _counted(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, row) of a step as terms, rows and counts, and each row's number of terms."""
    low, starts, ends, rows = words(data, offs, ALNUM_WORD)
    n = len(offs) - 1
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    kept = np.ascontiguousarray(low[np.cumsum(inside[:-1]).astype(bool)])
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, counts = np.unique(codes * n + rows, return_counts=True)
    terms = pa.DictionaryArray.from_arrays(pa.array((pairs // n).astype(np.int32)), coded.dictionary)
    return terms, (pairs % n).astype(np.int64), counts, np.bincount(rows, minlength=n)


class _Shard:
    """Documents that are gathered until they make a shard."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.docs, self.counts = [], [], [], [], []
        self.size = self.n = 0

    def add(self, ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> None:
        terms, rows, counts, lengths = _counted(data, offs)
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.terms.append(terms)
        self.docs.append(rows + self.n)
        self.counts.append(counts)
        self.size += len(data)
        self.n += len(ids)

    def row(self) -> dict:
        """The shard with documents in the order of their ids and terms in the order of their bytes."""
        ids, lengths = pa.chunked_array(self.ids).combine_chunks(), np.concatenate(self.lengths)
        order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded = pa.chunked_array(self.terms).unify_dictionaries().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        term_order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(term_order), np.int64)
        rank[term_order] = np.arange(len(term_order))
        term, doc, count = rank[coded.indices.to_numpy(zero_copy_only=False)], place[np.concatenate(self.docs)], np.concatenate(self.counts)
        by = np.argsort(term * len(order) + doc)
        dfs = np.bincount(term, minlength=len(rank))
        return {
            "ids": ids.take(pa.array(order)),
            "terms": coded.dictionary.take(pa.array(term_order)).cast(pa.large_string()),
            "dfs": pa.array(dfs, pa.int64()),
            "docs": _bytes(doc[by], "<i4"),
            "counts": _bytes(count[by], "<i4"),
            "lengths": _bytes(lengths[order], "<i8"),
            "n_docs": int((lengths > 0).sum()),
            "n_terms": int(lengths.sum()),
        }


def _count_shards(docs: DataFrame) -> DataFrame:
    """One row for each shard: ids, terms, dfs, and packed docs, counts and lengths."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType().add("ids", T.ArrayType(id_type)).add("terms", T.ArrayType(T.StringType())).add("dfs", T.ArrayType(T.LongType()))
    for name in ("docs", "counts", "lengths"):
        schema = schema.add(name, "binary")
    schema = schema.add("n_docs", "long").add("n_terms", "long")
    most_bytes, most_docs = SHARD_BYTES, SHARD_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(shard: _Shard) -> pa.RecordBatch:
            row = shard.row()
            lists = {k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for k, v in row.items() if isinstance(v, pa.Array)}
            lists = {k: v.cast(pa.list_(pa.string() if k == "terms" else v.type.value_type)) for k, v in lists.items()}
            return pa.RecordBatch.from_arrays([lists.get(k, None) if k in lists else pa.array([v]) for k, v in row.items()], names=list(row))

        shard = _Shard()
        for batch in batches:
            for row, data, offs in text_steps(batch.column(1)):
                n = len(offs) - 1
                if shard.n and (shard.size + len(data) > most_bytes or shard.n + n > most_docs):
                    yield emit(shard)
                    shard = _Shard()
                shard.add(batch.column(0).slice(row, n), data, offs)
        if shard.n:
            yield emit(shard)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Index:
    """shards: ids, terms, starts, docs, impacts; frequencies: term, df; and the totals over all documents."""

    shards: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def index(docs: DataFrame) -> Index:
    """The index of all rows (doc_id, text), as tables of the shared folder."""
    counted = staged(_count_shards(docs), "lexical-counts")
    n, total = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = int(n or 0), int(total or 0)
    both = counted.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs")
    frequencies = both.groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    schema = T.StructType([f for f in counted.schema.fields if f.name in ("ids", "terms")])
    for name in ("starts", "docs", "impacts"):
        schema = schema.add(name, "binary")

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, impacts = [], []
            for k in range(batch.num_rows):
                doc, count, length = (np.frombuffer(batch.column(c)[k].as_py(), t).astype(np.int64) for c, t in (("docs", "<i4"), ("counts", "<i4"), ("lengths", "<i8")))
                m = 100 - 25 + 25 * length * n // max(total, 1)
                impacts.append(_bytes((1_000_000_000 * count) // (1000 * count + 12 * m[doc]), "<i4"))
                dfs = batch.column("dfs")[k].values.to_numpy(zero_copy_only=False)
                starts.append(_bytes(np.concatenate([[0], np.cumsum(dfs)]), "<i4"))
            columns = [batch.column("ids"), batch.column("terms"), pa.array(starts, pa.binary()), batch.column("docs"), pa.array(impacts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "starts", "docs", "impacts"])

    # few shards a batch, as one may have some megabytes
    shards = staged(counted.select("ids", "terms", "dfs", "docs", "counts", "lengths").mapInArrow(seal, schema), "lexical-shards", keep=True)
    return Index(shards, staged(frequencies, "lexical-terms", keep=True), n, total)


def questions(items: DataFrame) -> DataFrame:
    """item_id, term, n: how often each item's different texts hold each term."""
    id_type = items.schema["item_id"].dataType
    schema = T.StructType().add("item_id", id_type).add("term", "string").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in text_steps(batch.column(1)):
                terms, rows, counts, _ = _counted(data, offs)
                ids = batch.column(0).slice(row, len(offs) - 1).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, terms.dictionary_decode().cast(pa.string()), pa.array(counts, pa.int64())], names=["item_id", "term", "n"])

    found = items.select("item_id", "text").distinct().mapInArrow(run, schema)
    return found.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, best first; of equal ones the first places."""
    if len(scores) > k:
        bound = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        above = np.flatnonzero(scores > max(bound, 0))
        equal = np.flatnonzero(scores == bound)[: k - len(above)] if bound > 0 else above[:0]
        found = np.concatenate([above, equal])
    else:
        found = np.flatnonzero(scores > 0)
    return found[np.lexsort((found, -scores[found]))]


def _ask(shards: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task for the questions of a block (item, a number; term; weight)."""
    block = block.combine_chunks().sort_by([("item", "ascending"), ("term", "ascending")])
    asked = block["term"].combine_chunks().dictionary_encode()
    asked = asked.chunk(0) if isinstance(asked, pa.ChunkedArray) else asked
    item = block["item"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    sent = shards.sparkSession.sparkContext.broadcast(
        (asked.dictionary.to_pylist(), asked.indices.to_numpy(zero_copy_only=False), block["weight"].to_numpy(), item[first], np.append(first, len(item)))
    )
    schema = T.StructType().add("item", "long").add("doc_id", shards.schema["ids"].dataType.elementType).add("score", "long")
    doc_type = pa.int64() if isinstance(schema["doc_id"].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, codes, weights, items, bounds = sent.value
        terms = pa.array(terms, pa.string())
        kept: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                ids, own = batch.column("ids")[r].values, batch.column("terms")[r].values
                starts, docs, impacts = (np.frombuffer(batch.column(c)[r].as_py(), "<i4") for c in ("starts", "docs", "impacts"))
                at = pc.index_in(terms, value_set=own).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
                scores = np.zeros(len(ids), np.int64)
                for q, (b, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    scores[:] = 0
                    for t, w in zip(at[b:e], weights[b:e], strict=True):
                        if t >= 0:
                            s = slice(starts[t], starts[t + 1])
                            scores[docs[s]] += w * impacts[s].astype(np.int64)
                    found = best(scores, k)
                    if len(found):
                        new = zip(scores[found].tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)
                        both = kept.get(q, []) + [(-s, d is None, d) for s, d in new]
                        both.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
                        kept[q] = both[:k]
        rows = [(items[q], d, -s) for q, found in kept.items() for s, _, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], doc_type), pa.array([x[2] for x in rows], pa.int64())], names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, schema)


def search(found: Index, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = items.sparkSession
    asked = staged(questions(items), "lexical-questions")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * found.n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(found.frequencies, "term").withColumn("weight", F.col("n") * weight).filter("weight > 0")
    # one number for each item, so that ids of any type, null too, travel as they are
    numbers = staged(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "lexical-items", keep=True)
    weighted = staged(weighted.join(numbers, weighted["item_id"].eqNullSafe(numbers["item_id"])).select("item", "term", "weight"), "lexical-weights")
    pairs = weighted.count()
    blocks = -(-pairs // BLOCK_PAIRS)
    parts = []
    for b in range(blocks):
        block = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow() if blocks > 1 else weighted.toArrow()
        if block.num_rows:
            parts.append(staged(_ask(found.shards, block, k), "lexical-found", keep=True))
    schema = T.StructType().add("item", "long").add("doc_id", found.shards.schema["ids"].dataType.elementType).add("score", "long")
    rows = spark.createDataFrame([], schema)
    for part in parts:
        rows = rows.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return rows.join(numbers, "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT k, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS lt FROM docs),
counts AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, nd),
asked AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, d.k, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // lt)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN docs d ON d.k = counts.k, totals GROUP BY ALL
),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
