"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items make one suffix automaton, in bounded
shards.  A document's words are streamed through it while the length of the
longest match that ends at each word is tracked.  An item is met where ``need``
of its consecutive words occur: ``need`` is ``window`` words, or the share
``coverage`` of the item's words if that is fewer.  Documents are never
shuffled; words outside the items' vocabulary can't be part of a match, so only
runs of known words walk the automaton.

Defined cases: null and empty texts have no words and are clean; items without
words are never met; an item_id that occurs on several rows is one item; an
empty item table leaves everything clean; other columns are kept or ignored;
very long texts are streamed whole; very long items are cut into pieces that
overlap by ``need - 1`` words, which keeps every window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, hash_spans, staged, table, text_steps, words

WINDOW, COVERAGE = 10, 1.0
#: Words in one broadcast automaton: about 60 MB.
SHARD_WORDS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """All substrings of the added word sequences, with the items that each needed window belongs to."""

    def __init__(self, pieces: list[tuple[str, int, list[str]]]):
        """pieces: item, need, words."""
        self.vocabulary: dict[bytes, int] = {}
        self.to: dict[tuple[int, int], int] = {}
        self.length, self.link = [0], [-1]
        self._out: list[list[int]] = [[]]
        coded = [(item, need, [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in found]) for item, need, found in pieces]
        for _, _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.met: dict[int, dict[int, set[str]]] = {}
        for item, need, ids in coded:
            at = 0
            for k, c in enumerate(ids, 1):
                at = self.to[at, c]
                if k >= need:
                    s = at
                    while self.length[self.link[s]] >= need:
                        s = self.link[s]
                    self.met.setdefault(s, {}).setdefault(need, set()).add(item)
        del self._out
        self.up = self._marked_ancestors()
        self.shortest = min((need for _, need, _ in pieces), default=0)
        names = sorted(self.vocabulary, key=self.vocabulary.get)
        ends = np.cumsum([len(w) for w in names])
        data = np.frombuffer(b"".join(names), np.uint8)
        hashes = hash_spans(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)) if names else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.names = hashes[self.order], names

    def _state(self, length: int, link: int, edges: list[int], like: int | None = None) -> int:
        s = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self._out.append(list(edges))
        for c in edges:
            self.to[s, c] = self.to[like, c]
        return s

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], self._out[q], q)
        while p >= 0 and self.to.get((p, c)) == q:
            self.to[p, c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.to.get((last, c))
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, [])
        p = last
        while p >= 0 and (p, c) not in self.to:
            self.to[p, c] = new
            self._out[p].append(c)
            p = self.link[p]
        if p >= 0:
            q = self.to[p, c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _marked_ancestors(self) -> list[int]:
        """For each state the nearest one on its suffix links, itself included, that meets items; -1: none."""
        up = [-1] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            up[s] = s if s in self.met else (up[self.link[s]] if s else -1)
        return up

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of hashed words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def walk(self, ids: list[int], items: set[str]) -> list[tuple[int, int]]:
        """Hit spans of word offsets in ``ids``, merged; the items met are added to ``items``."""
        spans: list[tuple[int, int]] = []
        to, link, length, up, met = self.to, self.link, self.length, self.up, self.met
        s = n = 0
        for i, c in enumerate(ids):
            t = to.get((s, c))
            while t is None and s:
                s = link[s]
                n = length[s]
                t = to.get((s, c))
            if t is None:
                continue
            s, n = t, n + 1
            a, longest = up[s], 0
            while a > 0:
                for need, found in met[a].items():
                    if need <= n:
                        items |= found
                        longest = max(longest, need)
                a = up[link[a]]
            if longest:
                begin = i + 1 - longest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans


def _runs(known: np.ndarray, rows: np.ndarray, least: int):
    """(begin, end) of runs of known words of one row, at least ``least`` long."""
    if not len(known):
        return []
    label = np.where(known >= 0, rows, -1)
    edge = np.flatnonzero(np.diff(label)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(label)]])
    keep = (label[begin] >= 0) & (end - begin >= least)
    return list(zip(begin[keep].tolist(), end[keep].tolist(), strict=True))


def _scan(automaton: Automaton, texts: pa.Array):
    """For each row: number of words, hit word spans, items met, and byte spans of the hits."""
    for _, data, offs in text_steps(texts):
        low, starts, ends, rows = words(data, offs, ALNUM_WORD)
        n = np.bincount(rows, minlength=len(offs) - 1)
        first = np.concatenate([[0], np.cumsum(n)])
        hits: dict[int, tuple[list, set]] = {}
        known = automaton.known(hash_spans(low, starts, ends)) if len(starts) else np.zeros(0, np.int64)
        for b, e in _runs(known, rows, max(1, automaton.shortest)):
            ids = known[b:e].tolist()
            spans, items = hits.setdefault(int(rows[b]), ([], set()))
            for x, y in automaton.walk(ids, items):
                if all(low[starts[k] : ends[k]].tobytes() == automaton.names[known[k]] for k in range(b + x, b + y)):
                    spans.append((b + x, b + y))
        for r in range(len(offs) - 1):
            spans, items = hits.get(r, ((), ()))
            base, at = first[r], offs[r]
            yield int(n[r]), [(int(x - base), int(y - base)) for x, y in spans], sorted(items), [(int(starts[x] - at), int(ends[y - 1] - at)) for x, y in spans]


def _pieces(bench: DataFrame, item_col: str, text_col: str, window: int, coverage: float, shard_words: int) -> DataFrame:
    """item, need, words: items in pieces of bounded length."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(WORD_RE), 0)
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), found.alias("words")).filter(F.size("words") > 0).distinct()
    items = items.withColumn("need", F.least(F.lit(window), F.greatest(F.lit(1), F.ceil(F.size("words") * F.lit(coverage)))).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(shard_words)), lambda i: F.slice("words", i, F.lit(shard_words - 1) + F.col("need")))
    return items.select("item", "need", F.explode(cut).alias("words")).filter(F.size("words") >= F.col("need")).distinct()


def _parts(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """Pieces of all items with the automaton that each goes into, and the number of automata."""
    pieces = _pieces(bench, item_col, text_col, window, coverage, shard_words)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-total // shard_words))
    if parts > 1:
        parts *= 2
        pieces = staged(pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("int")), "benchmark-parts", keep=True)
    return pieces, parts


def _automaton(pieces: DataFrame) -> Automaton:
    return Automaton([tuple(r) for r in pieces.select("item", "need", "words").collect()])


def _automata(pieces: DataFrame, parts: int):
    """Yield automata of at most about ``2 * shard_words`` words, which together hold all items."""
    for part in range(parts):
        yield _automaton(pieces.filter(F.col("part") == part))


def automata(bench: DataFrame, **limits):
    """Yield the bounded automata of all items."""
    pieces, parts = _parts(bench, **limits)
    return iter([_automaton(pieces)]) if parts == 1 else _automata(pieces, parts)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _hits(shared, only_hit: bool):
    """id, n_words, spans, items of each row of (id, text), or of those that are hit."""

    def scan(batches):
        for batch in batches:
            res = list(_scan(shared.value, batch.column("text")))
            at = np.array([i for i, r in enumerate(res) if r[1] or not only_hit], np.int64)
            spans = pa.array([[{"start": x, "end": y} for x, y in res[i][1]] for i in at], _SPANS)
            cols = [batch.column("id").take(pa.array(at)), pa.array([res[i][0] for i in at], pa.int64()), spans, pa.array([res[i][2] for i in at], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "spans", "items"])

    return scan


def _all_hits(rows: DataFrame, found_by) -> DataFrame:
    """id, n_words, spans, items over all automata of the hit rows of (id, text), ids being unique; each automaton reads the rows once."""
    sc, parts = rows.sparkSession.sparkContext, []
    for automaton in found_by:
        shared = sc.broadcast(automaton)
        parts.append(staged(rows.mapInArrow(_hits(shared, True), f"id bigint, {_HITS}"), "decontamination-hits", keep=True))
        shared.destroy()
    one = parts[0]
    for more in parts[1:]:
        one = one.union(more)
    one = one.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches):
        for batch in batches:
            spans = [[{"start": x, "end": y} for x, y in _merged([(s["start"], s["end"]) for s in own])] for own in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(spans, _SPANS), batch.column("items")], ["id", "n_words", "spans", "items"])

    return one.mapInArrow(merge, f"id bigint, {_HITS}")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_words, spans (word offsets, end exclusive), items for every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces, parts = _parts(bench, **limits)
    if parts == 1:
        shared = spark.sparkContext.broadcast(_automaton(pieces))
        return out.mapInArrow(_hits(shared, False), f"id {kind}, {_HITS}").withColumnRenamed("id", "doc_id")
    rows = staged(out.select(F.monotonically_increasing_id().alias("row"), "id", "text", F.regexp_count(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD_RE)).cast("bigint").alias("n")), "decontamination-rows", keep=True)
    hits = _all_hits(rows.select(F.col("row").alias("id"), "text"), _automata(pieces, parts)).select(F.col("id").alias("row"), "spans", F.array_sort("items").alias("items"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return rows.select("row", "id", "n").join(hits, "row", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"), none("spans", "array<struct<start:int,end:int>>").alias("spans"), none("items", "array<string>").alias("items")
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of word offsets, which are merged and in order."""
    ((_, data, offs),) = text_steps(pa.array([text]))
    _, starts, ends, _ = words(data, offs, ALNUM_WORD)
    raw, kept, at = text.encode(), [], 0
    for x, y in spans:
        kept.append(raw[at : starts[x]])
        at = ends[y - 1]
    return b" ".join(p.strip() for p in [*kept, raw[at:]] if p.strip()).decode()


def _replaced(batch: pa.RecordBatch, changed: dict[int, str], text_col: str, n_chars_col: str | None) -> pa.RecordBatch:
    """The batch with the new texts of some rows, and their lengths."""
    if not changed:
        return batch
    cols = dict(zip(batch.schema.names, batch.columns, strict=True))
    cols[text_col] = pa.array([changed.get(i, t) for i, t in enumerate(cols[text_col].to_pylist())], cols[text_col].type)
    if n_chars_col in cols:
        old = cols[n_chars_col]
        cols[n_chars_col] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(old.to_pylist())], old.type)
    return pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", most: float = 0.5, **limits) -> DataFrame:
    """``docs`` without hit spans; rows of which more than the share ``most`` of words is hit go.

    The share is that of the original text, over all items.  What closes up by
    a cut is scanned again for all items until none is met, so the number of
    automata decides nothing.  Rows without a hit stay as they are.
    ``n_chars_col`` follows the new text.
    """
    pieces, parts = _parts(bench, **limits)
    if parts > 1:
        return _clean_by_parts(docs, pieces, parts, text_col, n_chars_col, most)
    shared = docs.sparkSession.sparkContext.broadcast(_automaton(pieces))

    def scan(batches):
        for batch in batches:
            texts = batch.column(text_col)
            changed, keep = {}, np.ones(len(texts), bool)
            for i, (n, spans, _, _) in enumerate(_scan(shared.value, texts)):
                if not spans:
                    continue
                keep[i] = sum(y - x for x, y in spans) <= most * n
                text = texts[i].as_py()
                while keep[i] and spans:
                    text = _cut(text, spans)
                    found = list(_scan(shared.value, pa.array([text])))
                    spans = found[0][1]
                changed[i] = text
            yield _replaced(batch, changed, text_col, n_chars_col).filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def _clean_by_parts(docs: DataFrame, pieces: DataFrame, parts: int, text_col: str, n_chars_col: str | None, most: float) -> DataFrame:
    """Rounds over all automata: their hits of a row are merged, the share is decided in the first round, and cut rows are met again.

    Rows are written once, and the hit ones once more in each round.
    """
    columns = docs.columns
    row = F.struct(*columns)
    todo = staged(docs.select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"), row.alias("row")), "decontamination-rows", keep=True)
    done, first = None, True

    def cut(batches):
        for batch in batches:
            spans = [[(x["start"], x["end"]) for x in own] for own in batch.column("spans").to_pylist()]
            own = pa.RecordBatch.from_struct_array(batch.column("row"))
            changed = {i: _cut(t, s) for i, (t, s) in enumerate(zip(own.column(text_col).to_pylist(), spans, strict=True))}
            yield _replaced(own, changed, text_col, n_chars_col)

    while True:
        hits = staged(_all_hits(todo.select("id", "text"), _automata(pieces, parts)), "decontamination-hits", keep=True)
        clear = todo.join(hits.select("id"), "id", "left_anti").select("row.*")
        done = clear if done is None else done.union(clear)
        if first:
            hits = hits.filter(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]) <= F.col("n_words") * most)
        if hits.isEmpty():
            return done
        now = todo.join(hits.select("id", "spans"), "id").select("row", "spans").mapInArrow(cut, docs.schema)
        todo, first = staged(now.select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"), row.alias("row")), "decontamination-rows", keep=True), False


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Windows as joined words, met by equality; the words are split as in the operator.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT d.r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) AS s(n), unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT r, i, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
cover AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY 1),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
