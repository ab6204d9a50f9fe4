"""A Merkle manifest of a dataset, with proofs from stored parent preimages.

Each source is a tree over its rows' digests in the order of doc_id, and a
tree over the sources' subroots gives the root.  ``FAN`` consecutive nodes
become their parent; the parent's preimage is their digests one after the
other.  Trees are built in rounds of ``DEEP`` levels: a block of ``FAN ** DEEP``
consecutive nodes is one group, whose preimages are stored as arrays by level,
and whose top is a node of the next round.  So 2e10 rows take four rounds.

Paths go down the same rounds: the nodes of a round join the preimages of
their block and the path of their block's top.  A node's own 64 characters lie
in its parent's preimage at its place among the children: cut out, the
siblings are left; replaced by another digest, the preimage leads to the root
that this digest would have.

Rows are numbered by range partitions and their counts, so neither a source
that holds most rows nor one with many rows of one id meets in one task.  Groups
and joins go by block: at most ``FAN ** DEEP`` rows have one key.

Defined cases: null columns have a mark of their own, unlike any value; null
doc_ids come first, equal ones by digest, so repeated rows may change places
without a difference; a null source is a source; an empty table has no rows
and no root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, staged, table

FAN, DEEP = 3, 7
BLOCK = FAN**DEEP
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns, each as its UTF-8 length, a colon and its value, or a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]
    return F.sha2(F.concat(*parts), 256)


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (a column ``tree``) with ``i``, their place in their tree by ``order``, and ``depth``, the levels above them.

    One range shuffle sorts all trees at once; a staged copy fixes partitions
    and places, and the counts before each partition make them places in a tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    places = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    places = places.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    places = staged(places, name, keep=True)
    spans = places.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_part = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by_part.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by_part).alias("total"))
    depth = sum(((F.col("total") > FAN**k).cast("int") for k in range(40)), F.lit(0))
    spans = spans.select("tree", "part", "shift", depth.alias("depth"))
    return places.join(spans, ["tree", "part"]).select(*nodes.columns, (F.col("at") + F.col("shift")).alias("i"), "depth")


def _preimages(children: Column) -> Column:
    """The digests of each run of ``FAN`` children as one string."""
    runs = F.sequence(F.lit(0), F.floor((F.size(children) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: F.array_join(F.slice(children, r * FAN + 1, F.lit(FAN)), ""))


def _blocks(nodes: DataFrame, done: int) -> DataFrame:
    """Nodes (tree, i, h, depth) at level ``done`` to blocks: tree, block, depth, p (for each level, the parents' preimages), top."""
    grouped = nodes.groupBy("tree", F.expr(f"i div {BLOCK}").alias("block"), "depth").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("nodes"))
    built = grouped.select("tree", "block", "depth", F.col("nodes.h").alias("h0"))
    for k in range(1, DEEP + 1):
        built = built.withColumn(f"p{k}", F.when(F.col("depth") >= done + k, _preimages(F.col(f"h{k - 1}"))))
        built = built.withColumn(f"h{k}", F.when(F.col("depth") >= done + k, F.transform(f"p{k}", lambda p: F.sha2(p, 256))))
    top = F.coalesce(*(F.col(f"h{k}")[0] for k in range(DEEP, -1, -1)))
    return built.select("tree", "block", "depth", F.array(*(f"p{k}" for k in range(1, DEEP + 1))).alias("p"), top.alias("top"))


@dataclass
class Forest:
    """Trees by rounds of blocks, the lowest first; ``tops``: tree, top."""

    rounds: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, name: str) -> Forest:
    """All trees over ``nodes`` (tree, i, h, depth); the blocks of each round are a table of the shared folder."""
    most = nodes.agg(F.max("depth")).first()[0] or 0
    rounds = []
    while True:
        done = DEEP * len(rounds)
        rounds.append(staged(_blocks(nodes, done), f"{name}-blocks", keep=True))
        if done + DEEP >= most:
            break
        nodes = rounds[-1].filter(F.col("depth") > done + DEEP).select("tree", F.col("block").alias("i"), F.col("top").alias("h"), "depth")
    tops = None
    for k, blocks in enumerate(rounds):
        ended = blocks.filter(F.col("depth") <= DEEP * (k + 1))
        ended = (ended.filter(F.col("depth") > DEEP * k) if k else ended).select("tree", "top")
        tops = ended if tops is None else tops.unionByName(ended)
    return Forest(rounds, tops)


#: An ancestor of a node: the place of the node (or of its ancestor) among the children, and all children's digests.
STEP = "array<struct<slot:int,preimage:string>>"


def _paths(nodes: DataFrame, blocks: DataFrame, above: DataFrame, done: int) -> DataFrame:
    """``nodes`` (tree, i, ...) at level ``done`` with ``path``: ancestors from the parent to the root.  above: tree, block, path."""
    joined = nodes.withColumn("block", F.expr(f"i div {BLOCK}")).join(blocks.select("tree", "block", "p", F.col("depth").alias("levels")).join(above, ["tree", "block"]), ["tree", "block"])
    inside = F.col("i") % BLOCK
    steps = []
    for k in range(1, DEEP + 1):
        slot = F.floor(inside / FAN ** (k - 1)).cast("int")
        at = F.floor(slot / FAN).cast("int")
        step = F.struct((slot % FAN).alias("slot"), F.get(F.get("p", F.lit(k - 1)), at).alias("preimage"))
        steps.append(F.when(F.col("levels") >= done + k, step))
    path = F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()), F.col("path")).cast(STEP)
    return joined.select(*[c for c in nodes.columns if c != "path"], path.alias("path"))


def paths(leaves: DataFrame, forest: Forest, beyond: DataFrame) -> DataFrame:
    """``leaves`` (tree, i, depth, ...) with their paths; beyond: tree, path from the tree's top on."""
    lower = None
    for k in range(len(forest.rounds) - 1, -1, -1):
        blocks = forest.rounds[k]
        ended = blocks.filter(F.col("depth") <= DEEP * (k + 1)).select("tree", "block").join(beyond, "tree")
        above = ended if lower is None else ended.unionByName(lower)
        if not k:
            return _paths(leaves, blocks, above, 0)
        nodes = forest.rounds[k - 1].filter(F.col("depth") > DEEP * k).select("tree", F.col("block").alias("i"))
        lower = _paths(nodes, blocks, above, DEEP * k).select("tree", F.col("i").alias("block"), "path")
    raise AssertionError("a forest has a round at least")


def prove(rows: DataFrame, tree: Column, order: list[str], leaf: Column) -> DataFrame:
    """``rows`` with leaf, subroot, root and path (ancestors' preimages, the row's place in each) in trees by ``tree``.

    The name of a tree is its string, trees are ordered by it, null first.
    Columns of ``rows`` that are so called, or tree, i, depth, are replaced.
    """
    named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))).withColumn("leaf", leaf)
    named = named.drop("subroot", "root", "path", "i", "depth")
    leaves = numbered(named, [*order, "leaf"], "merkle-leaves")
    forest = build(leaves.select("tree", "i", F.col("leaf").alias("h"), "depth"), "merkle")
    tops = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("h"))
    tops = numbered(tops, ["name"], "merkle-sources")
    upper = build(tops.drop("name"), "merkle-top")
    none = upper.tops.select("tree", F.array().cast(STEP).alias("path"))
    beyond = paths(tops, upper, none).join(upper.tops.withColumnRenamed("top", "root"), "tree")
    beyond = staged(beyond.select(F.col("name").alias("tree"), F.col("h").alias("subroot"), "root", "path"), "merkle-paths", keep=True)
    # a tree's subroot is in the path, too, but for a lone row; as trees may be many, they are joined, not broadcast
    proved = paths(leaves, forest, beyond.select("tree", "path"))
    return proved.join(beyond.select("tree", "subroot", "root"), "tree").drop("tree", "i", "depth")


def siblings(path: Column) -> Column:
    """The digests beside a row's ancestors, from its own level to the root, left to right."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * HEX), F.substring(s["preimage"], (s["slot"] + 1) * HEX + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` would give with the siblings of ``path``."""
    splice = lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * HEX + 1, F.lit(HEX)), 256)
    return F.aggregate(path, leaf, splice)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    other = digest(*(tampered if c == "text" else F.col(c) for c in FIELDS))
    changed = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), other)
    rows = docs.select("doc_id", F.col("source"), digest(*(F.col(c) for c in FIELDS)).alias("leaf"), changed.alias("changed"))
    with scratch(spark):
        proved = prove(rows, F.col("source"), ["doc_id"], F.col("leaf"))
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(name: str, leaves: str) -> str:
    """CTEs of DuckDB for trees over ``leaves`` (tree, i, h, other, n): name_up, name_runs and name_climb, whose rows at lvl = top have all."""
    return f"""
{name}_up AS (
  SELECT tree, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, i // 3, n
),
{name}_runs AS (SELECT tree, lvl, i // 3 AS run, list(h ORDER BY i) AS kids FROM {name}_up WHERE n > 1 GROUP BY ALL),
{name}_top AS (SELECT tree, lvl AS top, h AS root FROM {name}_up WHERE n = 1),
{name}_climb AS (
  SELECT tree, i AS leaf_i, 0 AS lvl, i, '' AS proof, other FROM {leaves}
  UNION ALL
  SELECT c.tree, leaf_i, c.lvl + 1, c.i // 3,
    proof || array_to_string(kids[:c.i % 3], '') || array_to_string(kids[c.i % 3 + 2:], ''),
    sha256(array_to_string(kids[:c.i % 3], '') || other || array_to_string(kids[c.i % 3 + 2:], ''))
  FROM {name}_climb c JOIN {name}_runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.run = c.i // 3
)"""


_SQL_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _sql_digest(text: str) -> str:
    """SQL of a row's digest with ``text`` in place of its text."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"


OP13_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_sql_digest("text")} AS h,
    CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_digest("replace(text, chr(10), '')")} ELSE {_sql_digest("text")} END AS other
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed
),{_sql_tree("low", "leaves")},
subroots AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, root AS h, root AS other, count(*) OVER () AS n FROM low_top),
half AS (
  SELECT l.doc_id, l.h AS leaf, s.h AS subroot, s.i AS top_i, c.proof, c.other
  FROM leaves l JOIN low_climb c ON c.tree = l.tree AND c.leaf_i = l.i JOIN low_top t ON t.tree = l.tree AND t.top = c.lvl JOIN subroots s ON s.name = l.tree
),{_sql_tree("high", "subroots")},
above AS (SELECT row_number() OVER () AS k, doc_id, leaf, subroot, top_i, proof, other FROM half),
onward AS (
  SELECT k, 0 AS lvl, top_i AS i, proof, other FROM above
  UNION ALL
  SELECT k, c.lvl + 1, c.i // 3,
    proof || array_to_string(kids[:c.i % 3], '') || array_to_string(kids[c.i % 3 + 2:], ''),
    sha256(array_to_string(kids[:c.i % 3], '') || other || array_to_string(kids[c.i % 3 + 2:], ''))
  FROM onward c JOIN high_runs r ON r.lvl = c.lvl AND r.run = c.i // 3
)
SELECT doc_id, leaf, subroot, root, sha256(o.proof) AS proof_sha256, o.other AS folded_root, o.other = root AS verified
FROM above a JOIN onward o ON o.k = a.k JOIN high_top t ON t.top = o.lvl
"""
