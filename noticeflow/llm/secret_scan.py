"""Secret scans with a trigram inverted index.

Each rule is a regular expression.  From its syntax tree follows a Boolean
query of trigrams that every match holds; a rule whose tree gives none scans
all texts.  Texts are indexed in segments that stay with their texts: for the
trigrams that any rule asks for, the postings list the segment's rows.  A
rule's query intersects and unites postings, and the regular expression runs
over the candidates only.  As index and texts lie in one task, nothing is
shuffled and a lost executor costs its segments alone.

Index and queries fold A-Z, so a query keeps every match in either case.

Defined cases: null and empty texts have no findings; repeated rows have equal
findings; an empty table gives no rows; other columns are ignored; very long
texts are a segment of their own and scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table, text_steps

SEGMENT_BYTES = 4 << 20
#: Literal alternatives followed through a rule before its query is cut.
MOST_STRINGS = 64
MOST_CLASS = 6


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", ignore_case=True),
)
RULES = BASE_RULES + MORE_RULES


# A query is None (everything), or a frozenset of alternatives, each a frozenset of trigrams that it needs.


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _either(a, b):
    if a is None or b is None:
        return None
    every = a | b
    return frozenset(x for x in every if not any(y < x for y in every))


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return _either(frozenset(x | y for x in a for y in b), frozenset()) if len(a) * len(b) <= MOST_STRINGS**2 else min(a, b, key=len)


def _of_strings(strings: frozenset[str]):
    query = frozenset()
    for s in strings:
        query = _either(query, frozenset([g]) if (g := _grams(s)) else None)
    return query


def _fold(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _walk(tree):
    """(all strings that the tree can match, or None; a query that its matches meet)."""
    query, run = None, frozenset([""])
    for i, (op, arg) in enumerate(tree):
        strings, inner = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        # the strings so far end here; what follows starts anew, and the whole is no list of strings any more
        follows, rest = _walk(tree[i + 1 :])
        for part in (_of_strings(run), inner, None if follows is None else _of_strings(follows), rest):
            query = _both(query, part)
        return None, query
    return run, _of_strings(run)


def _node(op, arg):
    if op is sre.LITERAL:
        folded = _fold(arg)
        return (frozenset([folded]), None) if folded is not None else (None, None)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, v in arg:
            codes = [v] if kind is sre.LITERAL else range(v[0], v[1] + 1) if kind is sre.RANGE else None
            if codes is None or any(c > 127 for c in codes):
                return None, None
            chars |= {_fold(c) for c in codes}
        return (frozenset(chars), None) if len(chars) <= MOST_CLASS else (None, None)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(b) for b in arg[1]]
        strings = frozenset().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        query = frozenset()
        for p in parts:
            query = _either(query, p[1])
        return strings, query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _walk(inner)
        if strings is not None and most == 1:
            return (strings | {""} if least == 0 else strings), (None if least == 0 else query)
        return None, (query if least else None)
    return None, None


def trigram_query(rule: Rule):
    """Alternatives of trigrams, one of which lies in every match's folded text; None if there is none to ask for."""
    _, query = _walk(sre_parser.parse(rule.pattern, re.ASCII))
    return query


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """The postings of a segment's texts: trigram -> rows, for the wanted trigrams."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, wanted: np.ndarray):
        self.rows = len(offs) - 1
        low = LOWER[data].astype(np.uint32)
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[row + 1]
        pair = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        gram, row = pair >> 32, pair & 0xFFFFFFFF
        cut = np.flatnonzero(np.diff(gram, prepend=-1))
        self.postings = dict(zip(gram[cut].tolist(), np.split(row, cut[1:]), strict=True)) if len(cut) else {}

    def find(self, query) -> np.ndarray:
        """Rows that meet the query."""
        if query is None:
            return np.arange(self.rows)
        none, found = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
        for grams in query:
            lists = sorted((self.postings.get(_code(g), none) for g in grams), key=len)
            rows = lists[0]
            for other in lists[1:]:
                rows = np.intersect1d(rows, other, assume_unique=True)
            found.append(rows)
        return np.unique(np.concatenate(found))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings, an array of (kind, start, end) in code points, by start and then in the rules' order."""
    queries = [trigram_query(r) for r in rules]
    grams = sorted({_code(g) for q in queries if q is not None for alt in q for g in alt})

    def run(batches):
        wanted = np.zeros(1 << 24, bool)
        wanted[grams] = True
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            texts, found = batch.column("text"), [[] for _ in range(len(batch))]
            for first, data, offs in text_steps(texts, SEGMENT_BYTES):
                segment, cache = Segment(data, offs, wanted), {}
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for row in segment.find(query).tolist():
                        text = cache.get(row) or cache.setdefault(row, texts[first + row].as_py() or "")
                        for m in pattern.finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[first + row].append((m.start(), k, m.end()))
            out = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "findings"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, findings array<struct<kind:string,start:int,end:int>>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(joined(F.filter("findings", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )
