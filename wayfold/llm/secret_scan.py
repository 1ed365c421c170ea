"""Secret scans through a trigram index.

Each rule's regex is parsed and turned into a Boolean query of trigrams that
any match must hold.  Documents are indexed segment by segment: a segment's
postings say which of its documents hold which of the trigrams that some
query names.  The queries are evaluated on the postings, and only the
candidates are verified with the regex.  A rule without mandatory trigrams
verifies every document.  A segment never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.workers import tidy


@dataclass(frozen=True)
class Rule:
    """``regex`` is ASCII only; a match counts if ``group`` has at least ``least`` characters.

    ``find`` gives the same matches where the regex would take quadratic time.
    """

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """All matches that count, leftmost and not overlapping."""
        if self.find:
            yield from self.find(text)
            return
        for m in self.pattern().finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()

    def pattern(self) -> re.Pattern:
        return re.compile(self.regex, re.ASCII | (re.IGNORECASE if self.any_case else 0))


_DOT = re.compile(r"\.(?=eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", re.ASCII)
_PARTS = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.ASCII)
_NO_TOKEN = re.compile(r"[^A-Za-z0-9_-]", re.ASCII)


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``eyJ<10 or more>.eyJ<10 or more>.<10 or more>``, from the first dot; each run is walked twice at most."""
    done = 0
    for m in _DOT.finditer(text):
        dot = m.start()
        if dot < done:
            continue
        run = dot
        while run > done:  # back to where the run before the dot begins, a stretch at a time
            step = max(done, run - 256)
            cuts = [c.end() for c in _NO_TOKEN.finditer(text, step, run)]
            if cuts:
                run = cuts[-1]
                break
            run = step
        start = text.find("eyJ", run, dot)
        if 0 <= start <= dot - 13:
            done = _PARTS.match(text, dot + 1).end()
            yield start, done


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The order is that of the kinds in a listing of spans with one start.
BASE_RULES = (
    Rule("assign", ASSIGN, least=8, group=2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("repo_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", find=web_tokens),
)
RULES = BASE_RULES + MORE_RULES

#: Documents and bytes of a segment.
SEGMENT_DOCS, SEGMENT_BYTES = 1024, 2 << 20

# ---------------------------------------------------------------- regex to query
#: True stands for "any document"; else a set of alternatives, each a set of trigrams that it needs.
Query = bool | frozenset[frozenset[str]]

MOST_STRINGS, MOST_OF_CLASS = 64, 4


def _either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else _least(a | b)


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return _least(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= MOST_STRINGS else min(a, b, key=len)


def _least(a: frozenset) -> frozenset:
    """Without the alternatives that another one covers."""
    return frozenset(x for x in a if not any(y < x for y in a))


def _needs(strings: frozenset[str]) -> Query:
    grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return True if not all(grams) else _least(frozenset(grams))


def _of(tree) -> tuple[frozenset[str] | None, Query]:
    """(all strings that the tree matches or None, the query that any match meets)."""
    strings, query, exact = frozenset({""}), True, True
    for op, arg in tree:
        s, q = _item(op, arg)
        if s is not None and len(strings) * len(s) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in s)
            continue
        query, exact = _both(query, _needs(strings)), False
        strings = s if s is not None else frozenset({""})
        query = _both(query, q) if s is None else query
    return (strings if exact else None), _both(query, _needs(strings))


def _item(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()}), True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 64:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= MOST_OF_CLASS else (None, True)
    if op is sre.SUBPATTERN:
        return _of(arg[3])
    if op is sre.BRANCH:
        found = [_of(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return frozenset().union(*(s for s, _ in found)), True
        query = found[0][1]
        for _, q in found[1:]:
            query = _either(query, q)
        return None, query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = arg
        s, q = _of(body)
        if (least, most) == (0, 1) and s is not None:
            return s | {""}, True
        if least == 0:
            return None, True
        if s is not None and len(s) ** min(least, 8) <= MOST_STRINGS:
            strings = frozenset({""})
            for _ in range(min(least, 8)):
                strings = frozenset(a + b for a in strings for b in s)
            return (strings, True) if least == most <= 8 else (None, _needs(strings))
        return None, q
    return (frozenset({""}), True) if op is sre.AT else (None, True)


def trigram_query(rule: Rule) -> Query:
    """Alternatives of lower-case trigrams of which every match holds one whole."""
    return _of(sre_parser.parse(rule.regex))[1]


# ---------------------------------------------------------------- index
class TrigramIndex:
    """Postings of the trigrams that some rule needs."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        grams = sorted({g for q in self.queries if q is not True for alternative in q for g in alternative})
        self.number = {g: i for i, g in enumerate(grams)}
        self.first = np.zeros(256, dtype=bool)
        self.codes = np.array([int.from_bytes(g.encode("ascii"), "big") for g in grams], dtype=np.uint32)
        for g in grams:
            self.first[[ord(g[0]), ord(g[0].upper())]] = True
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which trigrams (rows) the documents (columns) hold; ``ends`` are the documents' ends in ``data``."""
        held = np.zeros((len(self.codes), len(ends)), dtype=bool)
        at = np.flatnonzero(self.first[data[:-2]]) if len(data) > 2 else np.empty(0, np.int64)
        code = self.lower[data[at]] << 16 | self.lower[data[at + 1]] << 8 | self.lower[data[at + 2]]
        which = np.searchsorted(self.codes, code)
        which[which == len(self.codes)] = 0
        hit = self.codes[which] == code if len(self.codes) else np.zeros(0, bool)
        at, which = at[hit], which[hit]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[doc]
        held[which[inside], doc[inside]] = True
        return held

    def candidates(self, rule: int, held: np.ndarray) -> np.ndarray:
        query = self.queries[rule]
        found = np.full(held.shape[1], query is True)
        if query is not True:
            for alternative in query:
                found |= held[[self.number[g] for g in alternative]].all(axis=0)
        return np.flatnonzero(found)

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule, end) of each text of a segment, sorted."""
        column = column.cast(pa.string())
        n = len(column)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        if not n:
            return spans
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        held = self.postings(data, bounds[1:] - bounds[0])
        texts: dict[int, str] = {}
        for k, rule in enumerate(self.rules):
            for i in self.candidates(k, held).tolist():
                if i not in texts:
                    texts[i] = column[i].as_py() or ""
                spans[i] += [(start, k, end) for start, end in rule.spans(texts[i])]
        for s in spans:
            s.sort()
        return spans


@lru_cache(maxsize=4)
def index_of(rules: tuple[Rule, ...]) -> TrigramIndex:
    return TrigramIndex(rules)


def segments(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(np.cumsum(sizes[at : at + SEGMENT_DOCS]), SEGMENT_BYTES, side="right"))
        n = max(1, n)
        yield batch.slice(at, n)
        at += n


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets): all spans of each document, as array<struct<kind, start, end>>.

    Spans are in code points with exclusive ends, leftmost and not overlapping
    within a kind, sorted by start and then the order of the rules.  A null
    text is empty.  Each row has its own result, whatever its doc_id.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(rules)
        for batch in batches:
            for part in segments(batch):
                found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in index.scan(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found, kind)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>"
    )


MASK = "[SECRET]"


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of overlapping spans as one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, if there, counted again for those texts."""
    schema = docs.schema

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(rules)
        for batch in batches:
            for part in segments(batch):
                spans = index.scan(part.column("text"))
                changed = {i: masked(part.column("text")[i].as_py(), s) for i, s in enumerate(spans) if s}
                columns = dict(zip(part.schema.names, part.columns))
                if changed:
                    texts = part.column("text").to_pylist()
                    for i, t in changed.items():
                        texts[i] = t
                    columns["text"] = pa.array(texts, part.schema.field("text").type)
                    if "n_chars" in columns:
                        counts = columns["n_chars"].to_pylist()
                        for i, t in changed.items():
                            counts[i] = len(t)
                        columns["n_chars"] = pa.array(counts, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(work, schema)


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all secrets in every document; see :func:`find_secrets`."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans from the lengths of what lies between matches."""
    parts = []
    for order, rule in enumerate(RULES):
        regex = rule.regex
        if rule.any_case:
            word = re.match(r"\((.*?)\)", regex)[1]
            regex = regex.replace(word, re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word), 1)
        quoted = regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, {rule.least} AS least,"
            f" regexp_extract_all(t, '{quoted}', {rule.group}) AS g,"
            f" [length(x) for x in regexp_extract_all(t, '{quoted}')] AS m,"
            f" [length(x) for x in string_split_regex(t, '{quoted}')] AS b FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, o, kind, least, g, m, b, unnest(range(1, len(m) + 1)) AS i FROM r),
s AS (
  SELECT doc_id, o, kind, m[i] AS n, CAST(list_sum(b[1:i]) + coalesce(list_sum(m[1:i-1]), 0) AS BIGINT) AS a
  FROM e WHERE length(g[i]) >= least
),
j AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access,
         count(*) FILTER (WHERE o = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (WHERE o <= 2) AS base,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""


ORACLE = _oracle()
