"""Vector search and secret scans against brute force."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import secret_scan, vector_search
from wayfold.llm.secret_scan import RULES, Rule, TrigramIndex, trigram_query


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string, shard int").repartition(3)


def brute(rows, asked, k):
    kept = {}
    for i, e, *_ in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = (len(e), tuple(math.floor(256 * float(np.float32(x))) for x in e))
        kept[i] = min(kept.get(i, v), v)
    out = []
    for q in sorted(kept):
        if not asked(q):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(kept[q][1], v[1])), i) for i, v in kept.items() if i != q and v[0] == kept[q][0]
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("shard", "leaf", "block", "group"), [(8192, 64, 512, 8), (40, 4, 7, 2), (25, 1, 3, 1)])
def test_top_k(spark, monkeypatch, shard, leaf, block, group):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("BLOCK", block), ("GROUP", group)):
        monkeypatch.setattr(vector_search, name, value)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], 1, "x", 2) for i in range(200)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0], 1, "x", 2) for i in range(40)]  # one common vector: ties to the smaller id
    rows += [(400, None, 1, "x", 2), (401, [1.0, None, 2.0, 3.0], 1, "x", 2), (402, [float("nan")] * 4, 1, "x", 2), (403, [], 1, "x", 2)]
    rows += [(404, [float("inf")] * 4, 1, "x", 2), (None, [1.0] * 4, 1, "x", 2), (500, [1.0, 2.0], 1, "x", 2), (7, [2.0] * 4, 1, "x", 2)]
    v = vector_search.quantised(vectors(spark, rows))
    from pyspark.sql import functions as F

    got = vector_search.top_k(v, v.filter(F.col("vec_id") % 10 == 0), 5).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda q: q % 10 == 0, 5))


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 1, "x", 2), (1, [0.5, -1.0], 1, "x", 2)]
    v = vector_search.quantised(vectors(spark, rows))
    assert sorted(map(tuple, vector_search.top_k(v, v, 5).collect())) == sorted(brute(rows, lambda q: True, 5))
    none = vector_search.quantised(vectors(spark, []))
    assert vector_search.top_k(none, none, 5).count() == 0


def test_large_components_stay_exact():
    ids, v = np.arange(6), np.array([[2**30 + i, -(2**29)] for i in range(6)])
    best = [[]]
    vector_search.KDTree(ids, v).search(np.array([[2**31, 3]]), np.array([99]), 2, best)
    assert sorted(best[0]) == [((2**30 + 4) * 2**31 - 3 * 2**29, -4), ((2**30 + 5) * 2**31 - 3 * 2**29, -5)]


def test_scores_beyond_64_bits(spark):
    rows = [(0, [2.0**54, 1.0], 1, "x", 2), (1, [2.0**50, 5.0], 1, "x", 2), (2, [-(2.0**50), 2.0], 1, "x", 2), (3, [1e30, 2.0], 1, "x", 2)]
    v = vector_search.quantised(vectors(spark, rows))
    got = sorted(map(tuple, vector_search.top_k(v, v, 2).collect()))
    top, low = 2**63 - 1, -(2**63)
    assert got == [(0, 1, 1, top), (0, 2, 2, low), (1, 1, 0, top), (1, 2, 2, low), (2, 1, 0, low), (2, 2, 1, low)]


def test_web_tokens_are_those_of_the_regex_in_linear_time():
    rule = next(r for r in RULES if r.kind == "web_token")
    r = random.Random(1)
    parts = ["eyJ", "eyJ" + "a" * 9, "eyJ" + "b" * 10, ".", "..", "-eyJ" + "c" * 12, "d" * 10, " ", "eyJ" + "e" * 300, ".eyJ" + "f" * 10 + "."]
    for _ in range(5000):
        text = "".join(r.choices(parts, k=r.randrange(1, 9)))
        assert list(rule.spans(text)) == [m.span() for m in rule.pattern().finditer(text)]
    began = time.perf_counter()
    for text in ("eyJ" * 1_500_000, ("eyJ" + "a" * 12 + ".") * 300_000, (".eyJ" + "a" * 11 + ".b") * 200_000):
        list(rule.spans(text))
    assert time.perf_counter() - began < 30


def spans_by_hand(text, rules=RULES):
    out = []
    for k, rule in enumerate(rules):
        for m in rule.pattern().finditer(text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_queries_of_the_rules():
    found = {r.kind: trigram_query(r) for r in RULES}
    assert found["hex"] is True
    assert found["access"] == frozenset({frozenset({"aki", "kia"})})
    assert frozenset({"tok", "oke", "ken"}) in found["assign"] and len(found["assign"]) == 6


PIECES = st.sampled_from(
    ["password", "PassWD", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abcdefgh", "x1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "ſecret", "\n", "ghp_", "a" * 40, "xoxb-", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----"]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_the_index_loses_nothing(texts):
    got = TrigramIndex(RULES).scan(pa.array(texts, pa.string()))
    assert got == [spans_by_hand(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_any_match_meets_the_query(data):
    regex = data.draw(st.sampled_from([r"ab(cd|ef)+gh", r"(foo|bar)baz?", r"x{3,5}yz", r"(abc)?def[gh]i", r"a.cdef", r"[abc]{2}defg", r"(?:one|two|three)four"]))
    text = data.draw(st.from_regex(re.compile(regex, re.ASCII), fullmatch=True))
    query = trigram_query(Rule("t", regex))
    grams = {text.lower()[i : i + 3] for i in range(len(text) - 2)}
    assert query is True or any(need <= grams for need in query)


def test_find_and_mask(frame, odd_docs):
    docs = frame(odd_docs)
    got = secret_scan.find_secrets(docs).collect()
    want = [(i, [(RULES[k].kind, a, b) for a, k, b in spans_by_hand(t)]) for i, t, _ in odd_docs]
    assert sorted((r.doc_id, [tuple(s) for s in r.secrets]) for r in got) == sorted(want)
    masked = secret_scan.mask_secrets(docs)
    assert masked.schema == docs.schema
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[13].text == '[SECRET]" [SECRET] [SECRET]' and rows[13].n_chars == len(rows[13].text)
    assert rows[3].text is None and rows[0].text == odd_docs[0][1] and rows[0].n_chars == len(odd_docs[0][1])


def test_overlapping_spans_are_one_mask():
    assert secret_scan.masked("ab password=abcdefgh cd", [(3, 0, 20), (12, 2, 20)]) == "ab [SECRET] cd"


def test_empty(frame):
    assert secret_scan.find_secrets(frame([], 1)).count() == 0
    assert secret_scan.mask_secrets(frame([], 1)).count() == 0
