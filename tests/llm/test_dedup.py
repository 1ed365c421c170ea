"""Exact dedup, line dedup and near dedup against brute force."""

import hashlib
import re
import time
from collections import defaultdict

import pytest

from wayfold.llm import exact_dedup, line_dedup, near_dedup
from wayfold.llm.components import components
from wayfold.workspace import Workspace

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(frame, odd_docs):
    groups = defaultdict(list)
    for i, t, _ in odd_docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    want = sorted(
        (i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )
    for leaves, fan_in in ((64, 8), (5, 2), (1, 2)):
        got = exact_dedup.exact_dedup(frame(odd_docs), leaves, fan_in).collect()
        assert sorted(map(tuple, got)) == want


def test_exact_dedup_without_ids(frame):
    got = exact_dedup.exact_dedup(frame([(None, "a", None), (7, "a", None), (None, "b", None), (None, "b", None)])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [
        (-1, -1, 2, True),
        (-1, -1, 2, True),
        (-1, 7, 2, False),
        (7, 7, 2, True),
    ]


def test_drop_exact_copies_keeps_columns(frame, odd_docs):
    docs = frame(odd_docs)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert 1 not in ids and 2 not in ids and {0, 3, 9, 10} <= ids
    assert 4 not in ids  # an empty text equals the null text of 3; one space is another text
    assert 5 in ids


def test_exact_dedup_plan_is_native_and_merges_by_order(frame, odd_docs):
    df = exact_dedup.exact_dedup(frame(odd_docs))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    runs = exact_dedup.leaf_runs(exact_dedup.digest_entries(frame(odd_docs)))
    plan = exact_dedup.merge_runs(runs)._jdf.queryExecution().executedPlan().toString()
    # leaves and two rounds, each in part before its exchange and whole after it, from sorted entries
    assert plan.count("SortAggregate(key=[run") == 6 and plan.count("Sort [run") == 6
    assert "HashAggregate" not in plan


def rows_left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_copies_go_by_their_own_text(frame):
    docs = [(3, "alpha beta", None), (5, "alpha beta", None), (5, "quite another text", None), (7, "q", None), (7, "q", None)]
    docs += [(None, "z", None), (None, "z", None), (None, "q", None), (9, None, None), (10, "", None)]
    want = [(3, "alpha beta"), (5, "quite another text"), (7, "q"), (9, None), (None, "z")]
    assert rows_left(exact_dedup.drop_exact_copies(frame(docs))) == sorted(want, key=str)


def test_near_copies_go_by_their_own_text(frame):
    t, u = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    docs = [(3, t, None), (5, t + " x", None), (5, u, None), (9, u + " y", None), (9, u + " y", None), (None, u, None), (None, u, None)]
    docs += [(11, "", None), (12, None, None), (20, t.upper(), None), (3, t.upper(), None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_dedup(frame(docs)).collect())
    assert got == sorted(
        [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False), (-1, -1, True), (-1, -1, True)]
        + [(11, 11, True), (12, 12, True), (20, 3, False), (3, 3, True)]
    )
    left = rows_left(near_dedup.drop_near_copies(frame(docs)))
    assert [x for x in left if x[0] == 3] in ([(3, t)], [(3, t.upper())])  # one row of the group stays
    assert [x for x in left if x[0] != 3] == sorted([(5, u), (11, ""), (12, None), (None, u), (None, u)], key=str)


def test_long_words_are_told_apart(frame):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_dedup(frame([(1, a, None), (2, b, None), (3, a.upper(), None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_a_text_of_some_megabytes(frame):
    lines = [f"line {i} of a text that is very long, word for word" for i in range(60_000)]
    docs = [(1, "\n".join(lines), None)] + [(i, "\n".join(lines[:2]), None) for i in range(2, 7)] + [(7, "x" * 3_000_000, None)]
    assert sorted(map(tuple, line_dedup.line_dedup(frame(docs)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())) == lines_by_hand(docs)
    got = near_dedup.near_dedup(frame(docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 7: 7} | dict.fromkeys(range(2, 7), 2)


def lines_by_hand(docs, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holders = defaultdict(set)
    for i, t, _ in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) > i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(frame, odd_docs):
    got = line_dedup.line_dedup(frame(odd_docs)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == lines_by_hand(odd_docs)
    assert sum(r.n_dropped for r in got) > 5


def test_line_dedup_of_rows_that_repeat_an_id(frame):
    line = "a line of more than forty characters, shared by many"
    docs = [(i, f"x\n{line}\n" + "y\n" * i, None) for i in range(6)] + [(2, line + "\nanother text\n" + line, None)] * 2
    got = line_dedup.line_dedup(frame(docs)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == lines_by_hand(docs)


def test_line_dedup_rows_without_id(frame):
    line = "x" * 50
    got = line_dedup.line_dedup(frame([(None, line, None)] * 7)).collect()
    assert {(r.n_dropped, r.kept_text) for r in got} == {(0, line)}


def shingles(text, k):
    words = [w for w in SPACE.split((text or "").translate(UPPER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_by_hand(docs, k, percent):
    sets = {i: shingles(t, k) for i, t, _ in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    ra, rb = sorted((root(a), root(b)))
                    up[rb] = ra
    return sorted((i, len(sets[i]), root(i), i == root(i)) for i, _, _ in docs)


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(frame, odd_docs, k):
    got = near_dedup.near_dedup(frame(odd_docs), k, 80).collect()
    assert sorted(map(tuple, got)) == near_by_hand(odd_docs, k, 80)


def test_near_dedup_of_a_mixed_group(frame):
    """Copies around 0.8, so that members of a bucket are linked with some and not with others."""
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 14)):
            words[r.randrange(len(words))] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(words), None))
    want = near_by_hand(docs, 4, 80)
    assert 1 < len({c for _, _, c, _ in want}) < len(docs)
    assert sorted(map(tuple, near_dedup.near_dedup(frame(docs), 4, 80).collect())) == want


def test_tiles_cut_small_give_the_same(frame, monkeypatch):
    import random

    r = random.Random(8)
    docs = []
    for i in range(60):
        words = [f"w{j}" for j in range(80)]
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(words), None))
    monkeypatch.setattr(near_dedup, "TILE_SETS", 3)
    assert sorted(map(tuple, near_dedup.near_dedup(frame(docs), 4, 80).collect())) == near_by_hand(docs, 4, 80)


def test_near_dedup_rows_without_id(frame):
    got = near_dedup.near_dedup(frame([(None, "a b c d e f", None), (3, "a b c d e f", None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True)]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = ["abc def  ghi\tjkl mno", "", "x" * 70 + " y", "tail of text", " lead"]
    want = [s.tolist() for s in near_dedup.Shingler(2).sets(pa.array(texts))]
    one_by_one = [s.tolist() for t in texts for s in near_dedup.Shingler(2).sets(pa.array([t]))]
    assert want == one_by_one
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 16)
    small = [s.tolist() for s in near_dedup.Shingler(2).sets(pa.array([texts[0], "", "tail of text", " lead"]))]
    assert small == [want[0], want[1], want[3], want[4]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(205, 203), (203, 209), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, Workspace(spark, "test"), "t").collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)} | {205: 203, 203: 203, 209: 203}
    assert got == want


def test_empty_tables(frame, spark):
    empty = frame([], 1)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test"), "t").count() == 0


def test_a_text_is_hashed_beneath_its_lines(frame, odd_docs):
    plan = line_dedup.long_lines(frame(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("xxhash64") and plan.count("split(") == 1


def test_line_dedup_of_long_texts_takes_linear_time(frame):
    def took(n):
        text = "\n".join(f"line {i} of a text that is very long, word for word, and then goes on" for i in range(n))
        docs, began = frame([(i, text, None) for i in range(6)]), time.perf_counter()
        assert line_dedup.line_dedup(docs).agg({"n_dropped": "sum"}).first()[0] == 5 * n
        return time.perf_counter() - began

    took(100)
    assert took(60_000) <= 2.5 * took(30_000) + 1
