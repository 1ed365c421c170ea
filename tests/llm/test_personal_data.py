"""Personal data: patterns against plain regexes, the tagger against its own slow forms, whole queries."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from wayfold.llm import char_tagger, personal_data
from wayfold.llm.char_tagger import PAD, Tagger, padded
from wayfold.llm.personal_data import KINDS, STRIDE, WINDOW, base_spans

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
    if kind == 2:
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if fits(k, m[0])]


def planted(n, seed=3):
    """Texts with one span each, and what the span is."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        card = "".join(str(r.randrange(10)) for _ in range(15))
        own = [
            f"{r.choice('abcdef')}{r.choice('ghij')}{i}@mail{r.randrange(9)}.example.com",
            ".".join(str(r.randrange(256)) for _ in range(4)),
            personal_data.with_check_digit("4" + card),
            f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}",
        ][i % 4]
        before, after = (" ".join(r.choice(["the", "river", "stone", "and", "house."]) for _ in range(r.randrange(3, 30))) for _ in "ab")
        out.append((i, f"{before} {own} {after}", len(before) + 1, len(before) + 1 + len(own)))
    return out


@pytest.fixture(scope="session")
def tagger():
    rows = [(i % 4, t[max(0, a - 20) : b + 20], min(a, 20), min(a, 20) + b - a) for i, t, a, b in planted(160)]
    return char_tagger.train(personal_data.examples(rows), KINDS, epochs=6)


def test_base_spans_are_those_of_the_regexes():
    r = random.Random(1)
    for _ in range(6000):
        text = "".join(r.choice("aA0123456789019.@+-_% ()é\n") for _ in range(r.randrange(1, 50)))
        assert base_spans(text) == brute(text), text
        parts = ["1", "255", "256", "0", "00012", ".", "@", "a", "-", "+1", "4111111111111111", " ", "x.y"]
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        assert base_spans(text) == brute(text), text


def test_base_spans_take_linear_time():
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", "a.", "+1 ("):
        text, began = unit * (1_000_000 // len(unit)), time.perf_counter()
        base_spans(text + "@")
        assert time.perf_counter() - began < 10, unit


def test_gradients_are_those_of_the_loss():
    t, rng = Tagger.fresh(("a", "b"), 5, 3, np.float64), np.random.default_rng(0)
    x, lengths = rng.integers(0, PAD, (3, 7)), np.array([7, 4, 1])
    gold = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 3, 0, 0, 0], [0] * 7])
    for i, n in enumerate(lengths):
        x[i, n:] = PAD
    _, grads = t.gradients(x, gold, lengths)
    for name, w in t.weights.items():
        for _ in range(5):
            at = tuple(int(rng.integers(s)) for s in w.shape)
            at = (int(x[0, rng.integers(7)]), at[1]) if name.startswith("in_") else at
            old, step = w[at], 1e-5
            w[at] = old + step
            up = t.gradients(x, gold, lengths)[0]
            w[at] = old - step
            down = t.gradients(x, gold, lengths)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-6, name


def test_tags_and_probabilities_are_those_of_all_paths():
    t, rng = Tagger.fresh(("a",), 4, 1, np.float64), np.random.default_rng(2)
    for name in ("move", "start"):
        t.weights[name] += rng.normal(0, 1, t.weights[name].shape)
    x, lengths = padded([rng.integers(0, 128, n) for n in (5, 3, 1)])
    scores = t.scores(x, lengths)
    tags, (gamma, _, log_z) = t.best(scores, lengths), t.marginals(scores, lengths)
    move, start = t.moves()
    total = 0.0
    for i, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        value = [start[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:])) + sum(scores[i, j, k] for j, k in enumerate(p)) for p in paths]
        z = np.exp(value).sum()
        total += np.log(z)
        assert tags[i, :n].tolist() == list(paths[int(np.argmax(value))])
        for j in range(n):
            for k in range(3):
                share = sum(np.exp(v) for p, v in zip(paths, value) if p[j] == k) / z
                assert abs(gamma[i, j, k] - share) < 1e-9
    assert abs(log_z - total) < 1e-9


def test_scores_do_not_depend_on_the_batch(tagger):
    texts = ["call (743) 555-3824 now", "x", "a longer text without anything in it at all, word after word"]
    together = personal_data.tag_windows(tagger, texts)
    assert [[s[:3] for s in own] for own in together] == [[s[:3] for s in personal_data.tag_windows(tagger, [t])[0]] for t in texts]


def test_windows_cover_each_anchor_with_room():
    for length in (1, 50, WINDOW, WINDOW + 1, 1000, 5003):
        for at in range(0, length, 7):
            numbers = personal_data.window_numbers(np.array([at]), length).tolist()
            held = [n for n in numbers if n * STRIDE <= at < n * STRIDE + WINDOW]
            every = [n for n in range(0, length) if n * STRIDE < max(1, length - WINDOW + STRIDE) and n * STRIDE <= at < n * STRIDE + WINDOW]
            assert held == every and numbers == sorted(set(numbers)) and numbers[-1] * STRIDE < length


def test_spans_of_windows_are_put_together():
    # cut by the border of the first window, whole in the second; and one that no window holds whole
    whole = [(0, [(3, 100, 110, 0.9), (0, 150, 160, 0.8)]), (STRIDE, [(3, 4, 14, 0.95), (0, 54, 75, 0.9)])]
    assert personal_data.merged(whole, 400) == [(0, 150, 171, 0.8), (3, 100, 110, 0.95)]
    long = [(0, [(0, 90, 160, 0.9)]), (STRIDE, [(0, 0, 160, 0.7)]), (2 * STRIDE, [(0, 0, 100, 0.8)])]
    assert personal_data.merged(long, 1000) == [(0, 90, 292, 0.7)]
    assert personal_data.merged([(0, [(1, 150, 160, 0.9)]), (STRIDE, [])], 400) == []  # the neighbour knows better
    assert personal_data.merged([(0, [(1, 150, 160, 0.9)])], 160) == [(1, 150, 160, 0.9)]


def test_the_best_set_is_that_of_all_subsets():
    r = random.Random(4)
    for _ in range(200):
        spans = [(r.randrange(4), a := r.randrange(30), a + r.randrange(1, 9), r.random()) for _ in range(r.randrange(9))]
        value = lambda own: sum(p * (b - a) for _, a, b, p in own)
        clear = lambda own: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(own, 2))
        most = max(value(own) for n in range(len(spans) + 1) for own in itertools.combinations(spans, n) if clear(own))
        got = personal_data.best_set(spans)
        assert clear(got) and abs(value(got) - most) < 1e-9


def test_the_model_adds_forms_that_the_patterns_miss(tagger):
    r, hits, n = random.Random(8), 0, 0
    rng = np.random.default_rng(5)
    for i, text, a, b in planted(160, seed=11):
        own = personal_data.variant(i % 4, text[a:b], rng)
        if base_spans(f"{text[:a]}{own}{text[b:]}"):
            continue
        text = f"{text[:a]}{own}{text[b:]}"
        at = np.array([k for k, c in enumerate(text) if c in "0123456789@"])
        found = personal_data.added_spans(tagger, [text], [at], [[]])[0]
        n += 1
        hits += (i % 4, a, a + len(own)) in found
        assert all(personal_data.plausible(*s[:1], text, *s[1:]) for s in found)
    assert n > 40 and hits >= 0.5 * n
    clean = [f"It was {r.randrange(1900, 2000)}-0{r.randrange(1, 9)}-1{r.randrange(9)} and cost {r.randrange(99)}.{r.randrange(10, 99)}, see page {r.randrange(999)}." for _ in range(200)]
    at = [np.array([k for k, c in enumerate(t) if c.isdigit()]) for t in clean]
    assert sum(map(len, personal_data.added_spans(tagger, clean, at, [base_spans(t) for t in clean]))) <= 2


def test_added_spans_overlap_no_base_span(tagger):
    texts = [t for _, t, _, _ in planted(40, seed=2)]
    at = [np.array([k for k, c in enumerate(t) if c in "0123456789@"]) for t in texts]
    base = [base_spans(t) for t in texts]
    for b, more in zip(base, personal_data.added_spans(tagger, texts, at, base)):
        assert all(y[2] <= x[1] or x[2] <= y[1] for x in b for y in more)


def test_find_personal_data(frame, odd_docs, tagger):
    long = "words " * 30_000 + "a.b@c.example.org" + " more" * 30_000 + " +1 (743) 555-3824 é 10.2.3.4" + "1" * 5000
    docs = [(i, t) for i, t, _ in odd_docs] + [(100 + i, t) for i, t, _, _ in planted(30)] + [(None, "x@y.zz"), (None, "x@y.zz"), (500, long), (500, long)]
    got = personal_data.find_personal_data(frame([(i, t, "en") for i, t in docs], 5), tagger).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    listed = lambda own: [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in own]
    assert sorted(((r.doc_id, listed(r.base)) for r in got), key=key) == sorted(((i, brute(t)) for i, t in docs), key=key)
    for r in got:
        assert set(listed(r.base)) <= set(listed(r.spans)) and listed(r.spans) == sorted(listed(r.spans))
    assert personal_data.find_personal_data(frame([]), tagger).count() == 0


def test_query(spark, tmp_path, frame, monkeypatch):
    monkeypatch.setattr(char_tagger, "EPOCHS", 1)
    docs = [(i, t, "en") for i, t, _, _ in planted(60)] + [(900, None, None), (901, "clean text", "en")]
    frame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in personal_data.op11_personal_data(spark, str(tmp_path)).collect()}
    assert set(rows) == {i for i, _, _ in docs}
    for i, text, _ in docs:
        base = brute(text)
        text_of = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(text_of.encode()).hexdigest()
        assert set(text_of.split(",")) <= set(r.spans.split(",")) | {""}


def test_a_table_without_spans_teaches_nothing(frame):
    docs = frame([(1, "no numbers here", "en"), (2, None, None), (3, "in 1999 and 2001", "en")])
    assert personal_data.learn(docs) is None
    assert all(r.spans == [] for r in personal_data.find_personal_data(docs, None).collect())


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(frame):
    docs = [(i, t, "en") for i, t, _, _ in planted(80)] * 2
    few, many = personal_data.sample(frame(docs, 1), 7), personal_data.sample(frame(docs, 9), 7)
    assert few == many and [sum(k == x for k, *_ in few) for x in range(4)] == [7] * 4
