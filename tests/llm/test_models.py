"""Language ID and LM scoring against naive inference, and on held-out data."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa

from wayfold.llm import language_id, lm_score

SF = "/root/testdata/sf0.01"


def toy_crf():
    chains = [("en", "the house of the river".split()), ("fr", "la maison de la rivière".split()), ("de", "das haus und der fluss".split())] * 8
    return language_id.train(chains, rounds=15)


def test_marginals_are_those_of_all_paths():
    crf = toy_crf()
    rng = np.random.default_rng(1)
    crf.transition, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(2, 4, 3))
    gamma, pairs, log_z = crf.marginals(scores, np.array([4, 2]))
    want_pairs = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        weight = {
            path: math.exp(crf.start[path[0]] + sum(scores[c, t, path[t]] for t in range(n)) + sum(crf.transition[path[t], path[t + 1]] for t in range(n - 1)))
            for path in itertools.product(range(3), repeat=n)
        }
        z = sum(weight.values())
        assert math.isclose(log_z[c], math.log(z), rel_tol=1e-9)
        for t in range(n):
            for k in range(3):
                assert math.isclose(gamma[c, t, k], sum(w for p, w in weight.items() if p[t] == k) / z, rel_tol=1e-9)
        for p, w in weight.items():
            for t in range(n - 1):
                want_pairs[p[t], p[t + 1]] += w / z
    assert (gamma[1, 2:] == 0).all()
    assert np.allclose(pairs, want_pairs)


def test_labels_do_not_depend_on_batches_or_chains(monkeypatch):
    crf = toy_crf()
    texts = ["the house " * 300, None, "", "1 ² ½ _ 3", "la maison de la rivière", "das haus the river la " * 90] * 3
    want = language_id.Labeller(crf).label(texts)
    for name, value in (("BATCH_WORDS", 128), ("CACHE_WORDS", 4), ("CHAIN", 7), ("CHAIN", 1 << 20)):
        monkeypatch.setattr(language_id, name, value)
        got = language_id.Labeller(crf).label(texts)
        for (a, *x), (b, *y) in zip(want, got):
            assert a == b and np.allclose(x, y, rtol=1e-9)
    assert [w[0] for w in want[:5]] == ["en", "und", "und", "und", "fr"] and want[1][1] == 0.0


def test_scores_are_those_of_the_whole_chain():
    """The query's label and score from one forward-backward pass in plain Python."""
    crf = toy_crf()
    text = "the house la maison das haus the river de la der fluss " * 30
    words = language_id.words_of(text)
    scores = crf.emissions(words)[0]
    k = len(crf.languages)
    alpha = [[crf.start[j] + scores[0, j] for j in range(k)]]
    for t in range(1, len(words)):
        alpha.append([np.logaddexp.reduce([alpha[-1][i] + crf.transition[i, j] for i in range(k)]) + scores[t, j] for j in range(k)])
    beta = [[0.0] * k]
    for t in range(len(words) - 1, 0, -1):
        beta.append([np.logaddexp.reduce([crf.transition[i, j] + scores[t, j] + beta[-1][j] for j in range(k)]) for i in range(k)])
    beta.reverse()
    z = np.logaddexp.reduce(alpha[-1])
    mean = np.exp(np.array(alpha) + np.array(beta) - z).mean(axis=0)
    lang, score, _ = language_id.Labeller(crf).label([text])[0]
    assert lang == crf.languages[mean.argmax()] and math.isclose(score, mean.max(), rel_tol=1e-9)


def test_gibberish_goes_and_mixed_texts_stay(spark):
    import random
    import string

    r = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.lang: x.text for x in docs.orderBy("doc_id").collect() if x.text and len(x.text) > 300}
    gibberish = " ".join("".join(r.choices(string.ascii_lowercase, k=r.randrange(2, 11))) for _ in range(80))
    more = [(10**6, gibberish, None, None, None), (10**6 + 1, "\n".join(t[:200] for t in texts.values()), None, None, None)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    assert {x.doc_id for x in both.select("doc_id").subtract(language_id.keep_identified(both).select("doc_id")).collect()} == {10**6}


def test_code_switched_words_are_labelled_apart():
    crf = toy_crf()
    words = "the house of la maison de".split()
    gamma, _, _ = crf.marginals(crf.emissions(words)[0][None], np.array([len(words)]))
    assert [crf.languages[k] for k in gamma[0].argmax(axis=1)] == ["en"] * 3 + ["fr"] * 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_identify_odd_documents(frame, odd_docs):
    docs = frame(odd_docs)
    got = language_id.identify(docs, language_id.learn(docs))
    assert got.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score", "lang_known"]
    by_id = {r.doc_id: (r.lang_pred, r.lang_score) for r in got.collect()}
    for i in (3, 4, 5, 6):
        assert by_id[i] == ("und", 0.0)
    assert by_id[0][0] in ("en", "de", "fr")
    kept = language_id.keep_identified(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, _, _ in odd_docs} - {3, 4, 5, 6}
    assert {r.lang_pred for r in kept.collect()} == {"q"}  # the caller's own column


def test_nothing_to_learn_from(frame):
    docs = frame([(1, "some words", None), (2, None, "en")])
    assert language_id.learn(docs) is None and language_id.keep_identified(docs).count() == 2
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(frame([], 1), None).count() == 0


def test_more_languages_than_sixty_four(frame):
    import hashlib

    def word(lang, n):
        return "".join(chr(97 + int(c, 16)) for c in hashlib.md5(f"{lang} {n}".encode()).hexdigest()[:7])

    docs = frame([(8 * i + j, " ".join(word(i, (j + k) % 5) for k in range(12)), f"l{i:02}") for i in range(70) for j in range(8)])
    crf = language_id.learn(docs)
    assert len(crf.languages) == 70
    found = language_id.Labeller(crf).label([" ".join(word(i, k) for k in range(5)) for i in range(70)])
    assert sum(f[0] == f"l{i:02}" for i, f in enumerate(found)) >= 65


def tokens_by_hand(text):
    import regex

    unspaced = "".join(f"{chr(a)}-{chr(b)}" for a, b in lm_score.TokenHasher.UNSPACED)
    return regex.findall(rf"(?V1)[[\p{{L}}\p{{M}}\p{{N}}]--[{unspaced}]--[\U00010000-\U0010FFFF]]+|[^\p{{Z}}\s\x1c-\x1f]", text)


def test_tokens_do_not_depend_on_blocks(monkeypatch):
    texts = ["The cat, the CAT.", "", None, "naïve (x) 12a ÉTÉ été", "x" * 50 + " y!", "東京は大きい。 ok สวัสดี", "a\u00a0b—c 🙂🙂d", "é" * 300 + "z" * 90]
    column = pa.array(texts)
    h, ends = lm_score.TokenHasher().tokens(column)
    found = [tokens_by_hand(t or "") for t in texts]
    assert np.diff(ends, prepend=0).tolist() == [len(f) for f in found]
    flat = [w.lower() for f in found for w in f]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 64)
    h2, ends2 = lm_score.TokenHasher().tokens(column)
    assert ends2.tolist() == ends.tolist() and (h == h2).all()


def net_and_line(n=60):
    rng = np.random.default_rng(0)
    net = lm_score.Network.fresh(rng.integers(1, 50, lm_score.IDS).astype(float))
    ids = np.where(rng.random(n) < 0.5, rng.integers(1, lm_score.TAIL, n), rng.integers(lm_score.TAIL, lm_score.IDS, n))
    return net, *lm_score.padded(ids, np.array([n // 3, n // 3, n]))


def whole_table(net, line, at):
    """Log probabilities of all ids at one place."""
    x = np.concatenate([net.vectors[line[at + d]] for d in lm_score.WINDOW])
    h = np.append(np.tanh(x @ net.mix[:-1] + net.mix[-1]), 1)

    def logs(weights):
        z = weights @ h
        return z - np.log(np.exp(z).sum())

    classes = logs(net.classes)
    n, m = lm_score.PER_CLASS, lm_score.PER_BUCKET
    places = np.concatenate([classes[c] + logs(net.places[c * n : c * n + n]) for c in range(lm_score.CLASSES)])
    words = [places[lm_score.TAIL + b] + logs(net.words[b * m : b * m + m]) for b in range(lm_score.BUCKETS)]
    return np.concatenate([places[: lm_score.TAIL], *words])


def test_log_probs_are_those_of_the_whole_table():
    net, line, place = net_and_line()
    got = net.log_probs(line, place)
    for at, g in zip(place, got):
        table = whole_table(net, line, at)
        assert math.isclose(np.exp(table).sum(), 1, rel_tol=1e-4)
        assert math.isclose(g, table[line[at]], rel_tol=1e-4, abs_tol=1e-4)


def test_large_weights_do_not_overflow():
    net, line, place = net_and_line()
    net.places[:, -1] += 200
    calm = net.log_probs(line, place)
    net.places[:, -1] -= 200  # a shift of all places changes no softmax
    assert np.isfinite(calm).all() and np.allclose(calm, net.log_probs(line, place), atol=1e-3)
    net.places[:, -1] += 200
    net.learn(line, place)
    assert all(np.isfinite(t).all() for t in net.tables.values())


def test_steps_go_along_the_gradient(monkeypatch):
    """With equal rates a small step raises the likelihood by rate times the squared gradient."""
    monkeypatch.setattr(lm_score, "RATE", 1e-3)
    net, line, place = net_and_line(300)
    for s in net.squares.values():
        s[:] = 1e8  # so that rows' own squares don't matter
    before = {k: t.astype(np.float64) for k, t in net.tables.items()}
    low = net.log_probs(line, place).sum()
    net.learn(line, place)
    rate = 1e-3 / 1e4
    norm = sum((((t - before[k]) / rate) ** 2).sum() for k, t in net.tables.items())
    for k, t in net.tables.items():
        t[:] = before[k] + 1e4 * (t - before[k])
    high = net.log_probs(line, place).sum()
    assert 0.5 * 1e4 * rate * norm < high - low < 1.5 * 1e4 * rate * norm


def test_a_step_is_the_plain_gradient_and_changes_each_table_once(monkeypatch):
    """The same step from one softmax after the other; its cost is no multiple of the number of groups."""
    monkeypatch.setattr(lm_score, "CACHED", 7, raising=False)
    net, line, place = net_and_line(400)
    line[place[::5]] = line[place[0]]  # a run of rows longer than a part
    place = place[3:]
    tables = {k: t.astype(np.float64) for k, t in net.tables.items()}
    gradients = {k: np.zeros_like(t) for k, t in tables.items()}
    for at in place:
        around = line[at + np.array(lm_score.WINDOW)]
        x = np.append(np.concatenate(tables["vectors"][around]), 1)
        h = np.append(np.tanh(x @ tables["mix"]), 1)
        spot = int(lm_score.PLACE[line[at]])
        group, back = spot // lm_score.PER_CLASS, 0
        softmaxes = [("classes", 0, lm_score.CLASSES, group), ("places", group * lm_score.PER_CLASS, lm_score.PER_CLASS, spot % lm_score.PER_CLASS)]
        if line[at] >= lm_score.TAIL:
            bucket, word = divmod(int(line[at]) - lm_score.TAIL, lm_score.PER_BUCKET)
            softmaxes.append(("words", bucket * lm_score.PER_BUCKET, lm_score.PER_BUCKET, word))
        for table, first, size, which in softmaxes:
            weights = tables[table][first : first + size]
            e = np.exp(weights @ h)
            d = (np.arange(size) == which) - e / e.sum()
            gradients[table][first : first + size] += d[:, None] * h
            back = back + d @ weights
        dx = back[:-1] * (1 - h[:-1] ** 2)
        gradients["mix"] += x[:, None] * dx
        np.add.at(gradients["vectors"], around, (tables["mix"][:-1] @ dx).reshape(len(around), -1))
    steps, step = [], lm_score.Network._step
    monkeypatch.setattr(lm_score.Network, "_step", lambda self, table, *a: (steps.append(table), step(self, table, *a)))
    net.learn(line, place)
    for k, g in gradients.items():
        squares = lm_score.DAMP + (g**2).mean(axis=1)
        assert np.allclose(net.squares[k], squares, rtol=1e-3, atol=1e-5)
        assert np.allclose(net.tables[k], tables[k] + g * lm_score.RATE / np.sqrt(squares)[:, None], rtol=1e-3, atol=1e-4)
    assert sorted(steps) == sorted(net.tables)  # one step of a table was as many as it had groups


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(3)
    near = np.array([0, 1, 2, 1 << 20, (1 << 64) - 1, (1 << 64) - 3], dtype=np.uint64)  # many of the same first bits
    for words in (np.unique(np.concatenate([near, rng.integers(0, 1 << 64, 3000, dtype=np.uint64)])), near[:1], near[4:5], near[:0]):
        words = rng.permutation(words)
        vocab = lm_score.Vocabulary(words, np.zeros(lm_score.IDS), np.sort(words), np.ones(len(words)))
        hashes = np.concatenate([words, near, words + np.uint64(1), rng.integers(0, 1 << 64, 2000, dtype=np.uint64)])
        place = {int(w): i for i, w in enumerate(words)}
        other = lm_score.Vocabulary.other(hashes)
        for h, o, got in zip(hashes.tolist(), other.tolist(), vocab.ids(hashes).tolist()):
            rank = place.get(h)
            tail = None if rank is None else rank - lm_score.FIRST
            want = o if rank is None else 1 + rank if tail < 0 else lm_score.TAIL + tail % lm_score.BUCKETS * lm_score.PER_BUCKET + tail // lm_score.BUCKETS
            assert got == want


def test_gradient_steps_raise_the_likelihood():
    net = lm_score.Network.fresh(np.ones(lm_score.IDS))
    line, place = lm_score.padded(np.tile([5, 6, 7, lm_score.TAIL + 9], 50), np.array([200]))
    before = net.log_probs(line, place).mean()
    for _ in range(60):
        net.learn(line, place)
    assert net.log_probs(line, place).mean() > before + 2


def prepared(spark, docs):
    counts = lm_score.token_counts(docs)
    vocab = lm_score.vocabulary(counts)
    work = lm_score.Workspace(spark, "test")
    return counts, vocab, work, work.table(lm_score.numbered(docs, vocab), "numbered")


def test_scores_beat_the_counts_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, vocab, work, documents = prepared(spark, docs)
    assert vocab.counts.sum() == counts.groupBy().sum("n").first()[0]
    plain = lm_score.Network.fresh(vocab.counts)
    plain.vectors[:], plain.mix[:] = 0, 0
    a = lm_score.score(documents, lm_score.train(documents, vocab, work)).groupBy().sum("log_prob", "n_tokens").first()
    b = lm_score.score(documents, plain).groupBy().sum("log_prob", "n_tokens").first()
    assert a[1] == b[1] == vocab.counts.sum()
    assert a[0] / a[1] > b[0] / b[1] + 0.3


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = []
    for parts in (2, 16):
        rows = lm_score.lm_score(docs.repartition(parts), shard_tokens=1 << 18).collect()
        got.append({r.doc_id: (r.n_tokens, r.log_prob) for r in rows})
    assert got[0].keys() == got[1].keys()
    for i, (n, x) in got[0].items():
        assert got[1][i][0] == n and abs(x - got[1][i][1]) <= 1e-3 * n


def test_the_whole_query_by_hand(spark, frame):
    """Documents' scores from the trained weights, whole softmaxes and plain counts."""
    from collections import Counter

    text = "the river under the stone, the house of light. "
    docs = frame([(i, text * (i + 1) + f"rare{i} Ünique{i}", "en") for i in range(5)], 2)
    _, vocab, work, documents = prepared(spark, docs)
    net = lm_score.train(documents, vocab, work, shard_tokens=64)
    got = {r.doc_id: r for r in lm_score.lm_score(docs, shard_tokens=64).collect()}
    counted = Counter(w.lower() for r in docs.collect() for w in tokens_by_hand(r.text))
    assert vocab.counts.sum() == sum(counted.values())
    for r in docs.collect():
        words = [w.lower() for w in tokens_by_hand(r.text)]
        h, ends = lm_score.hasher().tokens(pa.array([r.text]))
        line, place = lm_score.padded(vocab.ids(h), ends)
        want = sum(whole_table(net, line, at)[line[at]] for at in place)  # every word has a place of its own here
        assert got[r.doc_id].n_tokens == len(words)
        assert math.isclose(got[r.doc_id].log_prob, want, rel_tol=1e-3)


def test_scores_of_odd_documents(frame, odd_docs):
    got = lm_score.lm_score(frame(odd_docs)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in odd_docs)
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.n_tokens, r.log_prob, r.perplexity) == (0, 0.0, None)
        else:
            assert r.log_prob < 0 and math.isclose(r.perplexity, math.exp(-r.log_prob / r.n_tokens), rel_tol=1e-9)
    assert lm_score.lm_score(frame([], 1)).count() == 0


def test_words_beyond_the_vocabulary_are_scored_apart(spark, frame, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 800)  # so that most counts are joined
    monkeypatch.setattr(lm_score, "WORDS", 600)
    words = [f"w{i}" for i in range(1500)]
    often = [words[i] for i in range(0, 1500, 2)]
    docs = frame([(k, " ".join(words + often * 3 + often[:300] * 4), "en") for k in range(2)] + [(9, "once", "en"), (9, "once more", "en")])
    counts, vocab, work, documents = prepared(spark, docs)
    counts = counts.cache()
    net = lm_score.Network.fresh(vocab.counts)
    net.vectors[:], net.mix[:] = 0, 0  # what is left is the ids' shares of the counts
    net.classes[:, :-1], net.places[:, :-1], net.words[:, :-1] = 0, 0, 0
    scored = work.table(lm_score.score(documents, net), "scored")
    assert scored.selectExpr("sum(size(rare))").first()[0] > 500
    got = sorted((r.doc_id, r.n_tokens, r.log_prob) for r in lm_score.with_rare(scored, counts).collect())
    n_of = {r.token % (1 << 64): r.n for r in counts.collect()}
    line, _ = lm_score.padded(np.array([1]), np.array([1]))
    log_p = whole_table(net, line, 2)

    def want(text):
        h, _ = lm_score.TokenHasher().tokens(pa.array([text]))
        ids = vocab.ids(h)
        last = (ids >= lm_score.TAIL) & ((ids - lm_score.TAIL) % lm_score.PER_BUCKET == lm_score.PER_BUCKET - 1)
        return sum(log_p[i] + (math.log(n_of[int(t)] / vocab.counts[i]) if x else 0) for t, i, x in zip(h, ids, last))

    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want_rows = sorted((i, len(t.split()), want(t)) for i, t in texts)
    assert [g[:2] for g in got] == [w[:2] for w in want_rows]
    for g, w in zip(got, want_rows):
        assert math.isclose(g[2], w[2], rel_tol=1e-4)


def test_a_word_longer_than_a_block(frame):
    word = "é" * 400_000
    h, ends = lm_score.TokenHasher().tokens(pa.array([f"a {word} b", word, "b"]))
    assert ends.tolist() == [3, 4, 5] and h[1] == h[3] and h[2] == h[4]


def test_training_predicts_every_token(spark, frame):
    docs = frame([(1, "a b b b b b b b", "en")], 1)  # every eighth token is an a
    _, vocab, work, documents = prepared(spark, docs)
    before, after = lm_score.Network.fresh(vocab.counts), lm_score.train(documents, vocab, work)
    a, b = vocab.ids(lm_score.hasher().tokens(pa.array(["a b"]))[0]).tolist()
    for word in (a, b):  # each was a target: what it is told from has changed
        assert (after.places[word] != before.places[word]).any() and (after.vectors[word] != before.vectors[word]).any()
