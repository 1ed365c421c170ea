"""Language of words and documents by a linear-chain conditional random field.

A word's features are its byte n-grams with marks at both ends, so that
those at an end are its affixes, its own hash, and its place in a lexicon of
each language.  Transitions between the languages of neighbouring words are
learned too, from chains spliced of several languages, as code-switched text
is.  Forward-backward gives each word a probability of each language; a
document's language is the one with the largest mean.

A long document is cut into chains that are worked on side by side.  What a
chain does to the probabilities at its border is one matrix; these are
multiplied along the document, so that forward-backward runs over the whole of
it and a cut changes nothing.

The model learns from a bounded sample: of each language at most
``PARTS * DOCS_PER_PART`` documents, the ones with the smallest hashes in each of
``PARTS`` parts, and ``SPANS`` spans of ``SPAN_WORDS`` words spread over each one's
whole text.  Prediction reads every word of every text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.workers import tidy

PARTS, DOCS_PER_PART, SPANS, SPAN_WORDS = 16, 25, 6, 24
#: Sampled documents whose keys may be broadcast.
MOST_BROADCAST = 100_000
#: Weights of the n-grams a language, whatever the number of languages; words of each lexicon, words of a chain.
SLOTS, LEXICON, CHAIN = 1 << 18, 2000, 128
GRAMS = (2, 3, 4)
ROUNDS, RATE, DECAY, SEED = 60, 0.3, 1e-4, 7
#: Words whose scores a worker keeps; documents that are labelled at a time.
CACHE_WORDS, BATCH_DOCS, BATCH_WORDS = 250_000, 256, 200_000
UNKNOWN = "und"
#: Of the known share that held-out texts have this part is asked for, and never more than the second number.
SLACK, MOST_NEEDED = 0.7, 0.6
#: A text of fewer words is never rejected for them.
FEW_WORDS = 10

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (slots + one for each lexicon, languages)
    lexicon: dict[str, list[int]]
    transition: np.ndarray
    start: np.ndarray
    seen: np.ndarray  # whether a slot was seen in training
    least_known: float = 0.0  # share of known features under which a text is in no language

    # ------------------------------------------------------------ features
    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slots, number of the word that has each)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        slots_of_grams = len(self.seen)
        data = np.frombuffer(b"\x02" + b"\x03\x02".join(raw) + b"\x03", dtype=np.uint8).astype(np.uint64)
        sizes = np.array([len(r) + 2 for r in raw])
        owner = np.repeat(np.arange(len(raw)), sizes)
        slots, owners = [], []
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            code = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + data[j : j + m] + np.uint64(1)
                code ^= code >> np.uint64(29)
            one_word = owner[:m] == owner[n - 1 :]
            slots.append((code[one_word] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64) & (slots_of_grams - 1))
            owners.append(owner[:m][one_word])
        slots.append(np.array([zlib.crc32(r) & (slots_of_grams - 1) for r in raw], dtype=np.int64))
        owners.append(np.arange(len(raw)))
        listed = [(i, k) for i, w in enumerate(words) for k in self.lexicon.get(w, ())]
        if listed:
            i, k = np.array(listed).T
            slots.append(slots_of_grams + k)
            owners.append(i)
        return np.concatenate(slots), np.concatenate(owners)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word alone, and the share of its features that were seen in training."""
        slots, owners = self.features(words)
        out = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, weights=self.weights[slots, k], minlength=len(words))
        n = np.bincount(owners, minlength=len(words))
        known = np.concatenate([self.seen, np.ones(len(self.languages), dtype=bool)])[slots]
        return out / np.sqrt(n)[:, None], np.bincount(owners, weights=known, minlength=len(words)) / n

    # ------------------------------------------------------------ inference
    def transfers(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each chain the matrix that takes the state before it to that of its last word, up to a factor."""
        n, t_max, k = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.transition - self.transition.max())
        m = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(t_max):
            live = lengths > t
            step = (m[live].reshape(-1, k) @ move).reshape(-1, k, k) * e[live, None, t]
            m[live] = step / step.max(axis=(1, 2), keepdims=True)
        return m

    def marginals(
        self, scores: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over chains padded to one length: scores (chains, T, languages).

        Returns the words' probabilities, the expected transitions and the log
        of each chain's partition function.  A chain in the middle of a document
        has the forward values ``before`` it and the backward ones ``after``; rows of
        zeros in ``before`` begin a document.
        """
        n, t_max, k = scores.shape
        top = scores.max(axis=2, keepdims=True)
        e = np.exp(scores - top)
        move = np.exp(self.transition)
        alive = np.arange(t_max)[None, :] < lengths[:, None]
        alpha, scale = np.empty((n, t_max, k)), np.ones((n, t_max))
        a = np.exp(self.start)[None, :] * e[:, 0]
        if before is not None:
            a = np.where(before.any(axis=1)[:, None], (before @ move) * e[:, 0], a)
        for t in range(t_max):
            if t:
                step = (a @ move) * e[:, t]
                a = np.where(alive[:, t, None], step, a)
            s = a.sum(axis=1)
            scale[:, t] = np.where(alive[:, t], s, 1)
            a = a / s[:, None]
            alpha[:, t] = a
        beta = np.ones((n, t_max, k))
        b = np.ones((n, k)) if after is None else after.copy()
        beta[:, t_max - 1] = b
        pairs = np.zeros((k, k))
        for t in range(t_max - 1, 0, -1):
            inner = e[:, t] * b
            live = alive[:, t, None]
            before = (inner @ move.T) / scale[:, t, None]
            pairs += np.where(live, alpha[:, t - 1], 0).T @ (inner / scale[:, t, None]) * move
            b = np.where(live, before, b)
            beta[:, t - 1] = b
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        gamma *= alive[:, :, None]
        log_z = np.log(scale).sum(axis=1) + (top[:, :, 0] * alive).sum(axis=1)
        return gamma, pairs, log_z


def train(chains: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> Crf | None:
    """A model of the languages in ``chains`` of one language each; None if there are none."""
    chains = [(lang, words) for lang, words in chains if words]
    if not chains:
        return None
    languages = sorted({lang for lang, _ in chains})
    number = {lang: i for i, lang in enumerate(languages)}
    counts = [Counter() for _ in languages]
    for lang, words in chains:
        counts[number[lang]].update(words)
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    k = len(languages)
    n_slots = SLOTS
    crf = Crf(languages, np.zeros((n_slots + k, k)), lexicon, np.zeros((k, k)), np.zeros(k), np.zeros(n_slots, dtype=bool))

    # half of the chains are spliced with others, as in code-switched text
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(chains))
    labelled: list[tuple[list[str], list[int]]] = []
    for at, i in enumerate(order):
        lang, words = chains[i]
        labels = [number[lang]] * len(words)
        if at % 2:
            other, more = chains[order[at - 1]]
            cut, take = rng.integers(1, len(words) + 1), rng.integers(0, len(more) + 1)
            words = words[:cut] + more[:take]
            labels = labels[:cut] + [number[other]] * int(take)
        labelled.append((words[: 2 * SPAN_WORDS], labels[: 2 * SPAN_WORDS]))
    distinct = sorted({w for words, _ in labelled for w in words})
    row = {w: i for i, w in enumerate(distinct)}
    t_max = max(len(w) for w, _ in labelled)
    word = np.zeros((len(labelled), t_max), dtype=np.int64)
    gold = np.zeros((len(labelled), t_max), dtype=np.int64)
    lengths = np.array([len(w) for w, _ in labelled])
    for i, (words, labels) in enumerate(labelled):
        word[i, : len(words)] = [row[w] for w in words]
        gold[i, : len(words)] = labels
    alive = np.arange(t_max)[None, :] < lengths[:, None]
    hot = np.eye(k)[gold] * alive[:, :, None]
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:, :-1][alive[:, 1:]], gold[:, 1:][alive[:, 1:]]), 1)
    slots, owners = crf.features(distinct)
    crf.least_known = _least_known(crf, chains)
    crf.seen[slots[slots < n_slots]] = True
    norm = np.sqrt(np.bincount(owners, minlength=len(distinct)))
    squares = np.full_like(crf.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    n_words = alive.sum()
    for _ in range(rounds):
        alone = np.stack(
            [np.bincount(owners, weights=crf.weights[slots, j], minlength=len(distinct)) / norm for j in range(k)], axis=1
        )
        gamma, pairs, _ = crf.marginals(alone[word], lengths)
        error = (hot - gamma)[alive]
        by_word = np.stack([np.bincount(word[alive], weights=error[:, j], minlength=len(distinct)) / norm for j in range(k)], axis=1)
        gradients = (
            np.stack([np.bincount(slots, weights=by_word[owners, j], minlength=n_slots + k) for j in range(k)], axis=1) / n_words
            - DECAY * crf.weights,
            (seen_pairs - pairs) / n_words - DECAY * crf.transition,
            (hot[:, 0] - gamma[:, 0]).sum(axis=0) / n_words - DECAY * crf.start,
        )
        for value, gradient, square in zip((crf.weights, crf.transition, crf.start), gradients, squares):
            square += gradient * gradient
            value += RATE * gradient / np.sqrt(square)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def _least_known(crf: Crf, chains: list[tuple[str, list[str]]]) -> float:
    """A bound well below the known shares that one half of the chains has by the features of the other."""
    halves = chains[0::2], chains[1::2]
    if not halves[1]:
        return 0.0
    half = Crf(crf.languages, crf.weights, crf.lexicon, crf.transition, crf.start, np.zeros_like(crf.seen))
    slots, _ = half.features(sorted({w for _, words in halves[0] for w in words}))
    half.seen[slots[slots < len(half.seen)]] = True
    lengths = np.array([len(words) for _, words in halves[1]])
    _, known = half.emissions([w for _, words in halves[1] for w in words])
    shares = np.add.reduceat(known, np.cumsum(lengths) - lengths) / lengths
    return min(MOST_NEEDED, SLACK * float(np.quantile(shares, 0.05)))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame) -> Crf | None:
    """A model from the bounded sample of documents that are not held out; every non-null lang is learned.

    A document is known by its doc_id and a hash of its text, so rows that are
    equal in both count once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id", "text")
    keyed = known.select("lang", key.alias("key"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(PARTS)).alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("key"))
    least = keyed.withColumn("place", place).filter(F.col("place") <= DOCS_PER_PART)
    # at most PARTS * DOCS_PER_PART keys a language reach the driver, and SPANS spans of each
    chosen = least.select("lang", "key").distinct().collect()
    sample = docs.sparkSession.createDataFrame(chosen, "lang string, key long")
    if len(chosen) <= MOST_BROADCAST:
        sample = F.broadcast(sample)

    @tidy
    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, out = [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column("text")[i].as_py())
                at = np.linspace(0, max(0, len(words) - SPAN_WORDS), SPANS if len(words) > SPAN_WORDS else 1).astype(int)
                langs.append(batch.column("lang")[i].as_py())
                keys.append(batch.column("key")[i].as_py())
                out.append("\n".join(" ".join(words[a : a + SPAN_WORDS]) for a in at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["lang", "key", "words"]
            )

    texts = known.select("lang", key.alias("key"), "text").join(sample, ["lang", "key"], "left_semi")
    rows = texts.mapInArrow(spans, "lang string, key long, words string").dropDuplicates(["lang", "key"]).collect()
    return train(sorted((r.lang, span.split(" ")) for r in rows for span in r.words.split("\n") if span))


class Labeller:
    """Languages of whole documents, many at a time."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.row: dict[str, int] = {}
        self.scores, self.known = np.empty((0, len(crf.languages))), np.empty(0)

    def _rows(self, lists: list[list[str]]) -> np.ndarray:
        wanted = set().union(*lists)
        new = wanted.difference(self.row)
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.scores, self.known, new = {}, self.scores[:0], self.known[:0], wanted
        if new:
            new = sorted(new)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            scores, known = self.crf.emissions(new)
            self.scores, self.known = np.concatenate([self.scores, scores]), np.concatenate([self.known, known])
        get = self.row.__getitem__
        return np.fromiter((r for words in lists for r in map(get, words)), dtype=np.int64, count=sum(map(len, lists)))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text its language, the mean probability of it, and the mean share of known features.

        A text of few words says too little on the last, which is then 1.
        """
        lists = [words_of(t) for t in texts]
        out, start = [], 0
        while start < len(lists):
            end, n = start, 0
            while end < len(lists) and (end == start or n + len(lists[end]) <= BATCH_WORDS):
                n += len(lists[end])
                end += 1
            part = lists[start:end]
            for words, total, known in zip(part, *self._sums(part)):
                if words:
                    best = int(total.argmax())
                    share = float(known) / len(words) if len(words) >= FEW_WORDS else 1.0
                    out.append((self.crf.languages[best], min(1.0, float(total[best]) / len(words)), share))
                else:
                    out.append((UNKNOWN, 0.0, 0.0))
            start = end
        return out

    def _sums(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each document the sums of its words' probabilities and known shares."""
        crf, k = self.crf, len(self.crf.languages)
        rows = self._rows(lists)
        sizes = np.array([len(w) for w in lists])
        shares = np.bincount(np.repeat(np.arange(len(lists)), sizes), weights=self.known[rows], minlength=len(lists))
        # chains of at most CHAIN words, each of one document
        n_chains = -(-sizes // CHAIN)
        doc = np.repeat(np.arange(len(lists)), n_chains)
        first = np.repeat(np.cumsum(n_chains) - n_chains, n_chains)
        within = np.arange(len(doc)) - first
        begins = np.repeat(np.cumsum(sizes) - sizes, n_chains) + within * CHAIN
        lengths = np.minimum(CHAIN, np.repeat(sizes, n_chains) - within * CHAIN)

        def scores(part: np.ndarray) -> np.ndarray:
            index = np.minimum(begins[part][:, None] + np.arange(int(lengths[part].max()))[None, :], len(rows) - 1)
            return self.scores[rows[index]]

        before, after = self._borders(doc, within, n_chains, lengths, scores)
        sums = np.zeros((len(lists), k))
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            gamma, _, _ = crf.marginals(scores(part), lengths[part], before[part], after[part])
            by_chain = gamma.sum(axis=1)
            for j in range(k):
                sums[:, j] += np.bincount(doc[part], weights=by_chain[:, j], minlength=len(lists))
        return sums, shares

    def _borders(self, doc, within, n_chains, lengths, scores) -> tuple[np.ndarray, np.ndarray]:
        """Forward values before and backward values after each chain, up to a factor."""
        crf, k = self.crf, len(self.crf.languages)
        before, after = np.zeros((len(doc), k)), np.ones((len(doc), k))
        cut = np.flatnonzero(n_chains[doc] > 1)
        if not len(cut):
            return before, after
        matrix = np.empty((len(cut), k, k))
        for at in range(0, len(cut), 1024):
            part = cut[at : at + 1024]
            matrix[at : at + 1024] = crf.transfers(scores(part), lengths[part])
        row = np.full(len(doc), -1)
        row[cut] = np.arange(len(cut))
        # a document begins as if by a state of its own: the matrix without its first step, from the start weights
        most = int(within.max())
        heads = np.flatnonzero((within == 0) & (row >= 0))
        for at in range(0, len(heads), 1024):
            part = heads[at : at + 1024]
            before[part + 1] = self._after_first(scores(part))
        for c in range(1, most):
            here = np.flatnonzero((within == c) & (n_chains[doc] > c + 1))
            x = np.einsum("nk,nkj->nj", before[here], matrix[row[here]])
            before[here + 1] = x / x.sum(axis=1, keepdims=True)
        for c in range(most, 0, -1):
            here = np.flatnonzero(within == c)
            x = np.einsum("nkj,nj->nk", matrix[row[here]], after[here])
            after[here - 1] = x / x.sum(axis=1, keepdims=True)
        return before, after

    def _after_first(self, scores: np.ndarray) -> np.ndarray:
        """Forward values at the last words of whole chains that begin documents."""
        crf = self.crf
        e, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(crf.transition)
        a = np.exp(crf.start)[None, :] * e[:, 0]
        for t in range(1, e.shape[1]):
            a = (a / a.sum(axis=1, keepdims=True)) @ move * e[:, t]
        return a / a.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, crf: Crf | None, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_known")) -> DataFrame:
    """``docs`` with the language, its mean probability and the mean share of known features of the words.

    Only ``text`` is looked at.  A text that is null or has no letter is "und"
    with score 0, as is every text if nothing was learned.  Other columns pass
    through; columns of the three ``names`` are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)  # its size is bounded by the sample
    docs = docs.drop(*names)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value) if model.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                texts = part.column("text").to_pylist()
                found = labeller.label(texts) if labeller else [(UNKNOWN, 0.0, 0.0)] * len(texts)
                lang, score, known = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())],
                    names=[*part.schema.names, *names],
                )

    return docs.mapInArrow(work, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; see :func:`identify` and :func:`learn`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in no language.

    A text goes if it is null, has no letter, or if fewer of its words' features
    are known than any sampled text would let expect, whatever the number of
    languages.  Code-switched texts stay, and so do texts of under ``FEW_WORDS``
    words.  If nothing was learned all rows stay.
    """
    crf = learn(docs)
    if crf is None:
        return docs
    lang, score, known = names = ("_li_lang", "_li_score", "_li_known")
    found = identify(docs, crf, names)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(known) >= crf.least_known)).select(*docs.columns)
