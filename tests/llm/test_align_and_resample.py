"""Alignment and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from wayfold.llm import alignment, resampling

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


# ---------------------------------------------------------------- alignment
def whole(docs):
    """The same result from whole texts: groups are where ends meet, links all pairs whose ranges overlap."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    known, held, per = alignment.aligner(*PATHS), Counter(), []
    for _, text in docs:
        raw = (" " + text).encode() if text else b""
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        x, y = [known.bytes_a[i] for i in a], [known.bytes_b[i] for i in b]
        if not text or b"".join(x) != raw or b"".join(y) != raw:
            per.append(([], [], [], ""))
            continue
        end_a, end_b = np.cumsum([len(z) for z in x]), np.cumsum([len(z) for z in y])
        from_a, from_b = end_a - [len(z) for z in x], end_b - [len(z) for z in y]
        links = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((from_b < end_a[i]) & (end_b > from_a[i])).tolist()]
        parts, before = [], 0
        for end in sorted(set(end_a.tolist()) & set(end_b.tolist())):
            own = [",".join(str(k) for k, e in zip(ids, ends.tolist()) if before < e <= end) for ids, ends in ((a, end_a), (b, end_b))]
            parts.append("|".join(own))
            before = end
        per.append((a, b, links, ";".join(parts)))
        held.update(set(links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, _), (a, b, links, groups) in zip(docs, per):
        best, total = sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), best, total, digest, groups))
    return out, held


ODD = [
    " ", "  ", "\n", "a", " a ", "\n\na", "a \n b", "a  b  c", "▁x", "x▁y", "<|endoftext|> <s> </s> <unk> <0x0A>", "a\tb\t\tc",
    "a\r\nb", "\x1c x\x85 y", "東京 は 晴れ 😀", "don't  stop\n\n\n  now", "\x00 x", "é é", "     ", "x     ", " \n \n", "a\xa0 b", None, "",
]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r)))


@pytest.mark.parametrize("limits", [{}, {"CHUNK_SEGMENTS": 40, "MOST_KEPT": 3}])
def test_alignment_is_that_of_whole_texts(frame, odd_docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    r = random.Random(5)
    docs = [(i, t) for i, t, _ in odd_docs if i != 9] + [(None, "no id here"), (None, "no id here")] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs += [(200 + k, "".join(r.choice(" \n\t\r a b, .'s  é東😀▁<0x0A>\x1c\u0301") for _ in range(r.randrange(60)))) for k in range(150)]
    want, held = whole(docs)
    job = alignment.Alignment(frame([(i, t, "en") for i, t in docs], 5), *PATHS, with_groups=True, n_buckets=7)
    assert by_row(map(tuple, job.documents().collect())) == by_row(want)
    assert {(p.a, p.b): p.n_docs for p in job.pairs().collect()} == held


def test_alignment_of_a_very_long_text_and_of_nothing(spark, frame, odd_docs):
    docs = [(i, t) for i, t, _ in odd_docs if i == 9] * 2
    got = alignment.align(frame([(i, t, "en") for i, t in docs]), *PATHS).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_a > 20_000 and got[0].count_sum == 2 * got[0].n_links
    assert alignment.align(frame([]), *PATHS).count() == 0
    assert [tuple(x) for x in alignment.align(frame([(1, None, "en")]), *PATHS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_are_only_where_no_entry_goes_on():
    assert alignment.uncrossed([b" a", b"  ", b"b\n", b"\xc2\xa0 ", b"\n "]) == {" ", "\t", "\r"}
    run = alignment.aligner(*PATHS)
    assert run.cuts == {" ", "\n", "\t"}  # some piece goes on with a carriage return
    for text in ("a b  c\n d", "a\r\n b", " x ", "a  b"):
        assert "".join(run.split(text)) == " " + text and all(s[0] in run.cuts for s in run.split(text))


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), PATHS[1])


# ---------------------------------------------------------------- resampling
def test_composed_crcs_are_those_of_the_strings():
    r = np.random.default_rng(1)
    words = [r.integers(97, 123, n).astype("u1").tobytes() for n in (1, 2, 3, 63, 64, 65, 66, 200, 1000, 70_000, 5)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    runs = list(resampling.features(data, np.array([0, 0, len(data), len(data)]), 3))
    for n, (crc, doc) in enumerate(runs, start=1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
        assert (doc == 1).all()


def brute(docs, target, percent=25):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:])]]

    s = Counter(b for _, t in docs for b in feats(t)[1])
    t = Counter(b for x in target for b in feats(x)[1])
    s_all, t_all, rows = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    for i, text in docs:
        n, f = feats(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows]


def test_resampling(spark, frame, odd_docs):
    docs = [(i, t) for i, t, _ in odd_docs] + [(None, "word " * 30)] + [(100 + i, f"{t} and x{i % 3}" * (i % 4)) for i, (_, t, _) in enumerate(odd_docs) if t]
    docs += [(1000 + i, " ".join(f"w{(i * k) % 50}" for k in range(25 + i))) for i in range(60)]
    target = ["w1 w2 w3 river stone", None, "", "the HOUSE of w5"] * 3
    t = spark.createDataFrame([(x, 1) for x in target], "text string, item_id int")
    got = resampling.draw(resampling.weigh(frame([(i, x, "en") for i, x in docs], 5), t)).select("doc_id", "n_features", "weight", "score", "rank")
    assert by_row(map(tuple, got.collect())) == by_row(brute(docs, target))


def test_resampled_rows_and_empty_tables(spark, frame):
    docs = [(i, " ".join(f"w{(i * k) % 50}" for k in range(30))) for i in range(40)]
    t = spark.createDataFrame([("w0 w3",)], "text string")
    rows = resampling.resample(frame([(i, x, "en") for i, x in docs]), t).collect()
    want = {i: rank for i, *_, rank in brute(docs, ["w0 w3"]) if rank}
    assert {r.doc_id: r.resample_rank for r in rows} == want and len(want) == 10 and rows[0].lang == "en"
    none = spark.createDataFrame([], "text string")
    assert resampling.draw(resampling.weigh(frame([]), t)).count() == 0
    got = resampling.draw(resampling.weigh(frame([(3, None, "en")]), none)).collect()
    assert [(r.doc_id, r.n_features, r.weight, r["rank"]) for r in got] == [(3, 0, 0, None)]
