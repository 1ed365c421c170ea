"""Token files, packing and word BPE against the library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import bpe, packing, token_files, word_bpe
from wayfold.workspace import Workspace

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


TRICKY = st.lists(
    st.sampled_from(["a", "B", "word", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "12", "é", " ", "　", "東", "́", "<|endoftext|>", "\x1c", "<|startoftext|>", "Σ", "İ"]),
    max_size=25,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.one_of(TRICKY, st.text(max_size=40)))
def test_chunks_give_the_ids_of_the_whole(text):
    assert bpe.encoder(BYTES).encode(pa.array([text, "x " + text]))[0].tolist() == library(BYTES, text)


@settings(max_examples=150, deadline=None)
@given(st.one_of(TRICKY, st.text(max_size=40)))
def test_words_give_the_ids_of_the_whole(text):
    s = word_bpe.splitter(WORDS)
    words = s.split(text)
    ids = [i for w in s.encode(words) for i in w]
    assert ids == library(WORDS, text)
    assert " ".join(s.tokenizer.id_to_token(i) for i in ids) == s.tokenizer.decode(ids, skip_special_tokens=False)
    assert not any("\n" in w for w in words)


def test_chunk_table_forgets_and_learns_again():
    small = bpe.ChunkEncoder(BYTES, most=50)
    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(20)]
    want = [library(BYTES, t) for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in small.encode(pa.array(texts))] == want


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003, dtype=np.uint64)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1003 // 64) * width * 8
    assert (token_files.unpack(data, width)[:1003] == ids).all()


def test_reader_takes_any_span(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 256)
    docs = [np.arange(n, dtype="<u4") % 50_257 for n in (0, 1, 700, 63, 64, 65, 1000)]
    with (tmp_path / "f").open("wb") as f:
        w = token_files.TokenFileWriter(f, 16)
        for i, d in enumerate(docs):
            w.add(None if i == 3 else i, d)
        w.finish()
    flat = np.concatenate(docs)
    r = token_files.TokenFileReader(pa.OSFile(str(tmp_path / "f")))
    assert r.doc_ids == [0, 1, 2, None, 4, 5, 6] and r.n_ids == len(flat)
    for a, b in ((0, len(flat)), (5, 6), (255, 257), (700, 1500), (10, 10)):
        assert (r.read(a, b) == flat[a:b]).all()
    for i, parts in r.documents():
        assert np.concatenate([np.empty(0, "<u4"), *parts]).tolist() == docs[i].tolist()


def test_token_files(spark, frame, odd_docs):
    folder = Workspace(spark, "test-tokens").path
    files = token_files.write_token_files(frame(odd_docs), folder, BYTES, end_id=0)
    got = sorted(token_files.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _, _ in odd_docs)
    texts = defaultdict(list)
    for i, t, _ in odd_docs:
        texts[i].append(t)
    start = 0
    for r in got:
        ids = np.array(library(BYTES, texts[r.doc_id][0]) + [0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sum(f["n_ids"] for f in files) == start


@pytest.mark.parametrize(("capacity", "gather"), [(2048, 64), (2048, 1), (64, 2), (8, 64), (1, 64)])
def test_packing(frame, odd_docs, monkeypatch, capacity, gather):
    monkeypatch.setattr(packing, "GATHER", gather)
    docs = [d for d in odd_docs if capacity > 1 or len(d[1] or "") < 2000]
    got = packing.packed_digests(packing.harmonic_pack(frame(docs), BYTES, 1, capacity)).collect()
    ids = {i: np.array(library(BYTES, t) + [1], dtype="<u4") for i, t, _ in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = defaultdict(int)
    for i, _, _ in docs:
        copies[i] += 1
    for i, n in copies.items():
        cover = np.zeros(len(ids[i]), dtype=int)
        for a, n_piece in pieces[i]:
            cover[a : a + n_piece] += 1
        assert (cover == n).all()
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    assert padding <= 0.02 * total


def test_bins_hold_their_class_whole_and_no_padding():
    import random

    r = random.Random(4)
    packer = packing.HarmonicPacker(2048, 0)
    sizes = [r.randrange(1, 2048) for _ in range(3000)]
    for i, n in enumerate(sizes):
        packer.add(i, b"\0" * 4 * n)
    full = defaultdict(list)
    for doc_id, _, length, _, n, sequence, _ in packer.out:
        full[sequence].append((length, n))
    whole = 0
    for pieces in full.values():
        assert sum(length for length, _ in pieces) == 2048
        k = 2048 // pieces[0][0]  # the first k pieces are whole documents of class k, the filler follows
        assert all(length == n and 2048 // length == k for length, n in pieces[:k])
        whole += k
    open_ = packer.open()
    assert sum(p[2] for p in open_) < 100 * 2048 and whole > 2000
    assert sum(length for pieces in full.values() for length, _ in pieces) + sum(p[2] for p in open_) == sum(sizes)


def test_long_words_with_one_polynomial_hash():
    """Such words share every hash that is a polynomial modulo 2**64."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert [x.tolist() for x in bpe.ChunkEncoder(BYTES).encode(pa.array([a, b, a + " " + b]))] == [library(BYTES, t) for t in (a, b, a + " " + b)]


def test_chunks_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(bpe, "span_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2) + np.uint64(1))
    texts = [" ".join(f"w{i * j}" for j in range(8)) + " " + "x" * 300 + f"{i}" for i in range(6)]
    assert [x.tolist() for x in bpe.ChunkEncoder(BYTES).encode(pa.array(texts))] == [library(BYTES, t) for t in texts]


def test_packing_takes_powers_of_two_only(frame):
    with pytest.raises(ValueError, match="power of two"):
        packing.harmonic_pack(frame([(1, "a", None)]), BYTES, capacity=1000)


def test_word_bpe(frame, odd_docs, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK_WORDS", 500)
    got = word_bpe.word_bpe(frame(odd_docs), WORDS).collect()
    t = Tokenizer.from_file(WORDS)
    want = []
    for i, text, _ in odd_docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id, r.n_tokens, " ".join(map(str, r.ids)), r.decoded) for r in got) == sorted(want)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_empty_tables_and_missing_ids(spark, frame):
    empty, odd = frame([], 1), frame([(None, "a b", None), (None, None, None)], 1)
    folder = Workspace(spark, "test-empty").path
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty, folder, BYTES)).count() == 0
    assert packing.harmonic_pack(empty, BYTES).count() == 0
    assert word_bpe.word_bpe(empty, WORDS).count() == 0
    folder = Workspace(spark, "test-odd").path
    back = token_files.read_token_files(spark, folder, token_files.write_token_files(odd, folder, BYTES)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in back) == [(True, 1), (True, 3)]
    assert packing.harmonic_pack(odd, BYTES).filter("doc_id IS NULL").count() >= 2
    assert word_bpe.word_bpe(odd, WORDS).filter("doc_id IS NULL").count() == 2
