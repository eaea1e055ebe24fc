"""Byte-level BPE, wavelet token files and token counts against their libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from reviewmill.llm import byte_bpe, token_counts, wavelet_tokens, word_tokens
from reviewmill.llm.byte_bpe import ByteBpe
from reviewmill.llm.common import utf8
from reviewmill.llm.word_tokens import WordTokens

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


def random_texts(n, seed=2):
    rnd = random.Random(seed)
    alphabet = "ab C \n\t\réÉ漢ßİΣ字'sST.,!1 2\x1c\x85\xa0　\x00́ don't <|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return texts + ["x" * 3000, " " * 500, "ab" * 700, "", " ", "<|startoftext|> x<|endoftext|>y", "I'VE we'LL"]


def test_segment_tree_equals_library(tik):
    bpe = ByteBpe(RANKS, P.PATTERN)
    texts = random_texts(3000)
    offsets, ids = bpe.encode_texts(texts)
    for text, low, high in zip(texts, offsets, offsets[1:]):
        assert ids[low:high].tolist() == tik.encode_ordinary(text)
    ends, data = bpe.decode(offsets, ids)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts


def test_old_chunks_are_taken_over(tik, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 4)
    monkeypatch.setattr(byte_bpe, "CACHED_CHUNKS", 4)
    bpe = ByteBpe(RANKS, P.PATTERN)
    for text in ["a b c d e", "a b f g", "zz a b", "q r s t u v a"]:
        assert bpe.encode_texts([text])[1].tolist() == tik.encode_ordinary(text)


def test_long_matches_equal_library(tik):
    rnd = random.Random(4)
    bpe = ByteBpe(RANKS, P.PATTERN)
    for text in ["ab" * 60_000, "a" * 70_001, "".join(rnd.choices("etaoinshr", k=30_000)), "é" * 3000 + "ßa" * 3000]:
        assert bpe.encode_texts([text])[1].tolist() == tik.encode_ordinary(text)
    ids = np.frombuffer(bpe._merge_long(b"ab" * 2_000_000), np.int32)  # 4 MB in one match
    assert b"".join(tik.decode_single_token_bytes(i) for i in ids.tolist()) == b"ab" * 2_000_000


def merged_in_turn(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_merges_that_make_lower_ranks(tmp_path, seed):
    """Ranks in no order of training, so a merge can make a pair that has to go first."""
    rnd = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    for _ in range(60):
        tokens.add(b"".join(rnd.choices([b"a", b"b", b"c"], k=rnd.randint(2, 6))))
    shuffled = sorted(tokens - {bytes([b]) for b in range(256)})
    rnd.shuffle(shuffled)
    ranks = {**{bytes([b]): b for b in range(256)}, **{t: 256 + i for i, t in enumerate(shuffled)}}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    bpe = ByteBpe(str(path), P.PATTERN)
    for n in (2, 50, 1500):
        piece = "".join(rnd.choices("abc", k=n)).encode()
        want = merged_in_turn(piece, ranks)
        assert np.frombuffer(bpe._merge_long(piece), np.int32).tolist() == want
        assert np.frombuffer(bpe._merge([piece], 1 << (n - 1).bit_length())[0], np.int32).tolist() == want


def test_encoding_of_awkward_rows(awkward, awkward_rows, nothing, tik):
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        ids = tik.encode_ordinary(text or "")
        want[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.digests(awkward, RANKS, P.PATTERN).collect())) == want
    assert byte_bpe.digests(nothing, RANKS, P.PATTERN).count() == 0


def test_words_equal_library(words):
    texts = random_texts(3000)
    for text, got in zip(texts, WordTokens(WORDS).encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix_by_brute_force():
    rng = np.random.default_rng(0)
    for n, bits in ((1, 1), (513, 4), (4000, 16)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        matrix = wavelet_tokens.WaveletMatrix.build(ids, bits)
        assert (matrix.all_ids() == ids).all()
        assert [matrix.access(i) for i in range(min(n, 200))] == ids[:200].tolist()
        token = int(ids[n // 2])
        assert matrix.locate(token) == np.flatnonzero(ids == token).tolist()
        assert matrix.count(token, n // 2) == (ids[:n // 2] == token).sum()
        assert matrix.count(1 << bits) == 0


def test_files_hold_all_documents_in_order(spark, awkward, awkward_rows, words, tmp_path):
    path = str(tmp_path / "tokens")
    wavelet_tokens.write(awkward, WORDS, path, shard_tokens=500)
    got = wavelet_tokens.checksums(spark, path).collect()
    order = sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text, *_ in order:
        ids = np.array(words.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    whole = wavelet_tokens.read_documents(spark, path).collect()
    assert sorted((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in whole) == [(w[1], w[3]) for w in want]
    found = wavelet_tokens.occurrences(spark, path, 1).collect()
    assert sum(r.n_found for r in found) >= len(awkward_rows) and len(found) > 3


def test_files_of_nothing(spark, nothing):
    assert wavelet_tokens.written_and_read(nothing, WORDS).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(200, 8), (500, 64), (65_536, 512)])
def test_spliced_chunks_equal_whole_text(words, chunk, overlap):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc  é漢\n<|endoftext|>'s") for _ in range(n)) for n in (0, 50, 3000)]
    for text in [*texts, "x" * 3000, "a " * 2000, "ab\n" * 900]:
        got = token_counts.spliced_ids(words, text, chunk, overlap)
        assert got == words.encode(text, add_special_tokens=False).ids


def test_counts_of_awkward_rows(awkward, awkward_rows, nothing, words):
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        n = len(words.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    for chunk in (300, 65_536):
        assert Counter(map(tuple, token_counts.counts(awkward, WORDS, chunk=chunk).collect())) == want
    assert token_counts.counts(nothing, WORDS).count() == 0


def test_words_are_met_once_and_put_together_by_number():
    """Ids of joined texts against the library, text by text; a word that is repeated is looked up once."""
    words = WordTokens(WORDS)
    texts = ["", "the cat  the\tcat\n", " ", "a\x1cb a\xa0b\x85c", "naïve 学 naïve", "don't 12 x", "the " * 500, "\x00"]
    offsets, data = utf8(pa.array(["cut off", *texts]))
    looked, known = [], words._known
    words._known = lambda found: looked.append(found) or known(found)
    ids, lengths = words.joined(offsets[1:], data)
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert len(looked) == 1 and len(looked[0]) < 20
    ids, lengths = words.joined(offsets[1:2], data)
    assert not len(ids) and not len(lengths)


def test_letters_whose_lower_case_lies_elsewhere(words):
    """The lower case of Ɓ, Ɔ or Ⱥ is a letter of another block, so the library has to encode them."""
    texts = [t for c in map(chr, range(0xC0, 0x250)) for t in (c, f"a{c}b", f"{c}{c}!")] + ["KÅẞ", "aÅ"]
    want = [words.encode(t, add_special_tokens=False).ids for t in texts]
    got = WordTokens(WORDS)
    assert [np.frombuffer(i, "<u4").tolist() for i in got.encode([t.encode() for t in texts])] == want
    offsets, data = utf8(pa.array(texts))
    ids, lengths = got.joined(offsets, data)
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_parts_of_words_are_met_once(words, monkeypatch):
    """Words that differ by case, marks or digits are put together from the same parts, also after parts were dropped."""
    monkeypatch.setattr(word_tokens, "CACHED_WORDS", 8)
    own = WordTokens(WORDS)
    met, known = [], own._known
    own._known = lambda found: met.append(found) or known(found)
    first = ["The the, (THE) the! the?!", "naïve Naïve. NAÏVE42 24the", "it's 'TIS ''ll x'", "a<|endoftext|>the"]
    for texts in (first, first, random_texts(300), first):
        offsets, data = utf8(pa.array(texts))
        ids, lengths = own.joined(offsets, data)
        want = [words.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert {b"the", "naïve".encode(), b"4", b"2", b"it's", b"a<|endoftext|>the"} <= met[0]
    assert not met[0] & {b"The", b"the,", b"(THE)", "Naïve.".encode()} and not met[1]
