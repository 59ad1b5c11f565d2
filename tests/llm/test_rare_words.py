"""Words beyond the folded vocabulary: merged side by side, and frequent chunks stay known among them."""

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from vecloom.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def lib(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(5)) + "q"


def test_rare_words_are_not_merged_one_by_one_and_frequent_chunks_stay(ranks, lib, monkeypatch):
    slow, one = [], byte_bpe.merge_word
    monkeypatch.setattr(byte_bpe, "merge_word", lambda w, r: slow.append(w) or one(w, r))
    chunks, alone = byte_bpe.Chunks(ranks, P.PATTERN), 0
    for top in range(0, 400_000, 2_000):
        text = " ".join(f"{word(i)} unfrequently-zq" for i in range(top, top + 2_000))
        alone += "unfrequently-zq" not in chunks
        ids = byte_bpe.encode_text(text, chunks)
        if top % 100_000 == 0:
            assert ids == byte_bpe.packed(lib.encode_ordinary(text))
    assert not [w for w in slow if w not in ranks]
    assert alone <= 5 and len(chunks) + len(chunks.words) <= byte_bpe.MAX_CHUNKS


def test_words_side_by_side_are_merged_as_each_alone(ranks):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(0, 256, n).tolist()) for n in rng.integers(1, 90, 400)] + [b"a" * n for n in range(1, 90)]
    words += [bytes(rng.choice(list(b" etaoinsh,."), n).tolist()) for n in rng.integers(1, 90, 2_000)]
    assert byte_bpe.Pairs(ranks).merge(words) == [byte_bpe.packed(byte_bpe.merge_word(w, ranks)) for w in words]
    assert byte_bpe.Pairs(ranks).merge([]) == []
    few = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}  # not every byte has a rank
    assert byte_bpe.Pairs(few).merge([b"ababa", b"b"]) == [byte_bpe.packed([3, 0]), byte_bpe.packed([1])]


def test_texts_of_odd_spaces(ranks, lib):
    rng = np.random.default_rng(6)
    signs = list("aé日1'.,s \n\t　\x85") + [" ", " ", " x", "'s", "\n\n", " '", "'ll "]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 24, 4_000)] + [" ", "", "x ", " x", "\n", "a\n b", " \n x", "x  "]
    chunks, counts = byte_bpe.Chunks(ranks, P.PATTERN), byte_bpe.ChunkCounts()
    want = {}
    for text in texts:
        counts.add(text)
        for w in regex.findall(P.PATTERN, text):
            want[w] = want.get(w, 0) + 1
    assert byte_bpe.encode_all(texts, chunks) == [byte_bpe.packed(lib.encode_ordinary(t)) for t in texts]
    found = counts.words(regex.compile(P.PATTERN).findall)
    assert dict(zip(*found.to_pydict().values())) == want
