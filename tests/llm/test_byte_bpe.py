"""Byte-level BPE against the library that the rank file is for, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from witloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as lines:
        return byte_bpe.read_ranks(lines)


@pytest.fixture(scope="module")
def bpe(ranks):
    return byte_bpe.Bpe(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_texts():
    rnd = random.Random(1)
    out = ["", " ", "\n\n  \t a", "it's WE'LL don't", "<|endoftext|>", "\x1c\x1d a\x85\xa0b　c", "a" * 5000, " " * 3000 + "x", "՘'s \U00010940's"]
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "éßñ ao", "一二三 \n\t a1", " \n", "0123 ", "😀👩‍🚀 a", "'std re"):
        out += ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (1, 2, 7, 60, 700, 1500)]
    return out


def test_ids_are_the_librarys(bpe, library):
    texts = made_texts()
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert bpe.decode(ids) == text.encode()


def test_every_character(bpe, library):
    """Letters, numbers and white space are those of the library: ``'s`` is one id behind a letter or number alone."""
    texts = ["".join(chr(c) + "'s " for c in range(s, s + 256) if not 0xD800 <= c < 0xE000) for s in range(0, 0x34000, 256)]
    assert [x.tolist() for x in bpe.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_store_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    monkeypatch.setattr(byte_bpe, "PART", 100)
    small, texts = byte_bpe.Bpe(ranks, public_tokenizers.PATTERN), made_texts()[:40]
    assert [x.tolist() for x in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(small.known) <= 50 + 100


def test_matrix_and_heap_merge_alike(bpe):
    rnd = random.Random(4)
    for _ in range(30):
        match = bytes(rnd.randrange(256) for _ in range(rnd.randint(2, 200)))
        rows = bpe.single[list(match)][None, :]
        ((_, ids),) = bpe.merged(rows.copy())
        assert ids[ids >= 0].tolist() == bpe.heaped(match).tolist()


def test_pair_table_holds_every_pair(ranks, bpe):
    by_rank = {r: t for t, r in ranks.items()}
    rnd = random.Random(2)
    ids = [rnd.randrange(len(by_rank)) for _ in range(20_000)]
    left, right = byte_bpe.np.array(ids[::2]), byte_bpe.np.array(ids[1::2])
    want = [ranks.get(by_rank[a] + by_rank[b], byte_bpe.NONE) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert bpe.pairs.look(left, right).tolist() == want


def test_table(spark, library):
    texts = [*made_texts(), None, "same", "same"]
    rows = [(i if i else None, t, i, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string, n_tokens int").repartition(3)
    got = byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    coded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "decoded", "n_tokens", "ids"]
    assert byte_bpe.decode(coded, PATH, public_tokenizers.PATTERN).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert byte_bpe.digests(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids_and_files(spark, bpe, ranks):
    with pytest.raises(ValueError, match="ids outside"):
        bpe.decode([len(ranks) + 5])
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Bpe({b"a": 0}, public_tokenizers.PATTERN)
    lists = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(lists, PATH, public_tokenizers.PATTERN).collect()}
    assert got[2] == b"" and got[3] is None and len(got[1]) >= 2
