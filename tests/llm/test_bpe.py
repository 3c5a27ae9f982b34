import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from statera.llm import bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.read_ranks(VOCABULARY)
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    yield from ["", " ", "a", "aaaaaaaaaaaaaaa", "  \n\t x", "l'été où ça n'est", "I'm we've they'll", "١٢٣ 123", "日本語のテキスト", "é 🙂🙃", "\x1c\x1d \x85 x", "<|endoftext|>"]
    yield "ab" * 20000
    yield "".join(rnd.choice("abcdefgh") for _ in range(30000))
    for _ in range(300):
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x24F), rnd.randrange(0x370, 0x9FF), 32, 10])) for _ in range(rnd.randrange(60)))


def test_ids_match_the_library(pair):
    codec, library = pair
    for text in texts():
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_memory_is_bounded(pair, monkeypatch):
    codec, library = pair
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    text = "zqxj wvkq pqzx jjqk xxzq"
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_rows(spark, pair):
    _, library = pair
    rows = [(1, "hello wörld", "x"), (2, None, None), (None, "hello wörld", "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode(df, VOCABULARY, P.PATTERN).collect()}
    want = library.encode_ordinary("hello wörld")
    assert got[1, len(want)].ids == want and got[None, len(want)].ids == want
    assert got[1, len(want)].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert got[2, 0].ids == [] and got[3, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_merging_together_is_merging_one_by_one(pair, monkeypatch):
    codec, library = pair
    rnd = random.Random(8)
    pieces = [b"aaaaaaa", b"ababab", b"a", "日本語".encode(), b"  ", *[bytes(rnd.choice(b"abcdeh thn") for _ in range(rnd.randrange(1, 40))) for _ in range(3000)]]
    together = codec.together(pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in together if len(x)] == [codec.merge(p) if codec.merge.ranks.get(p) is None else np.frombuffer(x, "<u4").tolist() for p, x in zip(pieces, together)]
    monkeypatch.setattr(bpe, "TOGETHER", 1)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 200)
    fresh = bpe.Codec(codec.merge.ranks, P.PATTERN)
    some = list(texts())
    assert [x.tolist() for x in fresh.encode_all(some)] == [library.encode_ordinary(t) for t in some]
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    assert [x.tolist() for x in fresh.encode_all(some)] == [library.encode_ordinary(t) for t in some]


def test_ranks_that_no_merge_order_gives():
    """A piece made of one of a higher rank: its pre-tokens are merged by themselves."""
    rnd = random.Random(3)
    for seed in range(30):
        pieces = {bytes([b]) for b in range(256)} | {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 5))) for _ in range(25)}
        order = sorted(pieces, key=lambda p: (len(p) > 1, rnd.random()))
        merge = bpe.Merger({p: i for i, p in enumerate(order)})
        words = [w for w in (bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12))) for _ in range(200)) if w not in merge.ranks]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Batch(merge)(words)] == [merge(w) for w in words]


def test_repeated_rows_and_a_long_text(spark, pair):
    _, library = pair
    long = "word " * 200_000 + "ab" * 300_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "x")], "doc_id long, text string")
    got = bpe.encode(df, VOCABULARY, P.PATTERN, with_ids=False).collect()
    n = len(library.encode_ordinary(long))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, n), (1, n), (2, 1)]
