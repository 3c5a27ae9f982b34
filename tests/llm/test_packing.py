import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statera.llm import packing as K

VOCABULARY = P.path("byte_bpe_50k.json")


def loads(histogram, intervals):
    load, ranks = Counter(), defaultdict(list)
    for length, low, n, first, each in intervals:
        ranks[length].append((low, n))
        for r in range(n):
            load[first + r // each] += length
    for length, n in histogram.items():
        at = 0
        for low, m in sorted(ranks[length]):
            assert low == at
            at += m
        assert at == n
    return load


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    for trial in (*K.TRIALS, (0.1, 3)):
        intervals, n = K.plan(histogram, 64, [trial])
        load = loads(histogram, intervals)
        assert set(load) == set(range(n)) and max(load.values(), default=0) <= 64


def fewest(sizes, capacity):
    """Least number of sequences, by all subsets that fill one."""
    n = len(sizes)
    fits = [s for s in range(1, 1 << n) if sum(sizes[i] for i in range(n) if s >> i & 1) <= capacity]

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        low = left & -left
        return 1 + min(best(left & ~s) for s in fits if s & low and s & left == s)

    return best((1 << n) - 1)


def test_close_to_the_fewest():
    rnd = random.Random(4)
    for _ in range(25):
        sizes = [rnd.randrange(1, 20) for _ in range(9)]
        assert K.plan(Counter(sizes), 20)[1] <= fewest(sizes, 20) + 1
    lengths = Counter(rnd.randrange(1, 1025) for _ in range(20000))
    assert K.plan(lengths, 1024)[1] <= 1.01 * math.ceil(sum(k * v for k, v in lengths.items()) / 1024)
    # Three in a sequence fit only in the right mixture: best fit alone needs a tenth more.
    thirds = Counter(rnd.randrange(250, 450) for _ in range(20000))
    assert K.plan(thirds, 1024)[1] <= 1.04 * math.ceil(sum(k * v for k, v in thirds.items()) / 1024)


def test_rows(spark):
    rnd = random.Random(1)
    words = ["alpha", "bêta", " ", "\n\n", "12", "日本", "🙂", "<|endoftext|>", "it's"]
    texts = [None, "", *["".join(rnd.choice(words) for _ in range(rnd.choice([1, 30, 400, 1500]))) for _ in range(40)], "word " * 1023, "word " * 2047, "a" * 20000]
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, plan string, length long").repartition(3)
    got = K.pack(df, VOCABULARY, P.PATTERN, with_ids=True).collect()
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert K.pack(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_ranks_of_the_file_are_the_merges():
    ranks = K.read_ranks(VOCABULARY)
    assert len(ranks) == 50256 and sorted(ranks.values()) == list(range(50256))
    assert all(bytes([b]) in ranks for b in range(256))
