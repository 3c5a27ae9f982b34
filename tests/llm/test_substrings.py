import hashlib
import random
from collections import Counter

from statera.llm import chunk_dedup, suffix_dedup


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passages = [text(k) for k in (50, 55, 80, 49, 120)]
    docs = []
    for i in range(n):
        parts = [text(rnd.randint(5, 90))]
        for p in passages:
            if rnd.random() < 0.25:
                parts += [p, text(rnd.randint(1, 40))]
        docs.append((i, (" " if i % 2 else "\n").join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1] + " tail"), (102, None), (103, ""), (104, "one"), (None, docs[5][1]), (7, docs[7][1])]
    docs.append((105, "same " * 130))
    return docs


def covered(docs, length):
    words = [(t or "").split() for _, t in docs]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        hit = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                hit |= set(range(i, i + length))
        at = sorted(hit)
        starts = [x for x in at if x - 1 not in hit]
        ends = [x + 1 for x in at if x + 1 not in hit]
        out += [(doc, s, e) for s, e in zip(starts, ends, strict=True)]
    return Counter(out)


def test_spans_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for length, gram in ((50, 8), (20, 5)):
        got = Counter(map(tuple, suffix_dedup.repeated_spans(df, length, gram).collect()))
        assert got == covered(docs, length)


def test_what_is_left_holds_each_passage(spark):
    docs = corpus()
    for length, gram in ((50, 8), (20, 5)):
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        out = suffix_dedup.owned_spans(df, length, gram).collect()
        # In one partition rows are numbered in order, so the first place is known.
        words = [(t or "").split() for _, t in docs]
        windows = [[tuple(w[i : i + length]) for i in range(len(w) - length + 1)] for w in words]
        places = {}
        for r, row in enumerate(windows):
            for i, x in enumerate(row):
                places.setdefault(x, []).append((r, i))
        owned, all_ = Counter(), Counter()
        for x, at in places.items():
            if len(at) > 1:
                owned |= Counter({(at[0][0], at[0][1] + j): 1 for j in range(length)})
                all_ |= Counter({(r, i + j): 1 for r, i in at for j in range(length)})
        got, mine = Counter(), Counter()
        for r in out:
            got.update((r.rid, i) for i in range(r.start_word, r.end_word))
            mine.update((r.rid, i) for i in range(r.start_word, r.end_word) if r.owned)
        assert got == all_ and mine == owned
        removed = {k for k in got if k not in mine}
        left = Counter(x for r, row in enumerate(windows) for i, x in enumerate(row) if len(places[x]) > 1 and not any((r, i + j) in removed for j in range(length)))
        assert set(left) == {x for x, at in places.items() if len(at) > 1}
        ids, held = [d for d, _ in docs], {}
        for r, row in enumerate(windows):
            held.setdefault(ids[r], set()).update(row)
        for r in out:
            first = range(max(0, r.start_word - length + 1), r.start_word + 1)
            assert r.first_doc_id == r.doc_id if r.owned else any(windows[r.rid][i] in held[r.first_doc_id] for i in first if i < len(windows[r.rid]))


def test_long_text(spark):
    rnd = random.Random(4)
    long = " ".join("v%d" % rnd.randrange(5000) for _ in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "ahead " + long[:400_000]), (3, "word " * 150_000), (None, long[300_000:300_900])], "doc_id long, text string")
    out = suffix_dedup.owned_spans(df).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None} and sum(r.end_word - r.start_word for r in out if r.doc_id == 3) == 150_000
    rows = chunk_dedup.owned_spans(df).collect()
    assert sum(r.end - r.start for r in rows if r.doc_id == 2) > 398_000


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, rid string")
    assert suffix_dedup.repeated_spans(df).count() == 0
    assert chunk_dedup.repeated_spans(df).count() == 0


def slow_borders(data):
    gear, out, at = chunk_dedup.GEAR.tolist(), [], 0
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        end = i + 1
        if end - at > chunk_dedup.MOST:
            at += chunk_dedup.MOST
            out.append(at)
        if h >> (32 - chunk_dedup.BITS) == 0 and end - at >= chunk_dedup.LEAST:
            at = end
            out.append(at)
    if at < len(data):
        out.append(len(data))
    return out


def test_borders_match_a_byte_loop():
    rnd = random.Random(3)
    for n in (0, 1, 15, 16, 31, 33, 300, 5000):
        data = bytes(rnd.randrange(256) for _ in range(n))
        assert chunk_dedup.borders(data) == slow_borders(data)
    flat = b"a" * 3000
    assert chunk_dedup.borders(flat) == slow_borders(flat)


def test_chunk_runs_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    cut = [[(s, e, hashlib.sha256(d[s:e]).digest()) for s, e in zip([0, *b[:-1]], b, strict=False)] for d in [(t or "").encode() for _, t in docs] for b in [chunk_dedup.borders(d)]]
    n = Counter(h for c in cut for _, _, h in c)
    want = Counter()
    for (doc, _), c in zip(docs, cut, strict=True):
        run = []
        for s, e, h in [*c, (0, 0, None)]:
            if h is not None and n[h] > 1:
                run.append((s, e))
                continue
            if run and (run[-1][1] - run[0][0] >= chunk_dedup.SPAN or len(run) == len(c)):
                want[doc, run[0][0], run[-1][1], len(run)] += 1
            run = []
    rows = chunk_dedup.repeated_spans(df).collect()
    assert Counter((r.doc_id, r.start, r.end, r.n_chunks) for r in rows) == want
    # Passages of over 50 words that repeat in other documents: a border is a matter of content, so a few of the shortest may hold
    # too few whole chunks.
    long = {d for d, s, e in covered(docs, 50) if e - s > 50 and d != 105}
    assert len(long & {r.doc_id for r in rows}) >= 0.95 * len(long)


def test_short_runs_and_short_texts(spark):
    tail = "a passage that is quite long enough to hold several whole chunks of its own, and so to be seen. " * 3
    docs = [(1, "tiny text"), (2, "tiny text"), (3, "other"), (None, "tiny text"), ("x1", "y " + tail), ("x2", "z " + tail)]
    df = spark.createDataFrame([(None if i is None else str(i), t) for i, t in docs], "doc_id string, text string").coalesce(1)
    out = chunk_dedup.owned_spans(df).collect()
    assert [(r.doc_id, r.owned, r.first_doc_id, r.end) for r in sorted(out, key=lambda r: r.rid) if r.rid < 4] == [("1", True, "1", 9), ("2", False, "1", 9), (None, False, "1", 9)]
    every = chunk_dedup.owned_spans(df, span=10_000, short=True).collect()
    assert {r.doc_id for r in every if r.short} == {"x1", "x2"} and {r.doc_id for r in every if not r.short} == {"1", "2", None}


def test_each_repeated_chunk_is_kept_once(spark):
    docs = corpus()
    shared = "a stock passage of a good many words that stands in quite a lot of other rows, word for word, from first to last"
    shared = f"{shared}, and then on through another line of it, {shared[::-1]}"
    own = " ".join(f"only{i} here{i * 7}" for i in range(60))
    docs = [(200, f"x {shared} y"), *docs, (201, f"{own} {shared} {own[::-1]}"), (202, f"{own} {shared} {own[::-1]}")]
    rows = chunk_dedup.owned_spans(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    texts, kept, removed = {}, Counter(), Counter()
    for d, t in docs:
        texts.setdefault(d, (t or "").encode())
    for r in rows:
        data = texts[r.doc_id]
        inside = [data[s:e] for b in [chunk_dedup.borders(data)] for s, e in zip([0, *b[:-1]], b, strict=False) if r.start <= s and e <= r.end]
        assert len(inside) == r.n_chunks
        (kept if r.owned else removed).update(inside)
    assert kept and set(removed) <= set(kept) and set(kept.values()) == {1}
    assert {r.owned for r in rows if r.doc_id == 201} == {True, False} and {r.owned for r in rows if r.doc_id == 202} == {False}
