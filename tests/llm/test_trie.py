import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from statera.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth long, len string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        under = [k for k in members if k[: len(node)] == node]
        kids = [k for k in under if len(k) == len(node) + 1]
        leaves = [k for k in under if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in under)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some(n, seed, longest=7, words=2):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        c = rnd.choice([c, c, c, -c, c * 1000])
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", None]), rnd.choice(["é" * (1 + t % 3), None, "", "x"][:words]), 1, "x"))
    rows += [(900 + i, t, "user", f"same {t}", 1, "x") for i in range(25) for t in range(9)]
    return rows + [(None, 1, "user", "x", 1, "x")] + rows[:3]


def nodes(spark, rows, local):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    head = T.F.crc32(T.F.col("conv").cast("string").cast("binary")) % 9
    turns, lengths = T.rebuilt(df, T.F.col("conv") - T.F.col("conv") % 5, head)
    return sorted(map(tuple, T.trie(turns, T.sequences(turns, lengths), local).collect()), key=repr)


@pytest.mark.parametrize("local", [1, 12, 20_000])
def test_nodes_equal_brute_force_at_every_bucket_size(spark, local):
    rows = some(40, 3)
    assert nodes(spark, rows, local) == brute(rows)


def test_long_conversations_are_cells_and_chains(spark, monkeypatch):
    monkeypatch.setattr(T, "CELL", 2)
    rows = [(c, t * 3, "user", f"w{t if c < 15 else c}", 1, "x") for c in (10, 12, 30, 31) for t in range(40)] + some(6, 4)
    assert nodes(spark, rows, 15) == brute(rows)


def test_frequent_turns(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_FREQUENT", 1)
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}", 1, "x") for c in range(600) for t in range(3)] + [(c, 9, "user", "hello", 1, "x") for c in range(600)]
    got = nodes(spark, rows, 50)
    assert sum(1 for r in got if r[1] == 0) == 1 and max(r[1] for r in got) >= 3
    want = rebuilt(rows)
    assert len(got) == len({tuple(v[:d]) for v in want.values() for d in range(len(v) + 1)})


def test_edges(spark):
    assert nodes(spark, [(None, 1, "a", "b", 1, "x")], 10) == []
    one = [(7, None, None, None, 1, "x")]  # crc32 % 9 decides whether its own turn stays
    assert nodes(spark, one, 10) == brute(one)
    long = [(1, t, "user", "y" * 300_000, 1, "x") for t in range(12)]
    assert nodes(spark, long, 10) == brute(long)


def test_multikey_quicksort():
    rnd = random.Random(2)
    seqs = [[1] + [rnd.randrange(3) for _ in range(rnd.randrange(9))] for _ in range(200)]
    found = T.quicksorted(seqs)
    want = {tuple(s[:d]) for s in seqs for d in range(1, len(s) + 1)}
    assert len(found) == len(want)
    for parent, members in found:
        assert parent < 0 or set(members) <= set(found[parent][1])
