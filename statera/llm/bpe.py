"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged on its own. Its tokens form a linked list; the place of a pair waits in the
bucket of the pair's merge rank, and a two-level bitmap over ranks (words of 256 bits, the upper word as long as need be)
names the next non-empty bucket by find-first-set. A place popped from a bucket is stale, and skipped, if the pair there has another rank by now. Every merge adds at most two
entries, so a pre-token of n bytes takes O(n log n) steps however long it is: the logarithm is that of the heap which keeps
a bucket's places from left to right.

Pre-tokens that a task meets for the first time are merged together: they are one array of places, linked inside each pre-token only, and
a bucket then holds the places of its rank in all of them. A bucket is taken whole, its places from left to right, of which a
place that the one before has just used up is stale; ranks of new pairs go to later buckets. Where a new pair
may have a lower rank than the one at hand, which is rare in a vocabulary made by merges in order of rank, the pre-token is merged anew by itself.

Work per row is a small helper in Python; Spark reads, deals out and writes the rows. Vocabulary files are read on the
driver and broadcast: a vocabulary has a fixed size (50,256 entries here).

Defined results: null text counts as empty and gives no ids; null ids and repeated rows are kept as they are; no rows give no
rows; other columns are ignored (or kept, in encode).
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Finished pre-tokens a Python worker remembers, each of REMEMBER_CHARS characters at most; then it starts anew.
REMEMBER, REMEMBER_CHARS = 1_000_000, 32
#: Characters of texts that are split at a time, and new pre-tokens from which on they are merged together.
CHUNK_CHARS, TOGETHER = 4_000_000, 2_000
_BIT = [1 << i for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Merger:
    """Encodes one pre-token after another by a table of ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values(), default=0) + 1
        self.ranks, self.low = ranks, [0] * ((self.n >> 8) + 1)
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: Rank of left + right by left * n + right, for every split of every entry into two entries.
        self.pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    self.pairs[a * self.n + b] = rank

    def __call__(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        find, base, low, bit, buckets, top = self.pairs.get, self.n, self.low, _BIT, {}, 0
        tok = [self.single[b] for b in piece]
        n = len(tok)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [None] * n
        for at in range(n - 1):
            rank = pair[at] = find(tok[at] * base + tok[at + 1])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(at)  # places rise, so a list is a heap
                else:
                    buckets[rank] = [at]
                    low[rank >> 8] |= bit[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = word << 8 | first.bit_length() - 1
            places = buckets[rank]
            if len(places) > 1:
                at = heappop(places)
            else:
                at = places[0]
                del buckets[rank]
                low[word] = bits = bits ^ first
                if not bits:
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[at] = after[gone]
            tok[at], pair[gone], pair[at] = rank, None, None
            if end < n:
                before[end] = at
                new = pair[at] = find(rank * base + tok[end])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
            if at:
                left = before[at]
                new = pair[left] = find(tok[left] * base + rank)
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        out, at = [], 0
        while at < n:
            out.append(tok[at])
            at = after[at]
        return out


class Batch:
    """Merges many pre-tokens at once, by the same ranks as a Merger."""

    def __init__(self, merge: Merger):
        self.merge, self.n = merge, merge.n
        self.single = np.array(merge.single, np.int64)
        keys, ranks = np.fromiter(merge.pairs.keys(), np.int64, len(merge.pairs)), np.fromiter(merge.pairs.values(), np.int64, len(merge.pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], -1)
        #: Ids that are in a pair of a lower rank.
        self.early = {*(keys // self.n)[ranks < keys // self.n].tolist(), *(keys % self.n)[ranks < keys % self.n].tolist()}

    def find(self, a, b) -> np.ndarray:
        key = a * self.n + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers; no piece is empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(ends[-1])
        # Place n stands for no neighbour.
        tok = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        after, before, live = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        after[ends - 1], before[starts] = n, n
        pair = np.full(n + 1, -1)
        pair[:n] = np.where(after[:n] < n, self.find(tok[:n], tok[after[:n]]), -1)
        buckets, low, top, odd = {}, [0] * len(self.merge.low), 0, set()

        def put(places: np.ndarray, ranks: np.ndarray) -> int:
            """Places to the buckets of their ranks; the words whose bits that sets."""
            words, order = 0, np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            places, firsts = places.tolist(), ranks[cuts[:-1]].tolist()
            for rank, a, b in zip(firsts, cuts, cuts[1:]):
                if rank in buckets:
                    buckets[rank] += places[a:b]
                else:
                    buckets[rank] = places[a:b]
                    low[rank >> 8] |= _BIT[rank & 255]
                    words |= 1 << (rank >> 8)
            return words

        here = np.flatnonzero(pair >= 0)
        if len(here):
            top = put(here, pair[here])
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = word << 8 | first.bit_length() - 1
            low[word] = bits = bits ^ first
            if not bits:
                top &= top - 1
            at = np.unique(np.array(buckets.pop(rank)))
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            gone = after[at]
            touching = gone[:-1] == at[1:]
            if touching.any():  # of places in a row every other one is used up by the one before
                place = np.arange(len(at))
                since = place - np.maximum.accumulate(np.where(np.append(True, ~touching), place, 0))
                at, gone = at[since % 2 == 0], gone[since % 2 == 0]
            end = after[gone]
            if rank in self.early:  # between two merges side by side a pair of a lower rank may have stood
                beside = end[:-1] == at[1:]
                odd.update(np.searchsorted(ends, at[:-1][beside], "right").tolist())
            after[at], before[end], tok[at], pair[gone], live[gone] = end, at, rank, -1, False
            left = before[at]
            right_rank, left_rank = np.where(end < n, self.find(rank, tok[end]), -1), np.where(left < n, self.find(tok[left], rank), -1)
            pair[at], pair[left] = right_rank, left_rank
            places, ranks = np.concatenate((at, left)), np.concatenate((right_rank, left_rank))
            known = ranks >= 0
            if known.any():
                places, ranks = places[known], ranks[known]
                if ranks.min() < rank:
                    odd.update(np.searchsorted(ends, places[ranks < rank], "right").tolist())
                top |= put(places, ranks)
        live, tok = live[:n], tok[:n].astype("<u4")
        counts = np.add.reduceat(live.astype(np.int64), starts)
        cuts, data = [0, *(4 * np.cumsum(counts)).tolist()], tok[live].tobytes()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in odd:
            out[i] = np.array(self.merge(pieces[i]), "<u4").tobytes()
        return out


class Codec(dict):
    """Pre-tokens to their ids as little-endian 32-bit integers; what is missing is merged, and remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.merge, self.split = Merger(ranks), regex.compile(pattern).findall
        self.together = Batch(self.merge)
        self.bytes_of = np.empty(self.merge.n, object)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Merges those of words that aren't remembered."""
        ranks = self.merge.ranks
        new = [w for w in words if w not in self and len(w) <= REMEMBER_CHARS]
        if len(new) < TOGETHER:
            return  # one by one when they are met
        if len(self) + len(new) > REMEMBER:
            self.clear()
            new = [w for w in words if len(w) <= REMEMBER_CHARS]
        open_, pieces = [], []
        for w in new:
            piece = w.encode()
            rank = ranks.get(piece)
            if rank is None:
                open_.append(w)
                pieces.append(piece)
            else:
                self[w] = rank.to_bytes(4, "little")
        if pieces:
            self.update(zip(open_, self.together(pieces)))

    def encode_all(self, texts: list[str]):
        """Ids of each text in turn; texts are split some CHUNK_CHARS characters at a time."""
        held, size = [], 0
        for text in [*texts, None]:
            if text is not None:
                held.append(self.split(text))
                size += len(text)
            if held and (text is None or size >= CHUNK_CHARS):
                words: set[str] = set()
                for h in held:
                    words.update(h)
                self.learn(words)
                for h in held:
                    yield np.frombuffer(b"".join(map(self.__getitem__, h)), "<u4")
                held, size = [], 0

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


_CODECS: dict = {}


def _codec(shared) -> Codec:
    """One per vocabulary and Python worker: tasks that follow each other go on with what is remembered."""
    ranks, pattern, key = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The columns keep of every row, with n_tokens, ids_sha256, decoded_sha256 and, on request, ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern, (vocabulary, pattern)))
    keep = ["doc_id"] if keep is None else keep
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            counts, a, b, all_ids = [], [], [], []
            for ids in codec.encode_all([t or "" for t in batch.column(len(keep)).to_pylist()]):
                counts.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            out = [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *all_ids]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
