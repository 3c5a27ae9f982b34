"""License scans by an exact set-similarity join of text blocks with license templates.

A block of a template T is a window of as many consecutive words as T has, wherever lines end; both sides are sets of words. A
block meets T when it holds at least THRESHOLD of T's distinct words. Words stand in global order of frequency, rarest first,
counted over all documents (only words of templates matter, so the table of counts has the size of the templates). Then
  length filter: a text of fewer than k = ceil(THRESHOLD * |T|) distinct words holds no block that meets T;
  prefix filter: a block that holds k words of T holds one of the |T| - k + 1 rarest;
  positional filter: if T's rarest word in the text is its i-th in order, at most |T| - i of its words can follow;
and what is left is verified by counting T's distinct words in every window, in one pass over the words. No block that meets
the threshold is lost, and scattered words make none. Windows that meet T and start side by side are one block.

Templates may hold one another's words. T asks for the words that tell it from any U whose own text would meet T, and a notice of a few
words for those that name its license; of blocks that overlap and whose templates are alike (THRESHOLD of the smaller one's
words) the one that holds the most words stays. Blocks without these words, and beaten ones, are found and reported, each with its
state, and give no label.

Base labels are exact phrases of consecutive words, counted over the whole text, across lines.

Defined results: null text counts as empty, with no words, no labels and score 0; null ids and repeated rows are kept as they
are; no rows give no rows; other columns are ignored; time and memory of a text follow its length, however many notices it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and the paragraphs that licenses ask to be kept, each with its label. A label may have several.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("apache", "Licensed under the Apache License Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY NC ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY NC SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("rights-reserved", "All rights reserved"),
    ("public-domain", "This work is dedicated to the public domain"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)

#: The words that name a license, of which a notice's block must hold all that the notice has. A notice is a template of at most
#: SHORT distinct words; there the threshold leaves out a word, which may be the very name.
SHORT = 20
NAMES = {
    "gpl": "gnu",
    "apache": "apache",
    "cc-by": "cc by creative commons",
    "cc-by-nc": "cc by creative commons",
    "cc-by-nd": "cc by creative commons",
    "cc-by-sa": "cc by creative commons",
    "cc-by-nc-nd": "cc by creative commons",
    "cc-by-nc-sa": "cc by creative commons",
    "mit": "mit",
    "bsd": "redistribution",
    "public-domain": "public domain",
}

#: All bytes that part words as blanks; letters A to Z are lowered before.
_PART = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_PART).split()


def need_of(words: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * words - 1e-9))


def told_by(templates, threshold: float = THRESHOLD) -> list[set[bytes]]:
    """Of each template the words that tell it from another one whose whole text would meet it, and of a notice those that name its license."""
    sets = [set(words_of(t)) for _, t in templates]
    named = [t & set(words_of(NAMES.get(label, ""))) if len(t) <= SHORT else set() for (label, _), t in zip(templates, sets)]
    return [n.union(*(t - u for u in sets if t - u and len(t & u) >= need_of(len(t), threshold))) for t, n in zip(sets, named)]


def alike(templates, threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """Pairs of templates, both ways, that share the threshold of the smaller one's words."""
    sets = [set(words_of(t)) for _, t in templates]
    return {(i, j) for i, t in enumerate(sets) for j, u in enumerate(sets) if i != j and len(t & u) >= need_of(min(len(t), len(u)), threshold)}


def template_counts(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each word of the templates; the result has the size of the templates' vocabulary."""
    vocabulary = sorted({w.decode() for _, t in templates for w in words_of(t)})
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}
    return {w.encode(): counts.get(w, 0) for w in vocabulary}


class Index:
    """Templates in global order of their words, with the prefixes that lead to them."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float = THRESHOLD):
        self.templates, self.prefix, self.place = [], {}, {}
        self.alike = alike(templates, threshold)
        for (label, text), told in zip(templates, told_by(templates, threshold), strict=True):
            words = words_of(text)
            order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            need, at = need_of(len(order), threshold), len(self.templates)
            for w in order:
                self.place.setdefault(w, len(self.place))
            self.templates.append((label, order, need, len(words), told))
            for i, w in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(w, []).append((at, i))
        self.rare = set(self.prefix)
        #: For each template, by a word's place in the vocabulary: 1 if it is a word of it, 2 if it is one that tells it.
        self.kind = np.zeros((len(self.templates), len(self.place)), np.int8)
        for at, (_, order, _, _, told) in enumerate(self.templates):
            for w in order:
                self.kind[at, self.place[w]] = 2 if w in told else 1

    def candidates(self, held: set[bytes]) -> list[int]:
        """Templates that the filters leave for a text that holds these words."""
        first: dict[int, int] = {}
        for w in self.rare & held:
            for at, i in self.prefix[w]:
                first[at] = min(i, first.get(at, i))
        out = []
        for at, i in sorted(first.items()):
            _, order, need, _, told = self.templates[at]
            if len(held) >= need and len(order) - i >= need and sum(w in held for w in order[i:]) >= need:
                out.append(at)
        return out


def held_by_window(at: np.ndarray, word: np.ndarray, width: int, starts: int) -> np.ndarray:
    """Distinct words in each window of width words; at, word: places of the words that count. One pass, whatever the width."""
    order = np.lexsort((at, word))
    at, word = at[order], word[order]
    before = np.where(np.concatenate(([False], word[1:] == word[:-1])), np.concatenate(([-1], at[:-1])), -1)
    # A place counts in the windows that hold it and not the place of the same word before.
    lo, hi = np.maximum(np.maximum(before + 1, at - width + 1), 0), np.minimum(at, starts - 1)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    return np.cumsum(np.bincount(lo, minlength=starts + 1) - np.bincount(hi + 1, minlength=starts + 1))[:starts]


def _runs(good: np.ndarray, held: np.ndarray, width: int, n: int) -> list[tuple[int, int, int]]:
    """(first word, word behind the last, most words held) of each run of good windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    if not len(edge):
        return []
    best = np.maximum.reduceat(np.append(held, 0), edge)[::2]
    return list(zip(edge[::2].tolist(), np.minimum(edge[1::2] - 1 + width, n).tolist(), best.tolist(), strict=True))


def blocks_of(words: list[bytes], index: Index) -> list[tuple[int, int, int, int, str]]:
    """(template, first word, word behind the last, words held, state) of all blocks that meet a template. state: untold where words that tell
    or name the template are missing, beaten where a block of a like template is better, else empty: only these label the text."""
    if index.rare.isdisjoint(words):
        return []
    found: dict[int, list[tuple[int, int, int]]] = {}
    out = []
    some = index.candidates(set(words))
    if not some:
        return []
    n, place = len(words), index.place
    at = np.array([i for i, w in enumerate(words) if w in place], np.int64)
    word = np.array([place[words[i]] for i in at.tolist()], np.int64)
    for t in some:
        _, _, need, width, told = index.templates[t]
        starts, kind = max(1, n - width + 1), index.kind[t][word]
        held = held_by_window(at[kind > 0], word[kind > 0], width, starts)
        good = held >= need
        if told and good.any():
            named = held_by_window(at[kind == 2], word[kind == 2], width, starts) == len(told)
            out += [(t, *run, "untold") for run in _runs(good & ~named, held, width, n)]
            good &= named
        runs = _runs(good, held, width, n)
        if runs:
            found[t] = runs
    for t, mine in found.items():
        rivals = [found[u] for u in found if (t, u) in index.alike]
        rank = [(len(index.templates[u][1]), u) for u in found if (t, u) in index.alike]
        size, ahead = len(index.templates[t][1]), [0] * len(rivals)
        for s, e, held in mine:  # blocks rise in both ends, so each rival's list is walked once
            beaten = False
            for k, theirs in enumerate(rivals):
                while ahead[k] < len(theirs) and theirs[ahead[k]][1] <= s:
                    ahead[k] += 1
                i = ahead[k]
                while not beaten and i < len(theirs) and theirs[i][0] < e:
                    other, (their_size, u) = theirs[i][2], rank[k]
                    beaten = (other, other / their_size, -u) > (held, held / size, -t)
                    i += 1
            out.append((t, s, e, held, "beaten" if beaten else ""))
    return out


def scan_text(text: str, index: Index, phrases: dict[bytes, str]) -> tuple:
    """n_words, places of base phrases, base labels, blocks [(first word, end, label, containment, state)] of one text."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        at, seen, n = -1, 0, 0
        while (at := flat.find(b" %s " % phrase, at + 1)) >= 0:
            n += flat.count(b" ", seen, at)
            seen = at
            places.append(n)
            base.add(label)
    blocks = [(s, e, index.templates[t][0], held / len(index.templates[t][1]), state) for t, s, e, held, state in blocks_of(words, index)]
    return len(words), places, base, blocks


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks of every row."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, template_counts(docs, templates), threshold))
    phrases = {p.encode(): label for p, label in phrases.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first_word:long,end_word:long,label:string,containment:double,state:string>>"
    names = ["first_word", "end_word", "label", "containment", "state"]
    block = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()), strict=True)))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, places, base, blocks = scan_text(text.as_py() or "", index.value, phrases)
                labels = base | {label for _, _, label, _, state in blocks if not state}
                score = 1.0 if base else max((c for *_, c, state in blocks if not state), default=0.0)
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(names, b, strict=True)) for b in blocks]))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")
