"""Licence scan: windows of a text's normalised words against licence templates by Dice coefficient over word bigrams.

A window is any run of words of the text, whatever its lines and paragraphs. Normalised words are lower-case runs of
letters and digits (dots inside numbers stay); a window's profile is the multiset of its word bigrams, with an end mark
on both sides so that single words count. Two profiles of a and b bigrams that share s have the coefficient
2 s / (a + b), so one of at least t needs a size between b t / (2 - t) and b (2 - t) / t and b t / (2 - t) shared
bigrams: only where a template's bigrams stand that close are windows compared, and none that reaches t is missed.

A document gets its best match (ties: the smaller template id), the number of places (the best windows, best first,
that overlap no better one) and all ids that some window of it matches. Templates are short notices and the bodies
in licence_texts/. A map over the partitions: no shuffle, nothing broadcast but the templates.

Defined cases: null and empty texts match nothing; repeated rows are scanned each; other columns are ignored; with
no templates nothing matches; an empty table has no rows.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import load

#: Short notices by which texts state a licence (fixed values).
NOTICES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
#: Bodies of licences, without copyright lines of their holders and appendices.
BODIES = {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def profile(found: list[str]) -> Counter:
    return Counter(zip(["", *found], [*found, ""], strict=True))


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / (a.total() + b.total())


class Templates:
    """Word sequences of the templates, and tables by which windows of a text that come near them are found."""

    def __init__(self, texts: dict[str, str], threshold: float):
        found = {k: words(t) for k, t in sorted(texts.items())}
        self.threshold = threshold
        self.rows = [(k, w, len(w) + 1) for k, w in found.items() if w]
        self.ids = {w: k for k, w in enumerate(sorted({x for r in self.rows for x in r[1]}), 1)}
        self.width = len(self.ids) + 1
        own = [np.array([self.ids[x] for x in w], np.int64) for _, w, _ in self.rows]
        codes = [o[:-1] * self.width + o[1:] for o in own]
        every = np.unique(np.concatenate([np.empty(0, np.int64), *codes]))
        #: number of a bigram of two word ids, -1 where no template has it
        self.numbers = np.full(self.width**2, -1, np.int32)
        self.numbers[every] = np.arange(len(every))
        self.counts = np.zeros((len(own), len(every)), np.int32)
        for k, c in enumerate(codes):
            np.add.at(self.counts[k], self.numbers[c], 1)
        self.first, self.last = [o[0] for o in own], [o[-1] for o in own]
        size = np.array([r[2] for r in self.rows], float)
        # bigrams between words that a window of at least the threshold shares, besides both ends; the most bigrams it has
        self.need = np.ceil(size * threshold / (2 - threshold) - 1e-9).astype(np.int64) - 2
        self.most = np.floor(size * (2 - threshold) / threshold + 1e-9).astype(np.int64)

    def matches(self, text: str) -> list[tuple[float, str]]:
        """Templates that the whole text comes near."""
        found = words(text)
        own = profile(found)
        return [(d, name) for name, w, _ in self.rows if found and (d := dice(own, profile(w))) >= self.threshold]

    def near(self, text: str) -> list[Near]:
        """Templates that may have a window in the text, by the bigrams of the whole text."""
        found = words(text) if text and self.rows else []
        if not found:
            return []
        ids = np.fromiter(map(self.ids.get, found, repeat(0)), np.int64, len(found))
        numbers = self.numbers[ids[:-1] * self.width + ids[1:]]
        at = np.flatnonzero(numbers >= 0)
        held, count = np.unique(numbers[at], return_counts=True)
        shared = np.minimum(self.counts[:, held], count).sum(1)
        return [Near(self, int(k), ids, at, numbers[at]) for k in np.flatnonzero(shared >= self.need)]

    def places(self, text: str) -> tuple[list[tuple[float, str, int, int]], set[str]]:
        """dice, template, first and last word of the best windows, best first, that overlap no better one; all ids with a window.

        Ties: the smaller template id, the earlier start, the shorter window. A start whose best window is barred gets its best one
        that ends before the place that bars it.
        """
        by = {n.k: n for n in self.near(text)}
        heap = [(-hit[0], n.k, s, hit[1]) for n in by.values() for s in n.starts.tolist() if (hit := n.best(s, len(n.ids)))]
        names = {self.rows[h[1]][0] for h in heap}
        heapq.heapify(heap)
        taken, out = [], []
        while heap:
            d, k, s, e = heapq.heappop(heap)
            after = bisect.bisect_right(taken, (s, len(by[k].ids)))
            if after and taken[after - 1][1] >= s:
                continue
            if after < len(taken) and taken[after][0] <= e:
                if hit := by[k].best(s, taken[after][0]):
                    heapq.heappush(heap, (-hit[0], k, s, hit[1]))
                continue
            taken.insert(after, (s, e))
            out.append((-d, self.rows[k][0], s, e))
        return out, names


class Near:
    """The windows of a text near one template.

    A window that neither starts with the template's first word nor with a bigram it shares is bettered by the one without its first
    word, and so for its end: only windows from such starts to such ends are looked at.
    """

    def __init__(self, own: Templates, k: int, ids: np.ndarray, at: np.ndarray, numbers: np.ndarray):
        self.k, self.ids, self.threshold, self.size = k, ids, own.threshold, own.rows[k][2]
        self.most, self.first = int(own.most[k]), own.first[k]
        mine = own.counts[k][numbers]
        at, numbers, mine = at[mine > 0], numbers[mine > 0], mine[mine > 0]
        self.at = at
        # a place counts in windows that start after the bigram's place as many times back as the template has it
        order = np.argsort(numbers, kind="stable")
        group = numbers[order]
        turn = np.arange(len(at)) - np.searchsorted(group, group)
        back = np.arange(len(at)) - mine[order]
        self.since = np.empty(len(at), np.int64)
        self.since[order] = np.where(turn >= mine[order], at[order][np.maximum(back, 0)], -1)
        self.closing = np.flatnonzero(ids == own.last[k])
        self.ends = np.union1d(at + 1, self.closing)
        self.closes = ids[self.ends] == own.last[k]
        starts = np.union1d(at, np.flatnonzero(ids == self.first))
        inside = np.searchsorted(at, starts + self.most - 2) - np.searchsorted(at, starts)
        self.starts = starts[inside >= own.need[k]]

    def best(self, start: int, limit: int) -> tuple[float, int] | None:
        """dice and last word of the best window from start, below limit, if it is of the threshold."""
        limit = min(limit, start + self.most - 1)
        low, high = np.searchsorted(self.ends, (start, limit))
        if low == high:
            return None
        ends = self.ends[low:high]
        a, b = np.searchsorted(self.at, (start, limit - 1))
        counted = self.at[a:b][self.since[a:b] < start] + 1
        shared = np.searchsorted(counted, ends, "right") + self.closes[low:high] + (self.ids[start] == self.first)
        d = 2 * shared / (ends - start + 2 + self.size)
        top = int(d.argmax())
        return (float(d[top]), int(ends[top])) if d[top] >= self.threshold else None


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, licence, dice, n_matches, licences (all ids, sorted, joined by commas)."""
    texts = NOTICES | BODIES if templates is None else templates
    names = ["doc_id", "licence", "dice", "n_matches", "licences"]

    def run(batches):
        own = Templates(texts, threshold)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                places, ids = own.places(text)
                best = places[0] if places else (None, None)
                out.append((best[1], best[0], len(places), ",".join(sorted(ids))))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, dice double, n_matches long, licences string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
