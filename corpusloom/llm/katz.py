"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

A document is its words and one end; the first word's context is the start. All words not in the learning text are one
unknown word. With count c, context h and h' the context without its first word,

    P(w | h) = d(c(h w)) c(h w) / c(h)          if c(h w) > 0,
               alpha(h) P(w | h')               else (alpha = 1 for a context never seen),
    P(w)     = d(c(w)) c(w) / N for known words, and what is left for the unknown one.

d is Good-Turing with Katz's cut at k = 5, from counts of counts over the whole learning text (a smaller k where they do not
give discounts in 0..1). alpha(h) = (1 - sum of discounted P over seen w) / (1 - sum of P(w | h') over seen w), so each
context's probabilities add up to 1. Where no seen pair of h is discounted, c(h) counts one more. ``order`` is the longest n.

``train`` stores the model as partitioned tables (order=1, order=2, ...): for each part its n-grams with counts, and its
contexts with c(h) and alpha(h). ``score`` looks texts up in these tables, lowest order first, and evaluates the recursion
for each token. Nothing of the vocabulary is broadcast. Texts are cut into chunks of CHUNK tokens, written once. A chunk
asks each part for its distinct n-grams there, sorted and packed into one message; the reply holds counts, context
totals and weights in the same order. Parts are ranges of word hashes for order 1, hashes of contexts beyond; contexts over HOT
or a millionth of all tokens are spread by their n-grams, and their totals and weights (a million at most) go along with the model.

Defined cases: null and empty texts are one end; without learning text every probability is that of the unknown word, 1;
a null doc_id belongs to the learning text; repeated rows count each; other columns are ignored; an empty table has no rows.
More than 2^32 distinct words, or n-grams under the highest order, raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop, keep, load, mixed, scratch, trim, words_of, written

#: Tokens of a chunk, and of a part, about.
CHUNK, PART = 1_000_000, 1_250_000
#: Least count of a context that is spread over parts.
HOT = 50_000
CUT = 5
END = b"\n"  # no word holds a line break
#: Numbers of the unknown word (or n-gram) and of the start; others lie between.
UNKNOWN, START = 0, 0xFFFFFFFF
U64 = np.uint64


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: the upper bytes of small numbers are all alike."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays if len(a))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else bytes(8)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    """Arrays of equal length."""
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    n, out, at = size // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(k).ravel() if n else np.empty(0, k))
        at += n * width
    return out


def discounts(counts_of_counts: dict[int, int], cut: int = CUT) -> np.ndarray:
    """d(0..cut): Katz's discounts; all 1 from the first cut on that gives no valid ones."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, cut + 2)]
    for k in range(cut, 0, -1):
        if all(n[1 : k + 2]):
            a = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else -1.0 for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return np.array([0.0, *d, *[1.0] * (cut - k)])
    return np.array([0.0, *[1.0] * cut])


def apply(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c, with d = 1 above the cut."""
    c = c.astype(np.int64)
    return np.where(c <= CUT, d[np.minimum(c, CUT)], 1.0) * c


def steps(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams as steps of the context, and of the word within its context."""
    h, w = code >> U64(32), code & U64(0xFFFFFFFF)
    same = np.r_[False, h[1:] == h[:-1]]
    return np.diff(h, prepend=U64(0)).astype(np.uint32), np.where(same, w - np.r_[U64(0), w[:-1]], w).astype(np.uint32)


def begins(code: np.ndarray) -> np.ndarray:
    """Where a context begins among sorted n-grams."""
    h = code >> U64(32)
    return np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(code) else np.empty(0, np.int64)


def unstepped(dh: np.ndarray, dw: np.ndarray) -> np.ndarray:
    if not len(dh):
        return np.empty(0, U64)
    h = np.cumsum(dh, dtype=U64)
    begin = np.r_[True, h[1:] != h[:-1]]
    start = np.flatnonzero(begin)
    total = np.cumsum(dw, dtype=U64)
    return h << U64(32) | (total - (total[start] - dw[start])[np.cumsum(begin) - 1])


class Unigrams:
    """P(w) by count; P of count 0 is the unknown word's."""

    def __init__(self, tokens: int, types: int, counts_of_counts: dict[int, int]):
        self.tokens, self.types = tokens, types
        self.d = discounts(counts_of_counts)
        seen = tokens - sum(r * counts_of_counts.get(r, 0) * (1 - self.d[r]) for r in range(1, CUT + 1))
        self.total = tokens if tokens - seen > 1e-9 * max(1, tokens) else tokens + 1
        self.unknown = 1 - seen / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, apply(c, self.d) / self.total, self.unknown)


def weighed(few: np.ndarray, lower: np.ndarray, ch: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and alpha of contexts from their numbers of n-grams seen 1 to CUT times, the seen words' sum of lower P, and c(h)."""
    loss = few @ (np.arange(1, CUT + 1) * (1 - d[1:]))
    total = np.where((few[:, d[1:] < 1] > 0).any(1), ch, ch + 1).astype(U64)
    loss = loss + (total - ch)
    return total, loss / total / np.maximum(1 - lower, 1e-300)


@dataclass
class Model:
    """The stored tables and what each task needs: sums, discounts by order, and the widespread contexts by order."""

    path: str
    order: int
    parts: int
    documents: int
    single: Unigrams
    hot_from: int
    d: dict
    hot: dict  # order -> (contexts, totals, alphas), sorted; a million at most

    def parts_of(self, code: np.ndarray, ch: np.ndarray) -> np.ndarray:
        return (np.where(ch >= self.hot_from, mixed(code), mixed(code >> U64(32))) % U64(self.parts)).astype(np.int64)


# -- chunks


CHUNKS = "chunk long, tokens binary, words binary, learnt binary, ids array<long>, held array<boolean>, lens array<int>"


def chunks(docs: DataFrame) -> DataFrame:
    """Each chunk's token numbers, its distinct words' sorted hashes with their learnt counts, and its documents; written."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        names: dict[bytes, int] = {}
        ids, held, lens, tokens, size = [], [], [], [], 0

        def rows():
            nonlocal number
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), U64, len(names))
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            flat = place[np.concatenate(tokens)]
            counts = np.bincount(flat[np.repeat(~np.array(held), lens)], minlength=len(names)).astype(U64)
            out = (task << 24 | number, packed(flat), packed(np.diff(keys[order], prepend=U64(0))), packed(counts), list(ids), list(held), list(lens))
            number += 1
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(out, types, strict=True)], ["chunk", "tokens", "words", "learnt", "ids", "held", "lens"])
            names.clear()
            for column in (ids, held, lens, tokens):
                column.clear()
            trim()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for doc_id, out, text in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                    words = words_of(text)
                    words.append(END)
                    for w in set(words).difference(names):
                        names[w] = len(names)
                    tokens.append(np.fromiter(map(names.__getitem__, words), np.uint32, len(words)))
                    ids.append(doc_id)
                    held.append(out)
                    lens.append(len(words))
                    size += len(words)
                    if size >= CHUNK:
                        yield rows()
                        size = 0
        if ids:
            yield rows()

    return keep(docs.select("doc_id", "held_out", "text").mapInArrow(run, CHUNKS), "katz-chunks")


MESSAGE = "part long, chunk long, data binary"
REPLY = "chunk long, level int, part long, data binary"


def messages(rows: list[tuple], schema: str) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)


def word_messages(texts: DataFrame, parts: int, learn: bool) -> DataFrame:
    """Each chunk's words by part, a range of hashes: with learnt counts, or hashes alone."""

    def run(batches):
        for batch in batches:
            for chunk, words, learnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.cumsum(unpacked(words, U64)[0], dtype=U64)
                counts = unpacked(learnt, U64)[0]
                if learn:
                    keys, counts = keys[counts > 0], counts[counts > 0]
                cuts = np.searchsorted((keys >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1, dtype=U64))
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[k], cuts[k + 1])
                    own = np.diff(keys[s], prepend=U64(0))
                    out.append((k, chunk, packed(own, counts[s]) if learn else packed(own)))
                yield from messages(out, MESSAGE).to_batches()

    return texts.select("chunk", "words", "learnt").mapInArrow(run, MESSAGE)


def learnt_words(key, table):
    """The model's words of a part with counts, and counts of counts."""
    got = [unpacked(d, U64, U64) for d in table.column("data").to_pylist()]
    words, which = np.unique(np.concatenate([np.cumsum(g[0], dtype=U64) for g in got]), return_inverse=True)
    counts = np.zeros(len(words), U64)
    np.add.at(counts, which.ravel(), np.concatenate([g[1] for g in got]))
    few = np.bincount(np.minimum(counts, U64(CUT + 2)).astype(np.int64), minlength=CUT + 3)[1 : CUT + 2]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([packed(np.diff(words, prepend=U64(0)), counts)], pa.binary()), pa.array([[int(counts.sum()), len(words), *few.tolist()]], pa.list_(pa.int64()))], ["part", "data", "sums"])


def found_words(parts: int):
    """Looks a part's messages up in its table: number and count of each asked word."""

    def run(key, asked, table):
        out, part = [], key[0].as_py()
        keys, counts = np.empty(0, U64), np.empty(0, U64)
        if table.num_rows:
            keys, counts = unpacked(table.column("data")[0].as_py(), U64, U64)
            keys = np.cumsum(keys, dtype=U64)
        if len(keys) * parts + part + 1 >= START:
            raise OverflowError("more words than 32-bit numbers")
        for chunk, data in zip(asked.column("chunk").to_pylist(), asked.column("data").to_pylist(), strict=True):
            own = np.cumsum(unpacked(data, U64)[0], dtype=U64)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            number = np.where(hit, at * parts + part + 1, UNKNOWN)
            out.append((chunk, 1, part, packed(number.astype(np.uint32), counts[at] * hit if len(keys) else np.zeros(len(own), U64))))
        return messages(out, REPLY)

    return run


# -- n-grams of a chunk


class Chunk:
    """A chunk's tokens with the counts, totals and weights of all levels that were looked up so far."""

    def __init__(self, row: dict, replies: dict[int, list[tuple[int, bytes]]], model: Model, levels: int):
        self.model = model
        self.lens = np.array(row["lens"], np.int64)
        self.held = np.repeat(np.array(row["held"], bool), self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        tokens = unpacked(row["tokens"], np.uint32)[0]
        got = [unpacked(d, np.uint32, U64) for _, d in sorted(replies.get(1, []))]  # ranges of hashes, in order
        self.w, self.c = np.concatenate([g[0] for g in got])[tokens], np.concatenate([g[1] for g in got])[tokens]
        self.known = self.c > 0
        self.base = np.log10(self.c + 0.5) - np.log10(model.single.tokens + 0.5 * (model.single.types + 1))
        self.number, self.p = self.w, model.single.p(self.c)
        for level in range(2, levels + 1):
            self.answered(level, replies.get(level, []))

    def grams(self):
        """code and c(h) of the n-gram that ends at each token."""
        h, ch = np.empty_like(self.number), np.empty_like(self.c)
        h[1:], ch[1:] = self.number[:-1], self.c[:-1]
        h[self.first], ch[self.first] = START, self.model.documents
        return h.astype(U64) << U64(32) | self.w, ch

    def by_part(self, code: np.ndarray, ch: np.ndarray):
        """part, and places among the sorted distinct n-grams, of each part that has some."""
        part = self.model.parts_of(code, ch)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.model.parts + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, order[cuts[k] : cuts[k + 1]]

    def questions(self, chunk: int) -> list[tuple]:
        code, ch = self.grams()
        code, at = np.unique(code[ch > 0], return_index=True)
        ch = ch[ch > 0][at]
        return [(k, chunk, packed(*steps(code[i]))) for k, i in self.by_part(code, ch)]

    def lessons(self, chunk: int) -> list[tuple]:
        """Learnt n-grams of each part with counts and lower probabilities, and c(h) of their contexts."""
        code, ch = self.grams()
        code, ch, p = code[~self.held], ch[~self.held], self.p[~self.held]
        code, at, times = np.unique(code, return_index=True, return_counts=True)
        ch, p, out = ch[at], p[at], []
        for k, i in self.by_part(code, ch):
            values, index = np.unique(p[i], return_inverse=True)
            a = packed(*steps(code[i]), times[i].astype(U64), index.ravel().astype(np.uint32))
            b, c = packed(values), packed(ch[i][begins(code[i])])
            out.append((k, chunk, len(a).to_bytes(8, "little") + len(b).to_bytes(8, "little") + a + b + c))
        return out

    def answered(self, level: int, replies: list[tuple[int, bytes]]) -> None:
        """Takes over a level's replies: P(w | h) by the recursion, c(h w) and the number of each token's n-gram."""
        code, ch = self.grams()
        asked = ch > 0
        distinct, which = np.unique(code[asked], return_inverse=True)
        first = np.empty(len(distinct), np.int64)
        first[which.ravel()] = np.flatnonzero(asked)
        c, total, alpha, number = np.zeros(len(distinct), U64), np.ones(len(distinct), U64), np.ones(len(distinct)), np.zeros(len(distinct), np.uint32)
        data = dict(replies)
        for k, i in self.by_part(distinct, ch[first]):
            size = int.from_bytes(data[k][:8], "little")
            own = unpacked(data[k][8 : 8 + size], U64, np.uint32)
            c[i], number[i] = own
            start = begins(distinct[i])
            of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(i)]))
            t, a = unpacked(data[k][8 + size :], U64, np.float64)
            total[i], alpha[i] = t[of], a[of]
        self.c, self.number = np.zeros(len(code), U64), np.zeros(len(code), np.uint32)
        seen = np.where(c > 0, apply(c, self.model.d[level]) / total, 0.0)
        p = self.p.copy()
        w = which.ravel()
        p[asked] = np.where(c[w] > 0, seen[w], alpha[w] * p[asked])
        self.c[asked], self.number[asked], self.p = c[w], number[w], p


def with_replies(texts: DataFrame, replies: DataFrame, model: Model, levels: int, made, schema: str) -> DataFrame:
    """made(chunk, Chunk, row) of each chunk, with the replies of the levels up to ``levels``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(key, text, got):
        if not text.num_rows:
            return made(None, None, None)
        by_level: dict[int, list] = {}
        for level, part, data in zip(got.column("level").to_pylist(), got.column("part").to_pylist(), got.column("data").to_pylist(), strict=True):
            by_level.setdefault(level, []).append((part, data))
        row = text.to_pylist()[0]
        out = made(row["chunk"], Chunk(row, by_level, shared.value, levels), row)
        trim()
        return out

    return texts.drop("words", "learnt").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


# -- tables of an order


def learnt_grams(model: Model):
    """The n-grams of a part with counts; its contexts' sums; counts of counts; sums of its widespread contexts."""

    def run(key, table):
        every = []
        for data in table.column("data").to_pylist():
            la, lb = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
            dh, dw, times, index = unpacked(data[16 : 16 + la], np.uint32, np.uint32, U64, np.uint32)
            code = unstepped(dh, dw)
            every.append((code, times, unpacked(data[16 + la : 16 + la + lb], np.float64)[0][index], np.repeat(unpacked(data[16 + la + lb :], U64)[0], np.diff(np.r_[begins(code), len(code)]))))
        code, at, which = np.unique(np.concatenate([e[0] for e in every]), return_index=True, return_inverse=True)
        c = np.zeros(len(code), U64)
        np.add.at(c, which.ravel(), np.concatenate([e[1] for e in every]))
        p, ch = (np.concatenate([e[k] for e in every])[at] for k in (2, 3))
        start = begins(code)
        few = np.add.reduceat(np.stack([c == U64(r) for r in range(1, CUT + 1)], 1).astype(U64), start)
        lower = np.add.reduceat(p, start)
        ch = ch[start]
        sums = np.bincount(np.minimum(c, U64(CUT + 2)).astype(np.int64), minlength=CUT + 3)[1 : CUT + 2]
        hot = [[int(code[start[k]] >> U64(32)), int(ch[k]), float(lower[k]), *few[k].tolist()] for k in np.flatnonzero(ch >= U64(model.hot_from)).tolist()]
        trim()
        return pa.table(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([packed(*steps(code), c)], pa.binary()), pa.array([packed(ch, lower, *few.T)], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([[[float(x) for x in h] for h in hot]], pa.list_(pa.list_(pa.float64())))],
            ["part", "data", "contexts", "sums", "hot"],
        )

    return run


def weights_of(model: Model, level: int):
    """A part's contexts with total and alpha in place of their sums."""

    def run(batches):
        hot, totals, alphas = model.hot[level]
        for batch in batches:
            out = []
            for part, data, contexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ch, lower, *few = unpacked(contexts, U64, np.float64, *[U64] * CUT)
                total, alpha = weighed(np.stack(few, 1).astype(float), lower, ch, model.d[level])
                code = unstepped(*unpacked(data, np.uint32, np.uint32, U64)[:2])
                spread = np.flatnonzero(ch >= U64(model.hot_from))
                at = np.searchsorted(hot, code[begins(code)][spread] >> U64(32))
                total[spread], alpha[spread] = totals[at], alphas[at]
                out.append((part, data, packed(total, alpha)))
            yield from pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.int64(), pa.binary(), pa.binary()], strict=True)], ["part", "data", "contexts"]).to_batches()

    return run


def found_grams(model: Model, level: int):
    """Looks a part's messages up in its table: counts and numbers of n-grams, totals and weights of their contexts."""

    def run(key, asked, table):
        out, part = [], key[0].as_py()
        code, c, total, alpha = np.empty(0, U64), np.empty(0, U64), np.empty(0, U64), np.empty(0)
        if table.num_rows:
            dh, dw, c = unpacked(table.column("data")[0].as_py(), np.uint32, np.uint32, U64)
            code = unstepped(dh, dw)
            total, alpha = unpacked(table.column("contexts")[0].as_py(), U64, np.float64)
        if level < model.order and len(code) * model.parts + part + 1 >= START:
            raise OverflowError("more n-grams than 32-bit numbers")
        context = code[begins(code)] >> U64(32)
        hot, totals, alphas = model.hot[level]
        for chunk, data in zip(asked.column("chunk").to_pylist(), asked.column("data").to_pylist(), strict=True):
            own = unstepped(*unpacked(data, np.uint32, np.uint32))
            at = np.minimum(np.searchsorted(code, own), max(0, len(code) - 1))
            hit = code[at] == own if len(code) else np.zeros(len(own), bool)
            counts = c[at] * hit if len(code) else np.zeros(len(own), U64)
            number = np.where(hit & (level < model.order), at * model.parts + part + 1, UNKNOWN).astype(np.uint32)
            start = begins(own)
            h = own[start] >> U64(32)
            t, a = np.ones(len(h), U64), np.ones(len(h))
            for names, x, y in ((context, total, alpha), (hot, totals, alphas)):
                if len(names):
                    k = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    same = names[k] == h
                    t[same], a[same] = x[k[same]], y[k[same]]
            # weights of contexts whose asked n-grams are all known are not needed
            a[np.logical_and.reduceat(counts > 0, start)] = 1.0
            first = packed(counts, number)
            out.append((chunk, level, part, len(first).to_bytes(8, "little") + first + packed(t, a)))
        trim()
        return messages(out, REPLY)

    return run


TABLES = {1: "part long, data binary, sums array<long>"}
GRAMS = "part long, data binary, contexts binary, sums array<long>, hot array<array<double>>"


def train_on(texts: DataFrame, parts: int, documents: int, order: int) -> tuple[Model, DataFrame]:
    """Stores the model of the chunks' learning text; also the replies of all levels for the chunks themselves, but the last."""
    spark = texts.sparkSession
    path = scratch(spark, "katz-model")
    table = lambda level, schema: spark.read.schema(schema).parquet(f"{path}/order={level}")
    written(word_messages(texts, parts, True).groupBy("part").applyInArrow(learnt_words, TABLES[1]), f"{path}/order=1")
    sums = [r["sums"] for r in table(1, TABLES[1]).select("sums").toLocalIterator()]
    total = np.sum(sums, axis=0) if sums else np.zeros(CUT + 3, np.int64)
    single = Unigrams(int(total[0]), int(total[1]), {r: int(total[1 + r]) for r in range(1, CUT + 2)})
    model = Model(path, order, parts, documents, single, max(HOT, single.tokens // 1_000_000), {}, {})
    replies = looked_up(texts, None, model, 1)
    for level in range(2, order + 1):
        lessons = with_replies(texts, replies, model, level - 1, lambda chunk, own, row: messages(own.lessons(chunk) if own else [], MESSAGE), MESSAGE)
        raw = scratch(spark, "katz-counts")
        written(lessons.groupBy("part").applyInArrow(learnt_grams(model), GRAMS), raw)
        counted = spark.read.schema(GRAMS).parquet(raw)
        n, hot = np.zeros(CUT + 1, np.int64), {}
        for row in counted.select("sums", "hot").toLocalIterator():
            n += row["sums"]
            for h, ch, *rest in row["hot"]:
                hot[int(h)] = (ch, hot.get(int(h), (0, 0))[1] + np.array(rest))
        model.d[level] = discounts({r: int(n[r - 1]) for r in range(1, CUT + 2)})
        names = sorted(hot)
        sums = np.array([hot[h][1] for h in names]).reshape(-1, CUT + 1)
        own = weighed(sums[:, 1:], sums[:, 0], np.array([hot[h][0] for h in names]).astype(U64), model.d[level])
        model.hot[level] = (np.array(names, U64), *own)
        written(counted.select("part", "data", "contexts").mapInArrow(weights_of(model, level), "part long, data binary, contexts binary"), f"{path}/order={level}")
        drop(spark, raw)
        if level < order:
            replies = replies.unionByName(looked_up(texts, replies, model, level))
    return model, replies


def looked_up(texts: DataFrame, replies: DataFrame | None, model: Model, level: int) -> DataFrame:
    """The chunks' replies from the model's table of a level, given those of the levels below; written."""
    spark = texts.sparkSession
    stored = spark.read.schema(TABLES.get(level, "part long, data binary, contexts binary")).parquet(f"{model.path}/order={level}").drop("sums")
    if level == 1:
        asked, found = word_messages(texts, model.parts, False), found_words(model.parts)
    else:
        asked = with_replies(texts, replies, model, level - 1, lambda chunk, own, row: messages(own.questions(chunk) if own else [], MESSAGE), MESSAGE)
        found = found_grams(model, level)
    return keep(asked.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(found, REPLY), f"katz-replies-{level}")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(texts: DataFrame, replies: DataFrame, model: Model) -> DataFrame:
    def made(chunk, own, row):
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if own is None:
            return pa.table([pa.array([], t) for t in types], names)
        add = lambda x: np.add.reduceat(x, own.first)
        columns = (row["ids"], row["held"], own.lens, add(own.known.astype(np.int64)), np.full(len(own.lens), model.single.tokens), add(own.base), add(np.log10(np.maximum(own.p, 1e-300))))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return with_replies(texts, replies, model, model.order, made, RESULT)


def parts_for(docs: DataFrame) -> int:
    """About one token for six bytes of text; only the number of parts depends on it."""
    return max(1, round((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 / PART))


def train(docs: DataFrame, order: int = 2) -> Model:
    """The model of docs (doc_id, text)."""
    docs = docs.withColumn("held_out", F.lit(False))
    return train_on(chunks(docs), parts_for(docs), docs.count(), order)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of docs (doc_id, text, held_out) by a stored model."""
    texts = chunks(docs)
    replies = looked_up(texts, None, model, 1)
    for level in range(2, model.order + 1):
        replies = replies.unionByName(looked_up(texts, replies, model, level))
    return scored(texts, replies, model)


def held_out_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all docs (doc_id, text, held_out) by the model of those that are not held out; chunks are made once."""
    texts = chunks(docs)
    model, replies = train_on(texts, parts_for(docs), docs.filter(~F.col("held_out")).count(), order)
    if order > 1:
        replies = replies.unionByName(looked_up(texts, replies, model, order))
    return scored(texts, replies, model)


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(crc_mod() == 1, F.lit(False)).alias("held_out"), "text")
    return held_out_scores(docs)
