"""Sum-of-squares packing of token sequences into windows.

A document's ids are cut into full windows and a rest. The rests arrive online. N(h) is the number of partly filled windows at
level h, which an array tracks; a rest goes, whole, where the sum of squares of N(h) grows least: onto a window it fits into, or
into a new one. Once ``most_open`` windows are partly filled (sizes that never fit together leave many) a rest gets no new
window: instead of that it may be cut, its first part filling a window up and its remainder starting one, again where the sum of
squares grows least. At the end of a task the emptiest windows are taken apart and placed by this second rule until one is
left, so each task pads one window at most.

Every task packs its own partition of the scan, so nothing is shuffled, and a repeated task gives the same
windows: ids are (partition, running number). Memory holds the ids of partly filled windows, not texts.

Ids: the tokenizer file at ``tokenizer_path``, each text's ids followed by ``end_id``.

Defined cases: null and empty texts are the one id ``end_id``; repeated rows are packed as often as they occur; rows with a
null doc_id are packed too; columns other than doc_id and text are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import load

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENIZERS: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level tokenizer splits texts before merging (fixed value, published with its vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Where a byte-level vocabulary file's merges are in the order of their ids, a rank-based encoder over the same vocabulary
    gives the same ids, several times as fast; other files, and texts that hold a special token's string, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranked(path):
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in token): rank for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def ranked(path: str) -> bool:
    """Whether a tokenizer file is byte-level with the usual splits, changes no text before, and has its merges in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("type") != "BPE":
        return False
    if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = [model["vocab"].get(x + y, -1) for x, y in pairs]
    letters = byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return all(x < y for x, y in zip([-1, *ids], ids, strict=False)) and all(t in special or all(c in letters for c in t) for t in model["vocab"])


def tokenizer(path: str) -> Ids:
    """One a Python worker, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


class Packer:
    """Online sum-of-squares packing; a window is a list of pieces (document, start, length)."""

    def __init__(self, window: int, most_open: int = 1024):
        self.window, self.most_open = window, most_open
        self.level = np.zeros(window, np.int64)  # N(h)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.count = 0  # of partly filled windows

    def choice(self, size: int, new: bool) -> int:
        """The level of the window that a piece of size ids goes to; 0 is a new one. Without new ones it may be cut."""
        n, w = self.level, self.window
        never = np.iinfo(np.int64).max
        # growth of the sum of squares: where it fits, 2 N(h + size) - 2 N(h) + 2, or 1 - 2 N(h) where it fills up; where it is
        # cut, the window leaves its level and the remainder starts one
        growth = 2 - 2 * n
        growth[1 : w - size] += 2 * n[1 + size :]
        growth[w - size] -= 1
        growth[w - size + 1 :] = never if new else growth[w - size + 1 :] + 2 * n[1:size]
        growth[n == 0] = never
        growth[0] = 2 * n[size] + 1 if new else never
        least = growth.min()
        whole = np.flatnonzero(growth[: w - size + 1] == least)
        # among equals a piece stays whole, and goes to the fullest window
        return int(whole[-1]) if len(whole) else int(growth.argmin())

    def place(self, doc: int, start: int, size: int, new: bool = True) -> list | None:
        """Puts a piece of under window ids in its place; returns the window this fills."""
        at = self.choice(size, new and self.count < self.most_open or not self.count)
        held = self.open[at].pop() if at else []
        if at:
            self.level[at] -= 1
            self.count -= 1
        cut = min(size, self.window - at)
        held.append((doc, start, cut))
        if at + cut < self.window:
            self.put(held, at + cut)
            return None
        if cut < size:
            self.put([(doc, start + cut, size - cut)], size - cut)
        return held

    def put(self, held: list, level: int) -> None:
        self.level[level] += 1
        self.open[level].append(held)
        self.count += 1

    def close(self):
        """The windows still open, the emptiest dealt out over the others until one is left."""
        while self.count > 1:
            lowest = int(np.flatnonzero(self.level)[0])
            self.level[lowest] -= 1
            self.count -= 1
            for piece in self.open[lowest].pop():
                if full := self.place(*piece, new=False):
                    yield full
        for held in self.open:
            yield from held
        self.__init__(self.window, self.most_open)


def pack(documents: DataFrame, tokenizer_path: str | None = None, window: int = 1024, end_id: int = 0, most_open: int = 1024) -> DataFrame:
    path = tokenizer_path or default_tokenizer()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        ids, packer, number = tokenizer(path), Packer(window, most_open), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        out: list[list] = [[] for _ in names]
        docs: dict[int, list] = {}  # by running number: doc_id, bytes from the rest on, start of the rest, ids, pieces left
        count = 0

        def put(pieces):
            nonlocal number
            at = 0
            for key, start, size in pieces:
                doc_id, data, base, total = docs[key][:4]
                crc = zlib.crc32(data[4 * (start - base) : 4 * (start - base + size)])
                for column, value in zip(out, (doc_id, start, size, crc, total, number, at), strict=True):
                    column.append(value)
                at += size
                docs[key][4] -= size
                if not docs[key][4]:
                    del docs[key]
            number += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = ids.encode(text or "") + end
                    total, start = len(data) // 4, 0
                    count += 1
                    docs[count] = [doc_id, data, 0, total, total]
                    while total - start >= window:
                        put([(count, start, window)])
                        start += window
                    if start < total:
                        docs[count][1:3] = data[4 * start :], start
                        if full := packer.place(count, start, total - start):
                            put(full)
                if len(out[0]) > 5000:
                    yield flush()
        for pieces in packer.close():
            put(pieces)
        yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(docs)
