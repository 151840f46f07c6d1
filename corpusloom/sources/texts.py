"""Texts from marked-up files: USFM, OSIS and TEI to one row a verse, words with trailers, corrections, tagged words.

A file is parsed whole, in one row of a map over the files: these formats nest over lines. Each parser is a plain function of a
text, and yields (book, chapter, verse, text).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .copy import escaped, read_copy, unescaped, write_copy  # noqa: F401

VERSE = "book string, chapter int, verse string, text string"
Verse = tuple[str, int, str, str]
#: USFM markers whose content is no verse text: notes, references, headings, titles (fixed values).
NOTES, HEADINGS = r"\\(f|fe|x|rq|fig)\b.*?\\\1\*", r"^\\(?:id|ide|h\d?|toc\d|toca\d|mt[e\d]*|ms\d?|mr|s\d?|sr|r|rem|cl|cp|cd|sts|usfm|periph)\b.*$"


def clean(text: str) -> str:
    return " ".join(text.split())


def usfm(text: str) -> Iterator[Verse]:
    """Verses between \\\\c and \\\\v; notes and headings dropped, character styles opened, attributes of words dropped."""
    book = (re.search(r"^\s*\\id\s+(\S+)", text, re.M) or [None, ""])[1]
    text = re.sub(HEADINGS, "", re.sub(NOTES, "", text, flags=re.S), flags=re.M)
    chapter, verse, held = 0, None, ""
    for kind, number, rest in re.findall(r"\\(c|v)\s+(\S+)((?:(?!\\[cv]\s).)*)", text, re.S):
        if verse is not None:
            yield book, chapter, verse, held
            verse = None
        if kind == "c":
            chapter = int(re.match(r"\d*", number)[0] or 0)
            continue
        rest = re.sub(r"\|[^\\]*(?=\\\+?w\*)", "", rest)
        verse, held = number, clean(re.sub(r"\\\+?[a-z]+\d*(?:\*|\s|$)", "", rest))
    if verse is not None:
        yield book, chapter, verse, held


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def osis(text: str) -> Iterator[Verse]:
    """Verses as elements, or between milestones sID and eID; notes and titles dropped."""
    now, parts = None, []

    def walk(node):
        nonlocal now, parts
        name = local(node.tag)
        if name == "verse":
            begins, ends = node.get("osisID") or node.get("sID"), node.get("eID")
            if ends and now:
                yield now, clean("".join(parts))
                now, parts = None, []
            elif begins:
                if now:  # no milestone ended the verse before
                    yield now, clean("".join(parts))
                now, parts = begins.split()[0], [node.text or ""]
                if len(node) or node.text:
                    for child in node:
                        yield from walk(child)
                    yield now, clean("".join(parts))
                    now, parts = None, []
        elif name not in ("note", "title", "header"):
            parts.append(node.text or "")
            for child in node:
                yield from walk(child)
        parts.append(node.tail or "")

    def whole():
        yield from walk(ET.fromstring(text))
        if now:
            yield now, clean("".join(parts))

    for ref, content in whole():
        book, chapter, verse = (ref.split("!")[0].split(".") + ["0", "0"])[:3]
        yield book, int(chapter), verse, content


def tei(text: str) -> Iterator[Verse]:
    """Divisions of books and chapters with verses as ab or l elements that have a number; notes dropped."""

    def words(node) -> str:
        own = "" if local(node.tag) in ("note", "fw", "head") else (node.text or "") + "".join(words(child) for child in node)
        return own + (node.tail or "")

    def walk(node, book, chapter):
        name, kind, number = local(node.tag), node.get("type"), node.get("n")
        if name == "div" and kind == "book":
            book = number or book
        elif name == "div" and kind == "chapter":
            chapter = int(number or 0)
        elif name in ("ab", "l", "seg") and number:
            yield book, chapter, number, clean((node.text or "") + "".join(words(child) for child in node))
            return
        for child in node:
            yield from walk(child, book, chapter)

    yield from walk(ET.fromstring(text), "", 0)


PARSERS: dict[str, Callable[[str], Iterator[Verse]]] = {"usfm": usfm, "osis": osis, "tei": tei}


def verses(files: DataFrame, kind: str, content: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a verse of the files (a column of whole texts), beside the columns to keep."""
    parse = PARSERS[kind]
    fields = [files.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                rows = list(parse(one.column(len(keep))[0].as_py() or ""))
                columns = [pa.concat_arrays([one.column(k)] * len(rows)) if rows else one.column(k).slice(0, 0) for k in range(len(keep))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "book", "chapter", "verse", "text"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return files.select(*keep, content).mapInArrow(run, f"{head}, {VERSE}" if head else VERSE)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Verses of the files at a path, each file a text."""
    return verses(spark.read.text(path, wholetext=True), kind)


# -- words and what follows them


def words(text: Column) -> Column:
    """Array of (surface, trailer): letters, digits and inner marks, then all up to the next word; what stands before the first word goes."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*[^\p{L}\p{M}\p{N}]*"), F.lit(0))
    surface = lambda p: F.regexp_extract(p, r"^[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*", 0)
    return F.transform(pieces, lambda p: F.struct(surface(p).alias("surface"), F.substr(p, F.length(surface(p)) + 1).alias("trailer")))


def separated(trailer: Column) -> Column:
    """A trailer that parts words: runs of white space as one space, and one at the end unless an opening mark ends it."""
    one = F.regexp_replace(trailer, r"[\s\u00A0\u2000-\u200A\u3000]+", " ")
    return F.when(one.rlike(r"[ (\[{<«“‘]$"), one).otherwise(F.concat(one, F.lit(" ")))


def assembled(parts: Column) -> Column:
    """The text of words (surface, trailer)."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["surface"], p["trailer"])), "")


def corrected(texts: DataFrame, corrections: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """texts with declared corrections (key, was, now) applied where the text is still what the correction was made for, and
    correction: applied, outdated (the text has changed since) or null."""
    fix = corrections.select(*key, F.col("was").alias("_was"), F.col("now").alias("_now"), F.lit(True).alias("_has"))
    joined = texts.join(fix, key, "left")
    fits = F.col("_has") & F.col(text).eqNullSafe(F.col("_was"))
    state = F.when(fits, "applied").when(F.col("_has"), "outdated")
    return joined.withColumn("correction", state).withColumn(text, F.when(F.col("correction") == "applied", F.col("_now")).otherwise(F.col(text))).drop("_was", "_now", "_has")


def tagged(text: Column) -> Column:
    """Array of (surface, numbers) of words written as word<G1234><H5>."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\s<>]+(?:<[A-Z]\d+>)*"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, "^[^<]+", 0).alias("surface"), F.array_distinct(F.regexp_extract_all(p, F.lit(r"<([A-Z]\d+)>"), F.lit(1))).alias("numbers")))
