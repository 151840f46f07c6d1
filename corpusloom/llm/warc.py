"""WARC archives: a writer that stores equal payloads once, and a reader verified by its chain of boundaries.

Writing is native: header and payload become one string, and Spark's text writer puts the record terminator
(two line breaks) after each, so archives land wherever Spark can write. Of records with equal payloads of at
least ``min_bytes`` the one with the largest page_id is the response; the others are revisits of it without a payload.
Who revisits whom is found among digests and ids alone. A bitmap of at most ``bits`` bits over the hashes of the revisits
then lets responses go from the scan straight to the archive: no payload is shuffled but those of responses
whose place in the bitmap a revisit marks by chance, which a join on digest and id tells apart.

Reading takes byte blocks of the archives. A task emits the candidate records of its block (a version line at the
file's start or after an empty line, with a header of any length that parses) with the offset of their successors, already
followed to the first one outside the block. Pointer jumping from the start of each file keeps the reachable ones, so magic
inside a payload, which no record leads to, falls away. Then each block is walked from its entry. Payloads are never shuffled.

Defined cases: null html is the empty payload, a null url is empty; rows that share the largest page_id of a
payload are all responses; a null page_id never wins; a payload that all rows with null ids share is a response
each time; other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, load, scratch

#: Bytes of a block, and of one look beyond what is held.
BLOCK, LOOK = 16 << 20, 64 << 10
#: Tasks that share the blocks, at most.
TASKS = 50_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Bare upper-case base32 SHA-1, 40 bits of the hexadecimal digits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def marks(keys: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """bucket, bitmap of the places of the keys' hashes, and the number of places: at least 16 a key, but at most bits."""
    places = min(bits, 1 << max(15, (16 * keys.count()).bit_length()))
    table = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(places)).alias("place")).groupBy(F.expr("place div 32768").alias("bucket"))
    return table.agg(F.bitmap_construct_agg(F.expr("place % 32768")).alias("bitmap")), places


def marked(data: DataFrame, names: list[str], table: DataFrame, places: int) -> DataFrame:
    """data with the boolean marked; the broadcast table holds at most an eighth of ``bits`` bytes."""
    data = data.withColumn("place", F.pmod(F.xxhash64(*names), F.lit(places))).withColumn("bucket", F.expr("place div 32768"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(place % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) > 0, F.lit(False))
    return data.join(F.broadcast(table), "bucket", "left").withColumn("marked", bit).drop("bucket", "bitmap", "place")


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", bits: int = 1 << 27) -> DataFrame:
    """One column of strings: whole records without their terminator."""
    data = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    data = data.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    light, key = data.drop("html"), ["digest", "page_id"]
    shared = light.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1").drop("n")
    again = keep(light.join(shared, "digest").filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to"), "warc-revisits")
    keys = again.select(*key).distinct()
    scanned = marked(data, key, *marks(keys, bits))
    same = lambda x, y: (F.col(f"{x}.digest") == F.col(f"{y}.digest")) & F.col(f"{x}.page_id").eqNullSafe(F.col(f"{y}.page_id"))
    chance = scanned.filter("marked").select(*key).alias("x").join(keys.alias("y"), same("x", "y"), "left_anti").distinct()
    chance = keep(chance, "warc-chance")
    twice = marked(scanned.filter("marked").drop("marked"), key, *marks(chance, bits)).filter("marked")
    twice = twice.alias("x").join(chance.alias("y"), same("x", "y"), "left_semi")
    first = scanned.filter("NOT marked").unionByName(twice).drop("marked").withColumn("refers_to", F.lit(None).cast("long"))
    data = first.unionByName(again.withColumn("html", F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, "html"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return data.select(F.concat(header, body).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, bits: int = 1 << 27) -> None:
    records(pages, min_bytes, bits=bits).write.option("lineSep", "\r\n\r\n").text(path)


def opened(path: str):
    """A readable file at a path or URI that every executor can reach."""
    path = re.sub(r"^s3[an]:", "s3:", path)
    if path.startswith("file:") or "://" not in path:
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def fields(header: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name, None if it is no record's header."""
    if not VERSION.match(header):
        return None
    out = {}
    for line in header.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out if out.get("content-length", "").isdigit() else None


class Held:
    """Bytes of an open file from an offset on, of which more are read as they are asked for."""

    def __init__(self, file, base: int, size: int):
        self.file, self.base = file, base
        file.seek(base)
        self.data = bytearray(file.read(size))

    def more(self, size: int) -> bool:
        got = self.file.read(size)
        self.data += got
        return bool(got)

    def header_end(self, at: int) -> int:
        """The offset of the first empty line from at on, -1 without one."""
        start, look = at - self.base, LOOK
        while True:
            end = self.data.find(b"\r\n\r\n", start)
            if end >= 0:
                return self.base + end
            start = max(at - self.base, len(self.data) - 3)
            if not self.more(look):
                return -1
            look *= 2

    def part(self, first: int, last: int) -> bytes:
        if last - self.base > len(self.data):
            self.more(last - self.base - len(self.data))
        return bytes(self.data[first - self.base : last - self.base])


def candidates(held: Held, start: int, end: int) -> dict[int, tuple[int, int]]:
    """Offset -> (start of the record's block of content, successor) of the candidates from start to before end."""
    out = {}
    held.part(start, end + 10)  # a version line may reach over the end
    places = [held.base + m.start() for m in VERSION.finditer(held.data) if start <= held.base + m.start() < end]
    for at in places:
        if at and held.part(max(held.base, at - 4), at) != b"\r\n\r\n":
            continue
        stop = held.header_end(at)
        if stop >= 0 and (f := fields(held.part(at, stop))):
            out[at] = (stop + 4, stop + 4 + int(f["content-length"]) + 4)
    return out


def exits(found: dict[int, tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """For each candidate the first offset from end on that its chain reaches, or -1 if it breaks before."""
    to: dict[int, int] = {}
    for at in sorted(found, reverse=True):
        following = found[at][1]
        to[at] = following if following >= end else to.get(following, -1)
    return sorted(to.items())


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Verified records: file, position, page_id, record_type, refers_to, payload_bytes, payload_digest, payload_ok."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").filter("length > 0")
    count = F.expr(f"(length + {block} - 1) div {block}")
    rounds, total = (x or 0 for x in files.agg(F.max(count), F.sum(count)).first())  # blocks of the longest file, and of all
    tasks = max(1, min(total, TASKS))  # stated, as rows this small would else be coalesced into one task
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("block"))
    blocks = blocks.repartition(tasks, "path", "block")

    def find(batches):
        for batch in batches:
            for name, length, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = number * block
                with opened(name) as f:
                    got = exits(candidates(Held(f, max(0, start - 4), block + 4), start, min(start + block, length)), min(start + block, length))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["path", "at", "to"])

    entries = files.select("path", F.lit(0).cast("long").alias("at"))
    jumps = keep(blocks.mapInArrow(find, "path string, at long, to long").filter("to >= 0"), "warc-jumps")
    covered = 1
    while True:  # reach doubles: after k rounds all entries of 2**k blocks in a row are known
        step = entries.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        entries = keep(entries.unionByName(step).distinct(), "warc-entries")
        covered *= 2
        if covered >= rounds:
            break
        second = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("last"))
        jumps = keep(jumps.join(second, ["path", "to"]).select("path", "at", F.col("last").alias("to")), "warc-jumps")
    starts = entries.withColumn("block", F.expr(f"at div {block}")).join(files, "path").filter("at < length").select("path", "length", "block", "at")

    def walk(batches):
        names = ["file", "position", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload_ok"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for name, length, number, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, end = [], min((number + 1) * block, length)
                with opened(name) as f:
                    held = Held(f, at, end - at)
                    while at < end:
                        stop = held.header_end(at)
                        head = fields(held.part(at, stop)) if stop >= 0 else None
                        if head is None:
                            raise ValueError(f"{name}: no record at {at}")
                        first, size = stop + 4, int(head["content-length"])
                        content = held.part(first, first + size)
                        http, _, payload = content.partition(b"\r\n\r\n")
                        stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        revisit = head.get("warc-type") == "revisit"
                        digest = stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        whole = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                        number_of = lambda x: int(m[1]) if (m := re.search(r"urn:x-page:(-?\d+)>", x)) else None
                        out.append((name, at, number_of(head.get("warc-record-id", "")), head.get("warc-type"), number_of(head.get("warc-refers-to", "")) if revisit else None, int(whole[1]) if revisit and whole else len(payload), digest, digest == stated))
                        at = first + size + 4
                for k in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 5000], strict=True), types, strict=True)], names)

    return starts.repartition(tasks, "path", "block").mapInArrow(walk, "file string, position long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload_ok boolean")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(load(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")
