"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document's set holds its distinct five-word shingles (64-bit hashes). Two sets link when 100 |A and B| >= 75 |A or B|.

1. All shingles stand in one global order: the commonest last, else by hash. Any order gives the same links; this one keeps
   common passages out of prefixes. Which are common is counted over all documents: each chunk reports the shingles that two
   of its distinct sets hold, and the highest levels floor(log2(sum)) of at most ``common`` shingles (a bound on what is
   broadcast) are put last, level by level.
2. A set of n shingles links only to sets that share one of its first n - ceil(0.75 n) + 1. Documents with identical
   prefix and size form one group; only groups are posted, packed by ranges of shingles.
3. Within a list of up to ``SHORT`` groups all pairs, in a longer one neighbours in an order common to all lists, are
   candidates; sizes, the number of shingles their prefixes share and counts of hashes in 64 bins filter them. Some a group, and each group's members against
   its first one, are verified on whole sets: a first forest of links.
   Two more forests try groups that are still apart: the last one, within each long list, the pairs whose bins leave most room.
4. The short lists' pairs and the long lists (in pairs of slices of ``SLICE`` groups, so that a long list is many tasks) are searched
   for all remaining pairs, but only between groups or members that no link connects yet. So every link is either found or inside a component that is known already, and a group of thousands of
   near copies does not become millions of pairs.

Exact copies share a set and are one member throughout. Defined cases: null, empty and blank texts have the empty set, and link
with nothing; texts under five words have their whole sequence as the one shingle; rows with a null id keep their count
and have a null component; repeated rows and ids link as one; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import WordHash, drop, free_names, keep, load, shingle_hashes, slices, trim, words_of
from .components import components

#: Shingles of a chunk of documents within a task, and postings of one packed range.
CHUNK, RANGE = 1_500_000, 1_000_000
#: Pairs of a group that each forest tries, the last one in each long list; step 4 makes up for all others.
FOREST = (4, 8, 8)
#: Groups of a list up to which all its pairs are listed at once; longer lists go through the forest first.
SHORT = 16
#: Groups of a long list that one task compares with as many others; a longer list is dealt out in pairs of such slices.
SLICE = 2000


def needed(n: int | np.ndarray, percent: int):
    """ceil(percent / 100 * n) in integers."""
    return -(-percent * n // 100)


def shingle_set(text: str | None, hashes: WordHash, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.array(words_of(text)), size))


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def bins_of(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each of 64 bins of hashes; two sets share at most the sum of the lesser counts. None if a count exceeds a byte."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=64)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def common_shingles(docs: DataFrame, most: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most widespread shingles, sorted, and the level floor(log2(count)) of each; at most ``most``, in whole levels. Order only depends on them."""

    def run(batches):
        hashes, parts, known, held = WordHash(), [], set(), 0

        def report():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["shingle", "n"])

        for text in (text for batch in slices(batches) for text in batch.column(0).to_pylist()):
            s = shingle_set(text, hashes, size)
            mark = signature(s)
            if mark in known:
                continue
            known.add(mark)
            parts.append(s)
            held += len(s)
            if held >= CHUNK:
                yield report()
                parts, known, held = [], set(), 0
                trim()
        if parts:
            yield report()

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = keep(counted.select("shingle", F.floor(F.log2("n")).cast("int").alias("level")), "near-common")
    lowest, held = 64, 0
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):
        held += n
        if held > most:
            break
        lowest = level
    rows = counted.filter(F.col("level") >= lowest).toArrow()
    shingle = rows.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], rows.column(1).to_numpy().astype(np.int8)[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int, size: int) -> DataFrame:
    """doc_id, n, sig, grp, prefix (hashes in the global order), bins; the last four are null for empty sets."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        hashes, (last, levels) = WordHash(), shared.value
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, hashes, size)
                n = len(s)
                if not n:
                    out.append((doc_id, 0, None, None, None, None))
                    continue
                want = n - needed(n, percent) + 1
                if len(last):
                    at = np.searchsorted(last, s)
                    at = np.minimum(at, len(last) - 1)
                    prefix = s[np.argsort(np.where(last[at] == s, levels[at], 0), kind="stable")[:want]]
                else:
                    prefix = s[:want]
                data = prefix.tobytes()
                grp = xxhash.xxh3_64_intdigest(data + n.to_bytes(8, "little"))
                out.append((doc_id, n, signature(s), np.uint64(grp).astype(np.int64).item(), data, bins_of(s)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "sig", "grp", "prefix", "bins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, grp long, prefix binary, bins binary")


def postings(info: DataFrame, ranges: int) -> DataFrame:
    """part, data: packed (shingle, grp, n, position) of each range of shingles, once for each group of a chunk."""

    def run(batches):
        known, parts, held = set(), [], 0

        def report():
            shingle = np.concatenate([p[0] for p in parts])
            sizes = np.array([len(p[0]) for p in parts])
            grp = np.repeat(np.array([p[1] for p in parts], np.int64), sizes)
            n = np.repeat(np.array([p[2] for p in parts], np.int32), sizes)
            position = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            # ranges of the upper 32 bits, so that a part is a range of shingles
            part = ((shingle >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges + 1))
            rows = []
            for k in range(ranges):
                i = order[cuts[k] : cuts[k + 1]]
                if len(i):
                    rows.append((k, pa.compress(b"".join(a[i].tobytes() for a in (shingle, grp, n, position)), "zstd", asbytes=True), len(i)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.int64()], strict=True)], ["part", "data", "rows"])

        for batch in batches:
            for grp, n, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp in known:
                    continue
                known.add(grp)
                parts.append((np.frombuffer(prefix, np.uint64), grp, n))
                held += len(prefix) // 8
                if held >= CHUNK:
                    yield report()
                    known, parts, held = set(), [], 0
                    trim()
        if parts:
            yield report()

    return info.filter("doc_id IS NOT NULL AND n > 0").select("grp", "n", "prefix").mapInArrow(run, "part long, data binary, rows long")


def unpack(data: bytes, rows: int) -> list[np.ndarray]:
    raw = pa.decompress(data, rows * 24, "zstd", asbytes=True)
    out, at = [], 0
    for kind in (np.uint64, np.int64, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, rows, at))
        at += rows * out[-1].itemsize
    return out


def shared_lists(packed: DataFrame, percent: int) -> DataFrame:
    """Shingles that the prefixes of two groups hold: for up to SHORT groups all pairs grp, grp2 of sizes that may link, each
    once a part with its number of lists as n (shingle is null); else the list's rows shingle, grp, n, position (grp2 is null)."""

    def run(key, table):
        columns = [np.concatenate(c) for c in zip(*(unpack(d, r) for d, r in zip(table.column("data").to_pylist(), table.column("rows").to_pylist(), strict=True)), strict=True)]
        # most shingles stand alone: find the others before sorting
        order = np.argsort(columns[0], kind="stable")
        s = columns[0][order]
        again = np.r_[False, s[1:] == s[:-1]]
        many = order[again | np.r_[again[1:], False]]
        shingle, grp, n, position = (c[many] for c in columns)
        order = np.lexsort((grp, n, shingle))
        shingle, grp, n, position = (c[order] for c in (shingle, grp, n, position))
        fresh = np.r_[True, (shingle[1:] != shingle[:-1]) | (grp[1:] != grp[:-1])] if len(shingle) else np.empty(0, bool)
        shingle, grp, n, position = (c[fresh] for c in (shingle, grp, n, position))
        _, index, counts = np.unique(shingle, return_inverse=True, return_counts=True)
        length = counts[index]
        pairs, seen = np.empty((0, 2), np.int64), np.empty(0, np.int64)
        for step in range(1, min(SHORT, len(shingle))):
            i = np.flatnonzero((length[step:] <= SHORT) & (shingle[step:] == shingle[: len(shingle) - step]))
            i = i[100 * n[i].astype(np.int64) >= percent * n[i + step].astype(np.int64)]
            ends = np.stack([np.minimum(grp[i], grp[i + step]), np.maximum(grp[i], grp[i + step])], 1)
            pairs, seen = tally(np.concatenate([pairs, ends]), np.concatenate([seen, np.ones(len(ends), np.int64)]))
        long = length > SHORT
        gap, k = np.zeros(len(pairs), np.int64), int(long.sum())
        blank = lambda values, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(values.astype(np.int64)), pa.nulls(after, pa.int64())])
        trim()
        return pa.table(
            [blank(shingle[long].view(np.int64), 0, len(pairs)), pa.array(np.concatenate([grp[long], pairs[:, 0]])), pa.array(np.concatenate([n[long].astype(np.int64), seen])), pa.array(np.concatenate([position[long].astype(np.int64), gap])), blank(pairs[:, 1], k, 0)],
            ["shingle", "grp", "n", "position", "grp2"],
        )

    return packed.groupBy("part").applyInArrow(run, "shingle long, grp long, n long, position long, grp2 long")


def likely(na, pa_, nb, pb, percent: int):
    """Size and position filters for two groups whose first shared shingle stands at positions pa_ and pb of their prefixes."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    overlap = -(-percent * (na + nb) // (100 + percent))
    return (100 * low >= percent * high) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= overlap)


def tally(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of pairs and the sum of their times."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, times = pairs[order], times[order]
    starts = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]) if len(pairs) else np.empty(0, np.int64)
    return pairs[starts], np.add.reduceat(times, starts) if len(starts) else times


def enough(percent: int, seen: str = "seen"):
    """Whether two prefixes share as many shingles as sets of sizes n and n2 need to link.

    Let A be the set whose prefix ends first in the global order. What A shares with B within A's prefix lies in B's prefix too, and
    at most n - overlap of A's shingles are not shared; so the prefixes share at least overlap - ceil(percent / 100 * n) + 1.
    """
    ceil = lambda up, down: F.expr(f"({up} + {down} - 1) div {down}")
    return F.col(seen) >= ceil(f"{percent} * (n + n2)", 100 + percent) + 1 - ceil(f"{percent} * greatest(n, n2)", 100)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sig, shingles (packed, sorted) of the wanted doc_id, sig."""

    def run(batches):
        hashes = WordHash()
        for batch in slices(batches):
            sets = [shingle_set(t, hashes, size) for t in batch.column(1).to_pylist()]
            marks = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "wanted_sig", "shingles"])

    texts = docs.select("doc_id", "text").join(wanted.select("doc_id", F.col("sig").alias("wanted_sig")), "doc_id").select("wanted_sig", "text")
    return texts.mapInArrow(run, "sig binary, wanted_sig binary, shingles binary").filter("sig = wanted_sig").drop("wanted_sig")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of signatures whose whole sets link."""

    def run(batches):
        for batch in slices(batches):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = []
            for p, q in zip(x, y, strict=True):
                both = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), True))
                good.append(100 * both >= percent * ((len(p) + len(q)) // 8 - both))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in (a, b)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def remaining(lists: DataFrame, of_group: DataFrame, percent: int, parts: int, most: int | None = None) -> DataFrame:
    """grp, component, grp2, component2: groups in one long list that are not connected yet, are in long lists often enough to link
    by these alone, and pass the filters of sizes and positions there (two groups whose first shared shingle has a short list
    are among its pairs). Where a group has one member of a component, its bins bound the overlap as well.
    With ``most``, a list gives but so many pairs a group outside its largest component, those with most room for a link: a forest.
    """
    rows = lists.join(of_group, "grp")
    open_ = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("listed")).filter("low <> high").select("shingle", "listed")
    rows = rows.join(open_, "shingle").withColumn("slices", F.expr(f"(listed + {SLICE} - 1) div {SLICE}"))
    # slices in the order of sizes; each row goes to all pairs of slices with its own, which are far fewer than the rows
    by_size = F.row_number().over(Window.partitionBy("shingle").orderBy("n", "grp", "component"))
    rows = rows.withColumn("slice", F.floor((by_size - 1) / SLICE).cast("long"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    rows = rows.withColumn("low", F.least("slice", "with")).withColumn("high", F.greatest("slice", "with")).drop("with", "slices", "listed")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("shingle", "low", "high"), F.lit(parts)))
    names = ["grp", "component", "grp2", "component2"]

    def run(key, table):
        shingle, grp, n, position, long, slice_, low, high = (table.column(c).to_numpy() for c in ("shingle", "grp", "n", "position", "long", "slice", "low", "high"))
        labels = table.column("component").to_pylist()
        names_of = {c: k for k, c in enumerate(sorted(set(labels)))}
        component = np.array([names_of[c] for c in labels], np.int64)
        back = sorted(names_of)
        counts = table.column("bins").to_pylist()
        known = np.array([c is not None for c in counts], bool)
        counts = np.frombuffer(b"".join(c or bytes(64) for c in counts), np.uint8).reshape(-1, 64)
        order = np.lexsort((n, slice_, high, low, shingle))
        cuts = np.flatnonzero(np.r_[True, (np.diff(shingle[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0), True])
        # one number for each group and component of the part
        owner, index = np.unique(np.stack([grp, component], 1), axis=0, return_inverse=True)
        index = index.reshape(-1)
        pairs, new, held = np.empty((0, 2), np.int64), [], 0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i, ends, room = order[lo:hi], [], []
            # a slice with itself, or each of one slice with all of a later one, whose sizes are no smaller
            own = int((slice_[i] == low[i]).sum())
            alone = low[i[0]] == high[i[0]]
            for k in range(own):
                rest = i[k + 1 :] if alone else i[own:]
                rest = rest[: np.searchsorted(n[rest], 100 * n[i[k]] // percent, "right")]
                good = rest[(component[rest] != component[i[k]]) & (grp[rest] != grp[i[k]]) & likely(n[i[k]], position[i[k]], n[rest], position[rest], percent)]
                good = good[np.minimum(long[good], long[i[k]]) >= -(-percent * (n[good] + n[i[k]]) // (100 + percent)) + 1 - needed(np.maximum(n[good], n[i[k]]), percent)]
                slack = np.zeros(len(good))
                if known[i[k]] and len(good):
                    bound = np.minimum(counts[good], counts[i[k]]).sum(1, dtype=np.int64)
                    slack = np.where(known[good], (100 + percent) * bound / (n[good] + n[i[k]]) - percent, 0.0)
                    good, slack = good[slack >= 0], slack[slack >= 0]
                ends.append(np.stack([good, np.full(len(good), i[k])], 1))
                room.append(slack)
            chosen = np.concatenate(ends) if ends else np.empty((0, 2), np.int64)
            if most is not None and len(chosen):
                often = np.bincount(component[i])
                outer = np.where(often[component[chosen[:, 0]]] <= often[component[chosen[:, 1]]], chosen[:, 0], chosen[:, 1])
                by = np.lexsort((-np.concatenate(room), outer))
                begin = np.flatnonzero(np.r_[True, np.diff(outer[by]) != 0])
                rank = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
                chosen = chosen[by[rank < most]]
            new.append(np.sort(index[chosen], 1))
            held += len(chosen)
            if held > CHUNK or hi == len(order):
                both = np.concatenate([pairs, *new])
                pairs = tally(both, np.ones(len(both), np.int64))[0]
                new, held = [], 0
        trim()
        first, second = owner[pairs[:, 0]], owner[pairs[:, 1]]
        label = lambda ends: pa.array([back[c] for c in ends[:, 1].tolist()], pa.binary())
        return pa.table([pa.array(first[:, 0]), label(first), pa.array(second[:, 0]), label(second)], names)

    return rows.groupBy("part").applyInArrow(run, "grp long, component binary, grp2 long, component2 binary")


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bins, where both are known, admit a link, and by how much (slack); n and n2 are the sizes."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy() + batch.column("n2").to_numpy()
            x, y = (batch.column(c).to_pylist() for c in ("bins", "bins2"))
            known = np.array([p is not None and q is not None for p, q in zip(x, y, strict=True)], bool)
            counts = [np.frombuffer(b"".join(c or bytes(64) for c in z), np.uint8).reshape(-1, 64) for z in (x, y)]
            slack = np.where(known, (100 + percent) * np.minimum(*counts).sum(1, dtype=np.int64) / n - percent, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slack)], [*batch.schema.names, "slack"]).filter(pa.array(slack >= 0))

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("slack", T.DoubleType())]))


def forest(lists: DataFrame, near: DataFrame | None, firsts: DataFrame, percent: int, turn: int) -> DataFrame:
    """a, b: first members of groups that are not connected yet: a few of the pairs of short lists, and groups that stand side by
    side in an order common to all long lists (by size), so that one pair comes from many lists but once; later, groups
    of a long list beside a member of its largest component, another one in each list. Of a group's pairs those are tried whose
    bins leave most room for a link."""
    names = ["grp", "n", "position"] + (["component"] if turn else [])
    if turn:
        rows = lists.join(firsts.select("grp", "component", "size"), "grp")
        # beside the member of the list's largest component that comes before in an order of each list and turn, or else its first
        whole = Window.partitionBy("shingle")
        order = whole.orderBy(F.xxhash64("grp", "shingle", F.lit(turn)), "grp")
        rows = rows.withColumn("main", F.max(F.struct("size", "component")).over(whole)["component"])
        inside = F.when(F.col("component") == F.col("main"), F.struct(*names))
        previous = F.last(inside, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        start = F.first(inside, True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        beside = rows.withColumn("other", F.coalesce(previous, start)).filter("component <> main").select(*names, *[F.col(f"other.{c}").alias(f"{c}2") for c in names])
    else:
        order = Window.partitionBy("shingle").orderBy("n", "grp")
        beside = lists.select(*names, *[F.lead(c).over(order).alias(f"{c}2") for c in names]).filter("grp2 IS NOT NULL")
    beside = beside.filter(f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND 1 + least(n - position - 1, n2 - position2 - 1) >= {percent} * (n + n2) / {100 + percent} - 1e-9")
    pairs = beside.select("grp", "grp2")
    if near is not None:
        pairs = pairs.withColumn("seen", F.lit(None).cast("long")).unionByName(near).groupBy("grp", "grp2").agg(F.sum("seen").alias("seen"))
    else:
        pairs = pairs.distinct().withColumn("seen", F.lit(None).cast("long"))
    second = firsts.select(*[F.col(c).alias(f"{c}2") for c in firsts.columns])
    ends = bounded(pairs.join(firsts, "grp").join(second, "grp2").filter("component <> component2").filter(F.col("seen").isNull() | enough(percent)).select("grp", "grp2", "sig", "sig2", "n", "n2", "bins", "bins2"), percent)
    few = Window.partitionBy("grp").orderBy(F.desc("slack"), F.xxhash64("grp", "grp2"), "grp2")
    return ends.select("grp", "grp2", "sig", "sig2", "slack").withColumn("k", F.row_number().over(few)).filter(F.col("k") <= FOREST[turn]).select(F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b"))


def link(docs: DataFrame, percent: int = 75, size: int = 5, common: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    whole = keep(prefixes(docs, common_shingles(docs, common, size), percent, size), "near-prefixes")
    usable = whole.filter("doc_id IS NOT NULL AND n > 0")
    members = usable.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("bins").alias("bins"))
    members = keep(members, "near-members")
    total = usable.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = max(1, int(total // RANGE) + 1)
    shared = keep(shared_lists(postings(whole, parts), percent), "near-lists")
    info = keep(whole.select("doc_id", "n", "sig"), "near-info")
    for path in {f.rsplit("/", 1)[0] for f in whole.inputFiles()}:
        drop(spark, path)
    lists = shared.filter("shingle IS NOT NULL").select("shingle", "grp", "n", "position")
    near = shared.filter("grp2 IS NOT NULL").groupBy("grp", "grp2").agg(F.sum("n").alias("seen"))
    near = keep(near, "near-shared")
    group = members.groupBy("grp").agg(F.min("sig").alias("first"), F.count("*").alias("members"))
    group = keep(group, "near-groups")
    within = members.join(group.filter("members > 1"), "grp").filter("sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    place = members.select("sig", "doc_id")

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among pairs, from the whole sets of just their ends."""
        pairs = keep(pairs, "near-pairs")
        ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        sets = keep(whole_sets(docs, place.join(ends, "sig"), size), "near-sets")
        found = keep(verified(pairs, sets, percent).distinct(), "near-links")
        for path in {f.rsplit("/", 1)[0] for f in sets.inputFiles()}:
            drop(spark, path)
        return found

    # the shingles two groups share have short lists, which are counted, or long ones, at most as many as the groups have
    often = lists.groupBy("grp").agg(F.count("*").alias("long"))

    def opened(label: DataFrame) -> DataFrame:
        """grp, component, n, bins (of a sole member), long: the groups' members by component."""
        rows = label.groupBy("grp", "component").agg(F.count("*").alias("k"), F.min("sig").alias("sig"), F.min("n").alias("n"), F.min("bins").alias("bins"))
        return rows.withColumn("bins", F.when(F.col("k") == 1, F.col("bins"))).drop("k").join(often, "grp", "left").fillna(0, ["long"])

    links, label = None, members.select("sig", "grp", "n", "bins", F.col("sig").alias("component"))
    for turn in range(len(FOREST)):
        sizes = label.groupBy("component").agg(F.count("*").alias("size"))
        firsts = group.select("grp", F.col("first").alias("sig")).join(label.select("sig", "n", "component", "bins"), "sig").join(sizes, "component")
        if turn < len(FOREST) - 1:
            pairs = forest(lists, None if turn else near, firsts, percent, turn)
        else:
            now = keep(opened(label), "near-open")
            end = lambda k, s: now.select(F.col("grp").alias(f"grp{k}"), F.col("component").alias(f"component{k}"), F.col("sig").alias(s))
            pairs = remaining(lists, now.drop("n", "sig"), percent, 16 * parts, FOREST[turn])
            pairs = pairs.join(end("", "a"), ["grp", "component"]).join(end("2", "b"), ["grp2", "component2"]).select("a", "b").distinct()
        found = checked(pairs if turn else pairs.unionByName(within))
        links = links.unionByName(found) if links else found
        known = components(links)
        label = members.select("sig", "grp", "n", "bins").join(known.withColumnRenamed("vertex", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        label = keep(label.select("sig", "grp", "n", "bins", "component"), "near-labels")
    of_group = keep(opened(label), "near-open")
    first, second = (of_group.select(*[F.col(c).alias(c + k) for c in of_group.columns]) for k in ("", "2"))
    ends = ["grp", "component", "grp2", "component2"]
    flip = F.col("grp") > F.col("grp2")
    in_long = remaining(lists, of_group.drop("n", "sig"), percent, 16 * parts)
    in_long = in_long.select(*[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(ends, ends[2:] + ends[:2], strict=True)])
    in_short = near.join(first, "grp").join(second, "grp2").filter("component <> component2").withColumn("seen", F.col("seen") + F.least("long", "long2"))
    in_short = in_short.filter(enough(percent)).select(*ends)
    open_groups = in_long.unionByName(in_short).distinct().join(first, ["grp", "component"]).join(second, ["grp2", "component2"])
    open_groups = bounded(open_groups.select(*ends, "n", "n2", "bins", "bins2"), percent).select(*[F.col(x).alias(y) for x, y in zip(ends, ("ga", "ca", "gb", "cb"), strict=True)])
    side = lambda g, c, s: label.select(F.col("grp").alias(g), F.col("component").alias(c), F.col("sig").alias(s))
    more = open_groups.join(side("ga", "ca", "a"), ["ga", "ca"]).join(side("gb", "cb", "b"), ["gb", "cb"]).select("a", "b")
    # members of one group that are not connected share its whole prefix
    split = label.join(label.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("grp"), "grp")
    inside = split.select("grp", F.col("sig").alias("a"), F.col("component").alias("ca")).join(split.select("grp", F.col("sig").alias("b"), F.col("component").alias("cb")), "grp").filter("ca < cb").select("a", "b")
    late = checked(more.unionByName(inside).distinct())
    final = components(links.unionByName(late))
    placed = members.select("sig", "doc_id").join(final.withColumnRenamed("vertex", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_sig = placed.join(smallest, "component").select("sig", "component_id")
    out = info.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(of_sig, "sig", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return link(load(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component.

    Rows that share an id are one document, of which the first row by all columns stays (maps in their JSON form);
    rows with a null id are all kept, and so are empty texts, which link with nothing.
    """
    kept = link(docs).filter("doc_id = component_id").select("doc_id").distinct()
    sortable = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != "doc_id"]
    (place,) = free_names(docs.columns, "near_row")
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*sortable))).filter(F.col(place) == 1)
    return chosen.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
