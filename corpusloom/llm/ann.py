"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Each vector is quantised in subspaces of two dimensions with 16 centres each (4 bits). Codebooks and codes
minimise |r|^2 + (eta - 1) (r . x / |x|)^2 of the residual r, so error parallel to the vector, which moves large
inner products, costs eta times as much; eta = (d - 1) t^2 / (1 - t^2) for the threshold t (least 1). The codebooks are
fitted in one task, on the ``sample`` vectors with the smallest hashes of their ids; every vector is coded and searched.

Candidates lie in blocks of about ``block`` rows by a hash of their id, queries in blocks of ``query_bytes``, many times
as many rows of them as a task needs, so that a candidate block is sent to few query blocks. Each pair
of blocks is a row: a task looks up the query's inner products with the centres, adds them up over the codes,
and reranks the ``shortlist`` best of the block in double precision. Equal vectors of a block are scanned once and stand for
their 21 smallest ids, which is exact: no more can be among 20 nearest. The blocks' best 20 meet per query.

Defined cases: vectors that are null, zero, of another length than most (the longer one of a tie) or hold null or
non-finite components take no part; a query's own row is every row of its id; rows that repeat an id and a vector count
once; a null vec_id takes no part; fewer candidates than 20 are all returned; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import load

CENTRES = 16


def valid(table: DataFrame) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def padded(x: np.ndarray) -> np.ndarray:
    """With a zero dimension more where their number is odd."""
    return x if x.shape[1] % 2 == 0 else np.hstack([x, np.zeros((len(x), 1))])


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 3) -> np.ndarray:
    """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
    m = books.shape[0]
    parts = x.reshape(len(x), m, 2)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    codes = np.empty((len(x), m), np.int64)
    residual_along = np.empty((len(x), m))
    for j in range(m):
        r = parts[:, j, None, :] - books[j][None]
        codes[:, j] = (r * r).sum(2).argmin(1)
        residual_along[:, j] = (r[np.arange(len(x)), codes[:, j]] * unit[:, j]).sum(1)
    total = residual_along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            r = parts[:, j, None, :] - books[j][None]
            along = (r * unit[:, j, None, :]).sum(2)
            rest = total - residual_along[:, j]
            best = ((r * r).sum(2) + (eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
            codes[:, j] = best
            residual_along[:, j] = along[np.arange(len(x)), best]
            total = rest + residual_along[:, j]
    return codes


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Codebooks (subspaces, 16, 2) and eta."""
    x = padded(x)
    n, d = x.shape
    m = d // 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    dice = np.random.default_rng(seed)
    books = np.stack([x[dice.integers(0, n, CENTRES), 2 * j : 2 * j + 2] for j in range(m)]) if n else np.zeros((m, CENTRES, 2))
    books += dice.normal(0, 1e-6, books.shape)
    parts = x.reshape(n, m, 2)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    for _ in range(rounds if n else 0):
        codes = encode(x, books, eta, 1)
        along = np.stack([((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            # least squares, one subspace at a time: given the others, each centre has a system of two equations of its own
            u, rest = unit[:, j], total - along[:, j]
            sums = lambda values: np.bincount(codes[:, j], weights=values, minlength=CENTRES)  # noqa: B023, E731
            goal = parts[:, j] + (eta - 1) * u * (rest + (u * parts[:, j]).sum(1))[:, None]
            left = np.array([[sums((r == c) + (eta - 1) * u[:, r] * u[:, c]) for c in range(2)] for r in range(2)]).transpose(2, 0, 1)
            right = np.stack([sums(goal[:, 0]), sums(goal[:, 1])], 1)
            ridge = 1e-6 * max(1, n)
            books[j] = np.linalg.solve(left + ridge * np.eye(2), (right + ridge * books[j])[:, :, None])[:, :, 0]
            along[:, j] = ((parts[:, j] - books[j][codes[:, j]]) * u).sum(1)
            total = rest + along[:, j]
    return books, eta


def scan_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per query, 256 sums for each pair of subspaces: two four-bit lookups at once."""
    m = books.shape[0]
    t = np.einsum("qmd,mkd->qmk", q.reshape(len(q), m, 2), books)
    if m % 2:
        t = np.concatenate([t, np.zeros((len(q), 1, CENTRES))], 1)
    return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def two_codes(codes: np.ndarray) -> np.ndarray:
    """Pairs of four-bit codes as bytes, one row for each pair of subspaces."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.int64)])
    return np.ascontiguousarray((codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8).T)


def search_block(ids, v, codes, first, queries, q, books, k, shortlist):
    """For each query of q its k best of a block. ids, grouped by equal vectors: those of vector u from first[u] on."""
    tables = scan_tables(padded(q), books)
    out = []
    for one in range(len(q)):
        near = np.zeros(codes.shape[1], np.float32)
        for table, row in zip(tables[one], codes, strict=True):
            near += table.take(row)
        best = np.argpartition(-near, shortlist)[:shortlist] if len(near) > shortlist else np.arange(len(near))
        exact = (v[best] * q[one]).sum(1)
        order = np.argsort(-exact, kind="stable")[: k + 1]
        cut = exact[order[-1]]
        chosen = best[exact >= cut]  # ties at the cut stay
        scores = exact[exact >= cut]
        sizes = first[chosen + 1] - first[chosen]
        own = np.concatenate([ids[first[u] : first[u + 1]] for u in chosen])
        s = np.repeat(scores, sizes)
        other = own != queries[one]
        own, s = own[other], s[other]
        keep = np.lexsort((own, -s))[:k]
        out.append((np.full(len(keep), queries[one]), own[keep], s[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(table: DataFrame, every: int = 20, k: int = 20, shortlist: int = 200, block: int = 8192, query_bytes: int = 16 << 20, sample: int = 5_000, threshold: float = 0.2) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by every."""
    spark = table.sparkSession
    rows = valid(table)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(sizes, key=lambda r: (r["n"], r["d"]))
    rows = rows.filter(F.size("v") == most["d"])
    n_blocks, n_queries = -(-most["n"] // block), max(1, -(-most["q"] * 8 * most["d"] // query_bytes))

    def values(column) -> np.ndarray:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)

    def fit(batches):
        held = [values(batch.column(0)) for batch in batches if batch.num_rows]
        books, eta = train(np.unique(np.concatenate(held), axis=0), threshold)  # a vector that repeats teaches once
        yield pa.RecordBatch.from_arrays([pa.array([books.tobytes()], pa.binary()), pa.array([eta])], ["books", "eta"])

    learnt = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").repartition(1).mapInArrow(fit, "books binary, eta double").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(learnt["books"]).reshape(-1, CENTRES, 2), learnt["eta"]))

    def pack(key, group):
        ids, v = group.column("vec_id").to_numpy(), values(group.column("v"))
        same, which = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        ids, which = ids[order], which.ravel()[order]
        fresh = np.r_[True, (np.diff(ids) != 0) | (np.diff(which) != 0)]
        ids, which = ids[fresh], which[fresh]
        start = np.searchsorted(which, which)  # of each row's group
        few = np.arange(len(ids)) - start < k + 1
        ids, which = ids[few], which[few]
        first = np.searchsorted(which, np.arange(len(same) + 1)).astype(np.int64)
        own_books, own_eta = shared.value
        codes = two_codes(encode(padded(same), own_books, own_eta))
        return pa.table({"block": [key[0].as_py()], "n": [len(same)], "ids": [ids.astype(np.int64).tobytes()], "first": [first.tobytes()], "v": [same.tobytes()], "codes": [codes.tobytes()]})

    def pack_queries(key, group):
        ids, v = group.column("vec_id").to_numpy(), values(group.column("v"))
        return pa.table({"part": [key[0].as_py()], "queries": [ids.astype(np.int64).tobytes()], "q": [v.tobytes()]})

    def run(batches):
        own_books = shared.value[0]
        d = most["d"]
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)  # noqa: B023, E731
                first = get("first", np.int64)
                ids, v, queries, q = get("ids", np.int64), get("v", np.float64).reshape(-1, d), get("queries", np.int64), get("q", np.float64).reshape(-1, d)
                codes = get("codes", np.uint8).reshape(-1, len(v))
                for at in range(0, len(q), 512):
                    got = search_block(ids, v, codes, first, queries[at : at + 512], q[at : at + 512], own_books, k, shortlist)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    packed = rows.withColumn("block", dealt).groupBy("block").applyInArrow(pack, "block long, n long, ids binary, first binary, v binary, codes binary")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_queries)))
    asked = asked.groupBy("part").applyInArrow(pack_queries, "part long, queries binary, q binary").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    pairs = asked.join(packed, "block").select("ids", "first", "v", "codes", "queries", "q")
    found = pairs.repartition(max(1, min(n_blocks * n_queries, 4096))).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"))
