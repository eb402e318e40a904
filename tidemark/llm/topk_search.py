"""Operator 8: exact top-k by inner product in three phases with a uniform threshold.

The dimensions fall into LISTS groups; each group gives every candidate a partial score, and
the partial scores of a query, in order, are its score lists. Vectors are packed in blocks of small
integers. Blocks of candidates stay where they are; the queries come to them in rounds of
ROUND_BYTES at most, so that what is broadcast is bounded however many queries there are.

1. Each block of candidates gathers, for each query, the heads of its score lists and resolves
   the scores of these entries alone. The k-th best of a query over all blocks is a safe cutoff: no result is lower.
2. The cutoffs of the round are broadcast. A score of at least the cutoff needs a partial score of at
   least cutoff / LISTS in some list. From the least and greatest component of a block in each dimension
   follows how much a query's lists can reach there: a query whose lists can't add up to its cutoff
   skips the block, and a list that can't reach its share is not made. In the others the entries that reach it are collected.
3. The collected entries are resolved exactly, one by one; those at or over the cutoff are merged.

Scores are integers, computed in floating point only where that is exact.

Defined results: vectors that are null or hold a null or non-finite component take no part;
missing components of shorter vectors count as 0; a query is never compared with its own
row, but with other rows of the same id; ties go to the smaller id; repeated rows take a
place each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LISTS = 4
SCALE = 256
#: Rows in a block at most, and components in a block at most.
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 22
#: Queries whose scores a task holds at a time.
SLICE = 256
#: Bytes of queries in a round at most (a block stands alone if it has more).
ROUND_BYTES = 32 << 20

_BLOCK = "ids binary, uids binary, vectors binary, width int"


def quantised(vectors: DataFrame, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """uid, vec_id and v (array of bigint) of the vectors that take part, as a written table."""
    x = F.col(embedding)
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    return cut(vectors.filter(F.col(ident).isNotNull() & fine).select(F.monotonically_increasing_id().alias("uid"), F.col(ident).cast("long").alias("vec_id"), v.alias("v")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, vec_id, v) to blocks."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        lengths, values = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)
        width = int(lengths.max(initial=0))
        rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, width)))
        for lo in range(0, batch.num_rows, rows):
            hi = min(lo + rows, batch.num_rows)
            block = np.zeros((hi - lo, width), dtype=np.int64)
            block[np.arange(width) < lengths[lo:hi, None]] = values[offsets[lo] : offsets[hi]]
            ids, uids = (batch.column(k).to_numpy()[lo:hi].astype("<i8").tobytes() for k in (1, 0))
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(block).max(initial=0) <= np.iinfo(t).max)
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([uids], pa.binary()), pa.array([block.astype(kind).tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["ids", "uids", "vectors", "width"])


def _vectors(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * width)}").reshape(rows, width) if rows * width else np.zeros((rows, 0), dtype="<i8")


class _Pair:
    """A block of queries and a block of candidates; made counts the partial scores that were asked for."""

    def __init__(self, q: tuple[bytes, bytes, bytes, int], c: tuple[bytes, bytes, bytes, int]):
        self.query_ids, self.query_uids, self.ids, self.uids = (np.frombuffer(x, "<i8") for x in (*q[:2], *c[:2]))
        self.n, self.made, width = len(self.query_ids), 0, min(q[3], c[3])
        qv, cv = _vectors(q[2], self.n, q[3])[:, :width], _vectors(c[2], len(self.ids), c[3])[:, :width]
        most = int(np.abs(qv.astype(np.int64)).max(initial=0)) * int(np.abs(cv.astype(np.int64)).max(initial=0)) * max(1, width) * LISTS
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        self.exact = np.int64 if most < 1 << 62 else object
        self.q, self.c, self.dims, self._lists = qv, cv, np.array_split(np.arange(width), LISTS), {}

    def partial(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Partial scores [query, candidate] of list i."""
        if i not in self._lists:
            d = self.dims[i]
            self._lists[i] = self.q[:, d].astype(self.kind), np.ascontiguousarray(self.c[:, d].astype(self.kind).T)
        q, c = self._lists[i]
        self.made += len(rows) * len(self.ids)
        return q[rows] @ c

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The whole scores of some entries."""
        out = np.zeros(len(rows), dtype=np.int64)
        for lo in range(0, len(rows), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            out[part] = (self.q[rows[part]].astype(self.exact) * self.c[at[part]].astype(self.exact)).sum(axis=1)
        return out

    def reach(self) -> np.ndarray:
        """The most that each list of each query can have in this block, as [list, query]."""
        q, c = self.q.astype(self.exact), self.c.astype(self.exact)
        if not len(c):
            return np.zeros((LISTS, self.n), dtype=self.exact)
        high, low = c.max(axis=0), c.min(axis=0)
        return np.stack([np.maximum(q[:, d], 0) @ high[d] + np.minimum(q[:, d], 0) @ low[d] for d in self.dims])

    def own(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.uids)
        at = np.minimum(np.searchsorted(self.uids, self.query_uids[lo:hi], sorter=order), len(order) - 1)
        hit = np.flatnonzero(self.uids[order[at]] == self.query_uids[lo:hi])
        return hit, order[at[hit]]


def _heads(pair: _Pair, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phase 1: (query positions, scores), k for a query at most."""
    for lo in range(0, pair.n, SLICE):
        hi = min(lo + SLICE, pair.n)
        seen = np.zeros((hi - lo, len(pair.ids)), dtype=bool)
        for i in range(LISTS):
            p = pair.partial(i, np.arange(lo, hi))
            top = min(k + 1, p.shape[1])
            head = np.argpartition(p, p.shape[1] - top, axis=1)[:, -top:] if p.dtype != object else np.argsort(p, axis=1)[:, -top:]
            np.put_along_axis(seen, head, True, axis=1)
        seen[pair.own(lo, hi)] = False
        rows, at = np.nonzero(seen)
        yield _best(rows, pair.scores(rows + lo, at), pair.ids[at], pair.uids[at], k, lo)[:2]


def _best(rows, scores, ids, uids, k: int, lo: int):
    """The k first of each row by score, id and uid: (position, score, id, uid)."""
    order = np.lexsort((uids, ids, -scores, rows))
    rows = rows[order]
    first = np.searchsorted(rows, rows, side="left")
    order = order[np.arange(len(rows)) - first < k]
    return rows[np.arange(len(rows)) - first < k] + lo, scores[order], ids[order], uids[order]


def _resolved(pair: _Pair, cutoffs: np.ndarray, k: int):
    """Phases 2 and 3: (query positions, scores, ids, uids)."""
    reach = pair.reach()
    live = reach.sum(axis=0) >= cutoffs
    for lo in range(0, pair.n, SLICE):
        hi = min(lo + SLICE, pair.n)
        if not live[lo:hi].any():
            continue
        enough = np.zeros((hi - lo, len(pair.ids)), dtype=bool)
        for i in range(LISTS):  # integers: compared after multiplying, so exactly
            rows = lo + np.flatnonzero(live[lo:hi] & (reach[i, lo:hi] * LISTS >= cutoffs[lo:hi]))
            if len(rows):
                p = pair.partial(i, rows)
                enough[rows - lo] |= (p.astype(np.float64) if p.dtype != object else p) * LISTS >= cutoffs[rows, None]
        enough[pair.own(lo, hi)] = False
        rows, at = np.nonzero(enough)
        scores = pair.scores(rows + lo, at)
        keep = scores >= cutoffs[lo:hi][rows]
        rows, at = rows[keep], at[keep]
        yield _best(rows, scores[keep], pair.ids[at], pair.uids[at], k, lo)


def rounds(blocks: list[tuple[int, int]], most: int = ROUND_BYTES) -> list[list[int]]:
    """Blocks (number, bytes) in groups of at most so many bytes."""
    out, held = [], 0
    for block, size in blocks:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(block)
        held += size
    return out


def search(table: DataFrame, is_query: Column, k: int = 5, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of a quantised() table for which is_query holds."""
    spark = table.sparkSession
    facts = table.filter(is_query).agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    n_blocks = max(1, -(-facts["n"] * max(1, facts["width"]) // min(BLOCK_VALUES, BLOCK_ROWS * max(1, facts["width"]))))
    queries = cut(table.filter(is_query).select("uid", "vec_id", "v").repartition(n_blocks).mapInArrow(_pack, _BLOCK).withColumn("qb", F.monotonically_increasing_id()))
    blocks = cut(table.select("uid", "vec_id", "v").mapInArrow(_pack, _BLOCK))
    sizes = queries.select("qb", F.octet_length("vectors") + 24 * F.octet_length("ids")).orderBy("qb").collect()  # a row for each block of queries
    found = [_round(queries.filter(F.col("qb").isin(which)), blocks, k) for which in rounds([tuple(r) for r in sizes], round_bytes)]
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, query_uid, score, vec_id, uid: what the blocks of candidates have for the queries of one round."""
    context = queries.sparkSession.sparkContext
    asked = {r["qb"]: (bytes(r["ids"]), bytes(r["uids"]), bytes(r["vectors"]), r["width"]) for r in queries.collect()}  # of a round's bytes
    sent = context.broadcast(asked)

    def candidates(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                c = tuple(batch.column(j)[i].as_py() for j in range(4))
                if len(c[0]):
                    for qb, q in sent.value.items():
                        yield qb, _Pair(q, c)

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qb, pair in candidates(batches):
            for pos, scores in _heads(pair, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), qb)), pa.array(pos.astype(np.int32)), pa.array(scores)], names=["qb", "pos", "score"])

    nth = Window.partitionBy("qb", "pos").orderBy(F.desc("score"))
    heads = blocks.mapInArrow(phase1, "qb bigint, pos int, score bigint").withColumn("n", F.row_number().over(nth))
    least = {qb: np.full(len(q[0]) // 8, -(1 << 62), dtype=np.int64) for qb, q in asked.items()}
    for r in heads.filter(F.col("n") == k).select("qb", "pos", "score").collect():  # a row for each query of the round
        least[r["qb"]][r["pos"]] = r["score"]
    cutoffs = context.broadcast(least)

    def phase23(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qb, pair in candidates(batches):
            for pos, scores, ids, uids in _resolved(pair, cutoffs.value[qb], k):
                columns = [pair.query_ids[pos], pair.query_uids[pos], scores, ids, uids]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "query_uid", "score", "vec_id", "uid"])

    return blocks.mapInArrow(phase23, "query_id bigint, query_uid bigint, score bigint, vec_id bigint, uid bigint")
