"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Vectors are dealt into shards of a bounded size. A shard's graph grows in batches: greedy beam searches over what is
there propose neighbours, the members of a batch propose themselves to each other, and relaxed distance pruning (a
candidate goes if a kept neighbour is ``alpha`` times closer to it than the point is) keeps diverse edges, also for the
edges back. Every query walks the graph of every shard with a beam; scores are then computed again in double precision
on the original vectors and the best of all shards are merged.

Nearness is the largest inner product. For building, vectors get one more component that makes all norms of a shard
equal, so that distance orders as the inner product does. Equal vectors are one node, which holds all their ids.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as do vectors
of another length than the commonest (the longest among equals); ties go to the smaller id; with fewer candidates than
asked for, all are returned; an empty table gives no rows; rows that repeat a query's id are not candidates of it; an id
that repeats is one candidate, with the best of its vectors, and as a query has the smallest of them.

Every query meets every shard, so shards grow with the table: from ``shard_rows`` rows, while there are fewer than
``shards`` of them, to at most ``shard_bytes`` of vectors, which bounds the memory of a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, stored


@dataclass(frozen=True)
class GraphIndex:
    degree: int = 32
    beam: int = 64  # while building
    search_beam: int = 112
    alpha: float = 1.2
    batch: int = 512
    shard_rows: int = 8192
    shards: int = 64
    shard_bytes: int = 128 << 20  # of vectors in double precision
    query_rows: int = 4096  # queries that meet a shard in one task
    expand: int = 4  # nodes of a beam opened at once
    seed: int = 11

    def prune(self, points: np.ndarray, x: np.ndarray, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """At most ``degree`` diverse neighbours of each point x[own] among its candidates (-1: none)."""
        b, c = cand.shape
        order = np.argsort(cand, axis=1, kind="stable")
        ids = np.take_along_axis(cand, order, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == own[:, None]] = -1
        v = x[np.maximum(ids, 0)]
        dist = ((v - points[:, None, :]) ** 2).sum(-1)
        dist[ids < 0] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, : 3 * self.degree]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        square = (v * v).sum(-1)
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        out = np.full((b, self.degree), -1, np.int32)
        rows = np.arange(b)
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[some, k] = ids[rows, pick][some]
            near = self.alpha**2 * np.maximum(between[rows, pick], 0) <= dist
            near[rows, pick] = True
            alive &= ~near
        return out

    def walk(self, queries: np.ndarray, x: np.ndarray, half: np.ndarray, graph: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
        """Nodes of each query's final beam, nearest first (-1: none); nearness: half[i] - q.x[i], half: half the square norm."""
        n, e = len(queries), self.expand
        ids = np.full((n, beam), -1, np.int32)
        key = np.full((n, beam), np.inf, np.float32)
        first = entry[: beam]
        ids[:, : len(first)] = first
        key[:, : len(first)] = half[first] - queries @ x[first].T
        order = np.argsort(key, axis=1, kind="stable")
        ids, key = np.take_along_axis(ids, order, 1), np.take_along_axis(key, order, 1)
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            i, k, o = ids[live], key[live], opened[live]
            rank = np.argsort(o, axis=1, kind="stable")[:, :e]  # the nearest nodes not opened yet
            fresh = ~np.take_along_axis(o, rank, 1)
            at = np.take_along_axis(i, rank, 1)
            np.put_along_axis(o, rank, True, 1)
            more = np.where(fresh[:, :, None], graph[np.maximum(at, 0)], -1).reshape(len(live), -1)
            near = half[np.maximum(more, 0)] - np.matmul(x[np.maximum(more, 0)], queries[live][:, :, None])[:, :, 0]
            near[more < 0] = np.inf
            all_ids, all_keys = np.concatenate((i, more), 1), np.concatenate((k, near), 1)
            all_open = np.concatenate((o, more < 0), 1)
            # a node met again must not count twice: sort by node, what is in the beam first, and strike the others
            order = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, order, 1)
            twice = np.zeros_like(sorted_ids, bool)
            twice[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            struck = np.zeros_like(twice)
            np.put_along_axis(struck, order, twice, 1)
            all_keys[struck] = np.inf
            best = np.argsort(all_keys, axis=1, kind="stable")[:, :beam]
            k = np.take_along_axis(all_keys, best, 1)
            i = np.where(np.isfinite(k), np.take_along_axis(all_ids, best, 1), -1)
            o = np.take_along_axis(all_open, best, 1) | (i < 0)
            ids[live], key[live], opened[live] = i, k, o
            live = live[~o.all(axis=1)]
        return ids

    def entries(self, n: int) -> np.ndarray:
        return np.random.default_rng(self.seed).permutation(n)[:16].astype(np.int32)

    def build(self, vectors: np.ndarray) -> np.ndarray:
        """Neighbours (-1: none) of each of the distinct vectors."""
        n = len(vectors)
        norm = (vectors.astype(np.float64) ** 2).sum(1)
        lift = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))
        x = np.concatenate((vectors, lift[:, None]), 1).astype(np.float32)
        half = (x * x).sum(1) / 2
        graph = np.full((n, self.degree), -1, np.int32)
        order = np.concatenate((self.entries(n), np.setdiff1d(np.random.default_rng(self.seed + 1).permutation(n), self.entries(n), assume_unique=True))).astype(np.int32)
        done = 0
        while done < n:
            own = order[done : done + min(self.batch, max(64, done))]
            p = x[own]
            mates = half[own][None, :] - p @ p.T
            near = own[np.argsort(mates, axis=1, kind="stable")[:, : self.degree + 1]]
            cand = near if not done else np.concatenate((self.walk(p, x, half, graph, self.entries(n)[:done], self.beam), near), 1)
            graph[own] = self.prune(p, x, own, cand)
            done += len(own)
            # edges back: each neighbour takes the new points among its candidates
            to, frm = graph[own].reshape(-1), np.repeat(own, self.degree)
            to, frm = to[to >= 0], frm[to >= 0]
            by = np.argsort(to, kind="stable")
            to, frm = to[by], frm[by]
            target, start, count = np.unique(to, return_index=True, return_counts=True)
            room = self.degree * 2
            for lo in range(0, int(count.max(initial=0)), room):  # a point that many chose takes them in turns
                left = np.clip(count - lo, 0, room)
                some = left > 0
                t, s, c = target[some], start[some] + lo, left[some]
                new = np.full((len(t), int(c.max())), -1, np.int32)
                slot = np.arange(int(c.max()))[None, :]
                inside = slot < c[:, None]
                new[inside] = frm[(s[:, None] + slot)[inside]]
                known = graph[t]
                merged = np.concatenate((known, new), 1)
                free = (known < 0).sum(1) >= c
                if free.any():  # no more than fit: no pruning needed
                    packed = np.sort(merged[free], axis=1)[:, ::-1]
                    packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
                    graph[t[free]] = np.sort(packed, axis=1)[:, ::-1][:, : self.degree]
                full = ~free
                for a in range(0, int(full.sum()), self.batch):
                    tt = t[full][a : a + self.batch]
                    graph[tt] = self.prune(x[tt], x, tt, merged[full][a : a + self.batch])
        return graph

    def shard_count(self, rows: int, width: int) -> int:
        bound = max(self.shard_rows, self.shard_bytes // (8 * width))
        return max(1, min(-(-rows // self.shard_rows), max(self.shards, -(-rows // bound))))

    def fit(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The index of rows (id, v array<double>): (shard, node, ids, v, edges), stored; and the number of shards."""
        index = self
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        shards = self.shard_count(seen["n"], seen["d"] or 1)

        def make(key, table):
            ids, x = table.column("id").to_numpy(), _matrix(table.column("v"))
            _, first, back = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True)
            back = back.reshape(-1)
            nodes = x[first]
            graph = index.build(nodes)
            by = np.lexsort((ids, back))
            by = by[np.concatenate(([True], (ids[by][1:] != ids[by][:-1]) | (back[by][1:] != back[by][:-1])))]  # repeated rows count once
            offsets = np.concatenate(([0], np.cumsum(np.bincount(back[by], minlength=len(first))))).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[by], pa.int64()))
            return pa.table({"shard": pa.array([key[0].as_py()] * len(nodes), pa.int64()), "node": pa.array(np.arange(len(nodes)), pa.int32()), "ids": own, "v": pa.array([r.tobytes() for r in nodes], pa.binary()), "edges": pa.array([r.tobytes() for r in graph], pa.binary())})

        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        return stored(sharded.groupBy("shard").applyInArrow(make, "shard bigint, node int, ids array<bigint>, v binary, edges binary"), "graphs"), shards

    def search(self, fitted: DataFrame, shards: int, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest of each query (id, v)."""
        index = self
        groups = max(1, -(-queries.count() // self.query_rows))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        left = fitted.withColumn("part", spread(groups))
        right = queries.select(F.col("id"), F.col("v"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("part"), spread(shards).alias("shard"))

        def find(graphs, asked):
            out_q, out_v, out_s = [], [], []
            if graphs.num_rows and asked.num_rows:
                graphs = graphs.sort_by("node")
                x = np.stack([np.frombuffer(b, np.float64) for b in graphs.column("v").to_pylist()])
                graph = np.stack([np.frombuffer(b, np.int32) for b in graphs.column("edges").to_pylist()])
                # an id list is sorted; a query needs no more than k of equal vectors besides its own
                members = [m[: k + 1] for m in graphs.column("ids").to_pylist()]
                sizes = np.array([len(m) for m in members])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                flat = np.concatenate([np.array(m, np.int64) for m in members])
                unique = len(np.unique(flat)) == len(flat)
                q, qid = _matrix(asked.column("v")), asked.column("id").to_numpy()
                beam = max(index.search_beam, 2 * k)
                for a in range(0, len(q), index.batch):
                    part, pid = q[a : a + index.batch], qid[a : a + index.batch]
                    nodes = index.walk(part.astype(np.float32), x.astype(np.float32), np.zeros(len(x), np.float32), graph, index.entries(len(x)), beam)
                    if unique:  # else an id may stand at several nodes, and the whole beam is looked through
                        nodes = nodes[:, : 2 * k + 8]
                    row, col = np.nonzero(nodes >= 0)
                    at = nodes[row, col]
                    score = _inner(part, row, x, at)
                    n = sizes[at]
                    row, score = np.repeat(row, n), np.repeat(score, n)
                    ids = flat[np.repeat(starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                    other = ids != pid[row]
                    row, score, ids = row[other], score[other], ids[other]
                    by = np.lexsort((ids, -score, row))
                    row, score, ids = row[by], score[by], ids[by]
                    if not unique:
                        again = np.lexsort((np.arange(len(row)), ids, row))  # best first within each id
                        same = (row[again][1:] == row[again][:-1]) & (ids[again][1:] == ids[again][:-1])
                        once = np.ones(len(row), bool)
                        once[again[1:][same]] = False
                        row, score, ids = row[once], score[once], ids[once]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    top = place < k
                    out_q.append(pid[row[top]]), out_v.append(ids[top]), out_s.append(score[top])
            cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_v, pa.int64()), "score": cat(out_s, pa.float64())})

        found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(find, "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _inner(q: np.ndarray, qi: np.ndarray, x: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed from the first component to the last."""
    out = np.zeros(len(qi))
    for d in range(q.shape[1]):
        out += q[qi, d] * x[xi, d]
    return out


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", index: GraphIndex | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` nearest to each row of ``queries``, without itself."""
    index = index or GraphIndex()
    bounded_batches(table.sparkSession)
    fitted, shards = index.fit(vectors(table, key, vector))
    return index.search(fitted, shards, vectors(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")), k)
