"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one class and take one node. Classes are dealt over shards by a
hash; shards and their size both grow with the square root of the table, until a
shard holds as much as a task should (`SHARD_BYTES`). In each shard a graph grows in batches: a greedy beam
search from the medoid proposes a node's neighbours among the nodes it expands;
relaxed pruning (`ALPHA`) walks them from near to far and drops those that a kept
one is much nearer to, so that the kept edges point different ways; edges are added
backwards too and pruned where they grow too many. A query's beam search runs in
every shard; the best of all shards' finds, scored in double precision on the
original vectors, are its neighbours.

Queries are packed in blocks. A task loads a shard's graph once and takes blocks one
after another, up to `TASK_QUERIES` queries; a shard with more has more tasks. Every
query meets every shard, so that work grows with queries times shards: linear in the
table times its square root while shards grow, with its square beyond. Of a class the `k` + 1 smallest ids are kept: no more can be among
the k nearest of a query that may itself be one of them, as ties go to smaller ids.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part, nor do rows without id; vectors are compared with those of
their own length only; rows that repeat an id with one vector count once; an id with
several vectors is as near as the nearest of them, as a query as well as a candidate;
ties go to smaller ids; a query with fewer than k candidates gets them all; columns
other than key and vector play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrail.llm import common

K = 5
QUERY_EVERY = 50
#: A table of n distinct vectors has about sqrt(n / SHARD_BASE) shards.
SHARD_BASE = 3_000
SHARD_BYTES = 128 << 20
TASK_QUERIES = 1 << 18
DEGREE = 28
SLACK = 12
BEAM_BUILD = 64
BEAM_SEARCH = 128
ALPHA = 1.2
BATCH = 64
#: Nodes that a search expands at once.
WIDE = 4
QUERY_BLOCK = 1024
SEED = 4_409
#: Classes that a task holds before it passes them on; the next step joins them again.
HELD = 50_000


def unit(x: np.ndarray) -> np.ndarray:
    """Directions in single precision, for the graph only; scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    q, r = query / np.abs(query).max(), rows / np.abs(rows).max(axis=1, keepdims=True)
    return (r * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((r * r).sum(axis=1)))


class Graph:
    """Neighbour lists (padded with -1) over unit vectors, and where searches start."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray, start: int):
        self.x, self.neighbours, self.start = x, neighbours, start

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam searches of many queries at once: found nodes and similarities, best first, and the nodes expanded (padded with -1).

        In each round a query expands the `WIDE` best nodes of its beam that it hasn't expanded yet.
        """
        n, b, width = len(self.x), len(queries), self.neighbours.shape[1]
        beam = min(beam, n)
        ids = np.full((b, beam), -1, dtype=np.int64)
        sims = np.full((b, beam), -np.inf, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        seen = np.zeros((b, n + 1), dtype=bool)  # the last column takes the padding
        seen[:, n] = True
        place = np.zeros((b, n + 1), dtype=np.uint16)
        at = np.arange(WIDE * width, dtype=np.uint16)[None]
        ids[:, 0], sims[:, 0], done[:, 0] = self.start, queries @ self.x[self.start], False
        seen[:, self.start] = True
        expanded = []
        live = np.arange(b)
        while len(live):
            rows = live[:, None]
            first = np.argsort(done[live], axis=1, kind="stable")[:, :WIDE]
            node = np.where(done[rows, first], -1, ids[rows, first])
            done[rows, first] = True
            step = np.full((b, first.shape[1]), -1, dtype=np.int64)
            step[live] = node
            expanded.append(step)
            near = np.where(node[:, :, None] >= 0, self.neighbours[node], -1).reshape(len(live), -1)
            new = ~seen[rows, near]
            # Of a node that several expanded ones lead to one mention counts: the one that wrote its place last.
            place[rows, near] = at[:, : near.shape[1]]
            new &= place[rows, near] == at[:, : near.shape[1]]
            seen[rows, near] = True
            found = np.full(near.shape, -np.inf, dtype=np.float32)
            row, column = np.nonzero(new)
            found[row, column] = np.einsum("rd,rd->r", self.x[near[row, column]], queries[live[row]])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], found], axis=1)
            all_done = np.concatenate([done[live], ~new], axis=1)
            local = np.arange(len(live))[:, None]
            top = np.argpartition(all_sims, all_sims.shape[1] - beam, axis=1)[:, -beam:]
            top = top[local, np.argsort(-all_sims[local, top], axis=1, kind="stable")]
            sims[live], done[live] = all_sims[local, top], all_done[local, top]
            ids[live] = np.where(sims[live] > -np.inf, all_ids[local, top], -1)
            done[live] |= sims[live] == -np.inf
            live = live[~done[live].all(axis=1)]
        return ids, sims, np.concatenate(expanded, axis=1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to `degree` of its candidates (rows padded with -1), near to far, without those much nearer to a kept one."""
    b, c = candidates.shape
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    order = np.argsort(candidates, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    points = x[candidates]
    far = np.where(candidates >= 0, 2 - 2 * np.einsum("bcd,bd->bc", points, x[nodes]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(far, order, axis=1)
    points = np.take_along_axis(points, order[:, :, None], axis=1)
    between = 2 - 2 * (points @ points.transpose(0, 2, 1))
    alive = candidates >= 0
    kept = np.full((b, degree), -1, dtype=np.int64)
    rows = np.arange(b)
    for k in range(degree):
        if not alive.any():
            break
        pick = np.argmax(alive, axis=1)
        have = alive[rows, pick]
        kept[have, k] = candidates[rows[have], pick[have]]
        alive &= ~((alpha * alpha * between[rows, pick] <= far) & have[:, None])
        alive[rows, pick] = False
    return kept


def build(x: np.ndarray, seed: int = SEED) -> Graph:
    """The graph over the unit vectors x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    width = DEGREE + SLACK
    neighbours = np.full((n, width), -1, dtype=np.int64)
    if n > 1:
        neighbours[:, : min(8, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(8, n - 1)))) % n
    graph = Graph(x, neighbours, int(np.argmax(x @ x.mean(axis=0))))
    if n <= 2:
        return graph
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        nodes = order[at : at + BATCH]
        _, _, expanded = graph.search(x[nodes], BEAM_BUILD)
        kept = robust_prune(x, nodes, np.concatenate([expanded, neighbours[nodes]], axis=1), DEGREE, ALPHA)
        neighbours[nodes] = -1
        neighbours[nodes, :DEGREE] = kept
        _add_back(x, neighbours, nodes, kept, ALPHA)
    return graph


def _add_back(x: np.ndarray, neighbours: np.ndarray, nodes: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    """Add edges back from kept neighbours to nodes, pruning the lists that overflow."""
    width = neighbours.shape[1]
    source = np.repeat(nodes, kept.shape[1])[kept.ravel() >= 0]
    target = kept.ravel()[kept.ravel() >= 0]
    fresh = ~(neighbours[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, first, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, counts)
    free = (neighbours[heads] < 0).sum(axis=1)
    fits = counts <= free
    fit_rows = np.repeat(fits, counts)
    if fit_rows.any():
        used = width - np.repeat(free, counts)
        # Lists are filled from the left.
        neighbours[target[fit_rows], (used + place)[fit_rows]] = source[fit_rows]
    over = heads[~fits]
    for at in range(0, len(over), BATCH):
        part = over[at : at + BATCH]
        inside = np.isin(target, part)
        row = np.searchsorted(part, target[inside])
        more = np.full((len(part), int(counts[np.isin(heads, part)].max())), -1, dtype=np.int64)
        more[row, place[inside]] = source[inside]
        pruned = robust_prune(x, part, np.concatenate([neighbours[part], more], axis=1), DEGREE, alpha)
        neighbours[part] = -1
        neighbours[part, :DEGREE] = pruned


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(value, lambda v: v != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & fine)


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (packed doubles) with their k + 1 smallest ids; a vector of many rows is cut down before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.binary()), pa.array([[-i for i in ids] for _, ids in rows], pa.list_(pa.int64()))], names=["vec", "ids"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            for id_, part in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True) if batch.num_rows else ():
                ids = held.setdefault(part.tobytes(), [])
                if -id_ in ids:
                    continue
                if len(ids) <= k:
                    heapq.heappush(ids, -id_)
                else:
                    heapq.heappushpop(ids, -id_)
            if len(held) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    cut = vectors.mapInArrow(common.lean(run), "vec binary, ids array<long>")
    return cut.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (size,) = struct.unpack_from("<q", blob, at)
        out.append(np.frombuffer(blob, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at + 8))
        at += 8 + size
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
    for key, group in itertools.groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, group


def shards_of(nodes: int, vector_bytes: int, shard_nodes: int | None = None) -> int:
    """How many shards a table of so many distinct vectors has."""
    # A node's doubles, its unit vector in single precision, its edges twice and its ids.
    most = max(1, SHARD_BYTES // (vector_bytes * 3 // 2 + 12 * (DEGREE + SLACK) + 8 * (K + 2)))
    return max(1, -(-nodes // shard_nodes) if shard_nodes else max(round((nodes / SHARD_BASE) ** 0.5), -(-nodes // most)))


def index(found: DataFrame, shard_nodes: int | None = None) -> DataFrame:
    """One row per shard: its graph, vectors and ids, packed. `found` is a settled table of classes."""
    counts = {r["dim"]: shards_of(r["n"], r["dim"], shard_nodes) for r in found.groupBy(F.octet_length("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return found.sparkSession.createDataFrame([], "dim int, shard int, graph binary")
    shards = F.element_at(F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(n))]), F.col("dim"))
    dealt = found.withColumn("dim", F.octet_length("vec")).withColumn("shard", F.pmod(F.xxhash64("vec"), shards).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), group in _groups(batches, ("dim", "shard")):
            rows = [(r["vec"], r["ids"]) for r in group]
            x = np.frombuffer(b"".join(v for v, _ in rows), dtype="<f8").reshape(len(rows), -1)
            graph = build(unit(x))
            sizes = np.array([len(i) for _, i in rows], dtype="<i8")
            ids = np.array([i for _, own in rows for i in own], dtype="<i8")
            blob = _pack(np.array([graph.start], dtype="<i8"), x, graph.neighbours.astype("<i4"), sizes, ids)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["dim", "shard", "graph"])

    return dealt.select("dim", "shard", "vec", "ids").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "vec").mapInArrow(common.lean(run), "dim int, shard int, graph binary")


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries of one length, packed `QUERY_BLOCK` at a time where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(dim: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            blob = _pack(np.array([i for i, _ in rows], dtype="<i8"), np.frombuffer(b"".join(v for _, v in rows), dtype="<f8"))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([blob], pa.binary())], names=["dim", "block"])

        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (np.array(v, dtype="<f8") + 0.0).tobytes()
                rows = held.setdefault(len(raw), [])
                rows.append((id_, raw))
                if len(rows) >= QUERY_BLOCK:
                    yield out(len(raw), held.pop(len(raw)))
        for dim, rows in held.items():
            yield out(dim, rows)

    return queries.mapInArrow(common.lean(run), "dim int, block binary")


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM_SEARCH, task_queries: int = TASK_QUERIES) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score. `graphs` is a settled index, `queries` has id and v."""
    # Vectors come in few lengths; every block goes to each shard of its length, a stated query set against all rows.
    counts = {r["dim"]: r["n"] for r in graphs.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("n")).collect()}
    if not counts:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = queries.groupBy((8 * F.size("v")).alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts = {r["dim"]: -(-r["n"] // task_queries) for r in asked if r["dim"] in counts}
    if not parts:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda numbers: F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("dim"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = F.pmod(F.xxhash64("block"), of(parts)).cast("int").alias("part")
    blocks = _query_blocks(queries).select("dim", part, "block").select("dim", numbers(of(counts)).alias("shard"), "part", F.lit(1).alias("kind"), F.col("block").alias("blob"))
    loaded = graphs.select("dim", "shard", numbers(F.coalesce(of(parts), F.lit(1)).cast("int")).alias("part"), F.lit(0).alias("kind"), F.col("graph").alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, ("dim", "shard", "part")):
            graph = None
            for row in group:
                if row["kind"] == 0:
                    start, x, neighbours, sizes, ids = _unpack(row["blob"], "<i8", "<f8", "<i4", "<i8", "<i8")
                    x = x.reshape(len(sizes), -1)
                    graph = Graph(unit(x), neighbours.reshape(len(sizes), -1).astype(np.int64), int(start[0]))
                    at = np.r_[0, np.cumsum(sizes)]
                    continue
                query_ids, q = _unpack(row["blob"], "<i8", "<f8")
                q = q.reshape(len(query_ids), -1)
                out: list[tuple[int, int, float]] = []
                for a in range(0, len(q), BATCH):
                    nodes, _, _ = graph.search(unit(q[a : a + BATCH]), beam)
                    for i, found in enumerate(nodes):
                        own = int(query_ids[a + i])
                        found = found[found >= 0][: 4 * k]
                        scores = cosine(q[a + i], x[found])
                        named = [(-s, j) for s, c in zip(scores.tolist(), found.tolist(), strict=True) for j in ids[at[c] : at[c + 1]].tolist() if j != own]
                        out += [(own, j, -s) for s, j in heapq.nsmallest(k, named)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    dealt = loaded.unionAll(blocks).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    found = dealt.mapInArrow(common.lean(run), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    found = common.settle(classes(vectors, K), "ann-classes")
    graphs = common.settle(index(found), "ann-graphs")
    common.release(found)
    return search(graphs, vectors.where(F.col("id") % QUERY_EVERY == 0))
