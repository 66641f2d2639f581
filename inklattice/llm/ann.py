"""Approximate nearest neighbours by robust-pruned directed graphs (operator 3).

Rows are dealt to shards by a hash of their id, so copies of one vector spread evenly.  A shard has about ``SHARD_ROWS``
rows, or as many as keep the shards at ``SHARDS``, up to ``MOST_ROWS``: every query visits every shard, so large tables get larger shards first.
Each shard is one graph over its distinct vectors, built in batches: a greedy beam search from spread entry points
proposes neighbours of a new vector; robust pruning keeps the nearest candidate and drops those that are nearer to
a kept one than ``1 / ALPHA`` of their distance to the vector; edges back are added and pruned likewise.  The
index is a written table with one row per shard.  Graphs are built and walked on vectors moved and scaled to their
shard's centre and extent, so that large offsets and large values lose no precision; vectors whose largest components
differ by many orders of magnitude (``BAND``) lie in different shards.  Where a walk reaches fewer than k rows, the shard is scanned.  Queries go to every shard in blocks, are answered by beam search,
rescored by Euclidean distance in double precision, and merged.  No row is left out of the index.

Vectors that are null, all zero, or hold null or non-finite components take no part, as query or candidate; nor do
rows with a null id.  Only vectors of one length are compared.  Repeated rows with one id count once as queries;
a query never finds its own id.  Ties go to the smaller id.  Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inklattice.llm.common import materialize

SHARD_ROWS = 4096
SHARDS, MOST_ROWS = 256, 32_768
#: Orders of magnitude of largest components that one shard holds.
BAND = 6
#: Queries farther from a shard's centre than so many of its extents are moved towards it.
FAR = 1e3
DEGREE = 32
BUILD_BEAM = 48
QUERY_BEAM = 96
ALPHA = 1.2
BATCH = 512
QUERY_BLOCK = 1024
#: Entry points of a shard, far from each other, so that every cluster is reached.
ENTRIES = 64


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), nearest first, of the beams of all queries; ids are -1 where a beam is not full."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(x)), bool)
    seen[:, entries] = True
    start = ((queries**2).sum(axis=1)[:, None] + (x[entries] ** 2).sum(axis=1)[None] - 2 * queries @ x[entries].T).astype(np.float32)
    first = np.argsort(start, axis=1, kind="stable")[:, :beam]
    ids[:, : first.shape[1]], dist[:, : first.shape[1]] = entries[first], np.take_along_axis(start, first, axis=1)
    active = np.arange(q)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        active = active[open_.any(axis=1)]
        if not len(active):
            break
        at = (~done[active] & (ids[active] >= 0)).argmax(axis=1)
        done[active, at] = True
        near = graph[ids[active, at]]
        fresh = near >= 0
        safe = np.where(fresh, near, 0)
        fresh &= ~seen[active[:, None], safe]
        row, col = np.nonzero(fresh)
        seen[active[row], near[row, col]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[row, col] = ((x[near[row, col]] - queries[active[row]]) ** 2).sum(axis=1)
        both = np.concatenate([dist[active], d], axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :beam]
        every = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        flags = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        ids[active], dist[active], done[active] = (np.take_along_axis(v, best, axis=1) for v in (every, both, flags))
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-edges (padded with -1) of each point among its candidates (padded with -1)."""
    safe = np.where(cands >= 0, cands, 0)
    own = ((x[safe] - x[points][:, None]) ** 2).sum(axis=2)
    own[(cands < 0) | (cands == points[:, None])] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    cands, own, safe = (np.take_along_axis(v, order, axis=1) for v in (cands, own, safe))
    vectors = x[safe]
    squares = (vectors**2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = np.isfinite(own)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        live = alive.any(axis=1)
        if not live.any():
            break
        at = alive.argmax(axis=1)
        out[live, k] = cands[rows, at][live]
        alive[rows, at] = False
        alive &= ~((alpha * alpha * between[rows, at] <= own) & live[:, None])
    return out


def spread_points(x: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """Farthest-first points, from the one nearest to the mean."""
    out = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((x - x[out[0]]) ** 2).sum(axis=1)
    while len(out) < min(most, len(x)):
        out.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(axis=1))
    return np.array(list(dict.fromkeys(out)))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over distinct vectors."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = spread_points(x)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([entry, order[~np.isin(order, entry)]])
    graph[entry] = robust_prune(x, entry, np.broadcast_to(entry, (len(entry), len(entry))), degree, alpha)
    at, size = len(entry), 32
    while at < n:
        points = order[at : at + size]
        found, _ = beam_search(x, graph, entry, x[points], beam)
        # Points of one batch may be neighbours too.
        among = np.broadcast_to(points, (len(points), len(points))) if len(points) <= 64 else points[np.argsort(((x[points][:, None] - x[points][None]) ** 2).sum(axis=2), axis=1)[:, 1:9]]
        graph[points] = robust_prune(x, points, np.concatenate([found, among], axis=1), degree, alpha)
        _add_back(x, graph, points, degree, alpha)
        at += len(points)
        size = min(batch, 2 * size)
    return graph, entry


def _add_back(x: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(points, degree)
    target = graph[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first = np.unique(target, return_index=True)
    counts = np.diff(np.append(first, len(target)))
    offers = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int64)
    offers[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
    both = np.concatenate([graph[nodes], offers], axis=1)
    room = (both >= 0).sum(axis=1) <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
    known = np.array([len(set(r[r >= 0])) == (r >= 0).sum() for r in packed]) if len(packed) else np.zeros(0, bool)
    graph[nodes[room & known]] = packed[room & known]
    full = np.flatnonzero(~(room & known))
    for k in range(0, len(full), 256):
        part = full[k : k + 256]
        cands = np.sort(both[part], axis=1)
        cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1  # an edge that stands twice
        width = max(1, int((cands >= 0).sum(axis=1).max()))
        cands = np.take_along_axis(cands, np.argsort(cands < 0, axis=1, kind="stable"), axis=1)[:, :width]
        graph[nodes[part]] = robust_prune(x, nodes[part], cands, degree, alpha)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; differences whose squares leave its range are scaled."""
    apart = vectors.astype(np.float64) - query
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((apart**2).sum(axis=1))
    largest = np.abs(apart).max(axis=1, initial=0)
    odd = (largest > 1e150) | ((largest > 0) & (largest < 1e-150))
    if odd.any():
        out[odd] = np.sqrt(((apart[odd] / largest[odd, None]) ** 2).sum(axis=1)) * largest[odd]
    return out


class Frame:
    """Centre and extent of a shard's vectors."""

    def __init__(self, vectors: np.ndarray):
        self.size = float(max(np.abs(vectors.astype(np.float64)).max(initial=0), 1e-300))
        scaled = vectors.astype(np.float64) / self.size
        self.centre = scaled.mean(axis=0) if len(vectors) else scaled.sum(axis=0)
        self.extent = float(max(np.abs(scaled - self.centre).max(initial=0), 1e-300))

    def place(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.clip((vectors.astype(np.float64) / self.size - self.centre) / self.extent, -1e150, 1e150)
        far = np.abs(out).max(axis=1, initial=0)
        return (out * np.where(far > FAR, FAR / np.maximum(far, FAR), 1.0)[:, None]).astype(np.float32)


class Shard:
    """A graph with the ids of the rows at each distinct vector (ascending)."""

    def __init__(self, vectors: np.ndarray, graph: np.ndarray, entry: np.ndarray, ids: np.ndarray, starts: np.ndarray):
        self.vectors, self.graph, self.entry, self.ids, self.starts = vectors, graph, entry, ids, starts
        self.frame = Frame(vectors)
        self.placed = self.frame.place(vectors)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, **how) -> Shard:
        bits = np.ascontiguousarray(vectors).view(f"u{vectors.itemsize}")
        node = np.unique(bits, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, node))
        ids, node, vectors = ids[order], node[order], vectors[order]
        twice = np.concatenate([[False], (node[1:] == node[:-1]) & (ids[1:] == ids[:-1])])
        ids, node, vectors = ids[~twice], node[~twice], vectors[~twice]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        out = cls(vectors[starts], None, None, ids, np.append(starts, len(ids)))
        out.graph, out.entry = build_graph(out.placed, **how)
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = QUERY_BEAM) -> list[tuple[int, int, float]]:
        """(query, id, distance) of up to k nearest rows of each query in this shard."""
        out = []
        for at in range(0, len(queries), 256):
            own, qs = query_ids[at : at + 256], queries[at : at + 256]
            found, _ = beam_search(self.placed, self.graph, self.entry, self.frame.place(qs), max(beam, k + 1))
            for q, vector, nodes in zip(own.tolist(), qs.astype(np.float64), found, strict=True):
                nodes = nodes[nodes >= 0]
                if len(nodes) <= k < len(self.vectors):
                    nodes = np.arange(len(self.vectors))
                exact = distances(self.vectors[nodes], vector)
                # Distinct vectors at one distance share the ranking by id, so whole ties are gathered before the cut.
                ids = [self.ids[self.starts[v] : min(self.starts[v + 1], self.starts[v] + k + 1)] for v in nodes]
                pairs = sorted((d, i) for d, row in zip(exact.tolist(), ids, strict=True) for i in row.tolist() if i != q)
                out += [(q, i, d) for d, i in pairs[:k]]
        return out


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, dim, band of the rows that take part."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    largest = F.array_max(F.transform("v", lambda c: F.abs(c).cast("double")))
    band = F.floor((F.log10(largest) + BAND / 2) / BAND).cast("int")
    return own.filter(F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v")).withColumn("band", band)


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row per shard, written to the shared folder.  rows: id, v, dim, band."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        shard = Shard.build(table.column("id").to_numpy(), _unpack(table.column("v"), dim))
        blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "shard": table.column("shard").slice(0, 1).cast(pa.int64()), "kind": pa.array([shard.vectors.dtype.str]), "entry": pa.array([shard.entry.tolist()], pa.list_(pa.int64())),
                "vectors": blob(shard.vectors), "graph": blob(shard.graph.astype(np.int32)), "ids": blob(shard.ids), "starts": blob(shard.starts.astype(np.int64)),
            }
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long")).repartition(shards, "dim", "band", "shard")
    schema = "dim int, shard long, kind string, entry array<long>, vectors binary, graph binary, ids binary, starts binary"
    return materialize(dealt.groupBy("dim", "band", "shard").applyInArrow(build, schema), "index")


def search(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int = 10, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score.  queries: id, v, dim."""

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, vectors = table.column("id").to_numpy(), _unpack(table.column("v"), dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "qids": pa.array([ids.tobytes()], pa.binary()), "qs": pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if last != (r["dim"], r["shard"], r["ids"]):
                    kind = np.dtype(r["kind"])
                    shard = Shard(np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"]), np.frombuffer(r["graph"], np.int32).reshape(-1, DEGREE).astype(np.int64), np.array(r["entry"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["starts"], np.int64))
                    last = (r["dim"], r["shard"], r["ids"])
                got = shard.search(np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qs"], np.dtype(r["kind"])).reshape(-1, r["dim"]), k, beam)
                q, i, d = zip(*got, strict=True) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    packed = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("long")).groupBy("dim", "block").applyInArrow(pack, "dim int, qids binary, qs binary")
    packed = materialize(packed, "blocks")
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).repartition(shards, "dim", "shard")
    found = pairs.join(index.repartition(shards, "dim", "shard"), ["dim", "shard"]).mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, shard_rows: int | None = None, beam: int | None = None) -> DataFrame:
    """The k nearest rows found for each row whose id is divisible by ``every``, against all rows."""
    own = usable(rows, id_col, vector_col)
    queries = own.filter(F.col("id") % every == 0)
    total, asked = own.count(), queries.count()
    shard_rows = shard_rows or max(SHARD_ROWS, min(MOST_ROWS, total // SHARDS))
    # Wider beams in larger shards: on random vectors of 64 dimensions recall is 0.98 of 4,096 rows with 96, 0.91 of 32,768 with 256.
    beam = beam or round(QUERY_BEAM * max(1.0, shard_rows / SHARD_ROWS) ** 0.5)
    shards, blocks = max(1, ceil(total / shard_rows)), max(1, ceil(asked / QUERY_BLOCK))
    return search(build_index(own, shards), queries.dropDuplicates(["id"]), shards, blocks, k, beam)
