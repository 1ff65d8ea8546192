"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Building: greedy beam searches from a central node propose neighbours for each vector, and pruning with a relaxed distance
(alpha) keeps those that lie in different directions; the edges are returned, and nodes that get too many are pruned again.
Searching: a beam search through every shard's graph, then the exact distances and a merge of the shards' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, tidy_table
from corpusforge.llm.vectors import matrix, merge_top, shard_of, shards_for, usable

#: Vectors in a shard, queries in a block, edges of a node, beam width, and the relaxation of pruning.
SHARD, BLOCK, DEGREE, BEAM, ALPHA = 4096, 1024, 32, 96, 1.2
#: Beam width while building, where distances are in single precision.
BUILD_BEAM = 64
#: Searches that run side by side in one worker.
SIDE = 256


def beam_search(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (n x beam, nearest first; id -1 for none) that greedy beam searches from `start` find."""
    q, n = len(queries), len(x)
    qn = (queries**2).sum(1)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, x.dtype)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = qn + norm[start] - 2 * queries @ x[start]
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(done[live], np.inf, dist[live])
        at = waiting.argmin(1)
        open_ = np.isfinite(waiting[np.arange(len(live)), at])
        live, at = live[open_], at[open_]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[np.repeat(live, near.shape[1])[fresh.ravel()], near[fresh]] = True
        d = np.where(fresh, qn[live, None] + norm[near] - 2 * (x[near] @ queries[live][:, :, None])[:, :, 0], np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(y, order, 1) for y in (all_d, all_i, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the proposed neighbours (nodes x m, -1 for none), those no kept one is alpha times nearer to; at most `degree`."""
    proposed = np.where(proposed == nodes[:, None], -1, proposed)
    proposed = np.sort(proposed, 1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    vectors = x[proposed]
    norms = (vectors**2).sum(2)
    dist = np.where(proposed >= 0, ((vectors - x[nodes][:, None]) ** 2).sum(2), np.inf)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = dist.argmin(1)
        some = np.isfinite(dist[rows, best])
        if not some.any():
            break
        out[some, k] = proposed[some, best[some]]
        chosen = vectors[rows, best]
        between = norms + norms[rows, best][:, None] - 2 * (vectors @ chosen[:, :, None])[:, :, 0]
        dist[(alpha * alpha * between <= dist) & some[:, None]] = np.inf
        dist[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph (n x degree, -1 for none) over distinct vectors, and its central node."""
    n = len(x)
    rng = np.random.default_rng(n)
    x = x.astype(np.float32)
    norm = (x**2).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        for k in range(min(degree // 2, n - 1)):
            graph[:, k] = (np.arange(n) + rng.integers(1, n, n)) % n
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, SIDE):
            nodes = order[at : at + SIDE]
            found, _ = beam_search(x, norm, graph, start, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], 1), degree, a)
            # the edges returned: where they don't fit, the node is pruned again
            source, target = np.repeat(nodes, degree), graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            node, first, count = np.unique(target, return_index=True, return_counts=True)
            more = np.full((len(node), int(count.max(initial=1))), -1, np.int64)
            more[np.repeat(np.arange(len(node)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            held = np.concatenate([graph[node], more], 1)
            held = np.sort(held, 1)[:, ::-1]
            held[:, 1:][held[:, 1:] == held[:, :-1]] = -1
            size = (held >= 0).sum(1)
            fits = size <= degree
            packed = np.sort(held[fits], 1)[:, ::-1][:, :degree]
            graph[node[fits]] = packed
            if (~fits).any():
                graph[node[~fits]] = robust_prune(x, node[~fits], held[~fits], degree, a)
    return graph, start


def search(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of all other rows for each row whose id is divisible by `every`.

    The score is the Euclidean distance of the original vectors in doubles. Vectors that are null, zero, or hold a null or
    non-finite component take no part, nor do rows of null id. Vectors of different lengths aren't compared. Ties go to the
    smaller id. Equal vectors of a shard are one node of its graph and all rows of the node are reached by it; of these a
    query takes its k first by id. An empty table has no result. Shards are dealt by a hash of the id; each is indexed once,
    written to the shared folder, and searched by blocks of queries.
    """
    rows = usable(df, id_col, vector_col, allow_zero=False)
    n = rows.count()
    shards, blocks = shards_for(n, shard), shards_for(-(-n // every), BLOCK)

    def index(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), matrix(table["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        distinct, of = np.unique(x, axis=0, return_inverse=True)
        graph, start = build(distinct)
        by = np.lexsort((ids, of))
        return pa.table({"shard": table["shard"].slice(0, 1), "dim": table["dim"].slice(0, 1), "start": [start], "ids": [ids[by].tobytes()], "node": [of[by].astype(np.int32).tobytes()], "x": [distinct.tobytes()], "graph": [graph.astype(np.int32).tobytes()]})

    schema = "shard int, dim int, start long, ids binary, node binary, x binary, graph binary"
    built = Stored(rows.withColumn("shard", shard_of(F.col("vec_id"), shards)).groupBy("shard", "dim").applyInArrow(tidy_table(index), schema), "graphs")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            g = right.slice(0, 1).to_pylist()[0]
            x = np.frombuffer(g["x"], np.float64).reshape(-1, g["dim"])
            graph = np.frombuffer(g["graph"], np.int32).reshape(len(x), -1).astype(np.int64)
            ids, node = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["node"], np.int32)
            first = np.searchsorted(node, np.arange(len(x) + 1))
            norm = (x**2).sum(1)
            who, q = left["query_id"].to_numpy(), matrix(left["query"].combine_chunks())
            for at in range(0, len(q), SIDE):
                near, _ = beam_search(x, norm, graph, g["start"], q[at : at + SIDE], min(max(beam, k + 1), max(len(x), 1)))
                for i, nodes in enumerate(near):
                    nodes = nodes[nodes >= 0]
                    exact = np.sqrt(((x[nodes] - q[at + i]) ** 2).sum(1))
                    # enough rows of the nearest nodes, all of a node's ties with the last included
                    got = np.concatenate([ids[first[m] : min(first[m + 1], first[m] + k + 1)] for m in nodes])
                    d = np.repeat(exact, [min(first[m + 1] - first[m], k + 1) for m in nodes])
                    other = got != who[at + i]
                    got, d = got[other], d[other]
                    by = np.lexsort((got, d))[:k]
                    found.append((np.full(len(by), who[at + i]), got[by], d[by]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        shard_ = left["shard"][0].as_py() if len(left) else 0
        return pa.table({"query_id": columns[0].astype(np.int64), "shard": pa.array(np.full(len(columns[0]), shard_, np.int32)), "vec_id": columns[1], "score": columns[2]})

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("dim").alias("dim"))
    queries = queries.withColumn("block", shard_of(F.col("query_id"), blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = built.read().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "dim"]
    lists = queries.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInArrow(look, "query_id long, shard int, vec_id long, score double")
    return merge_top(lists, shards, k, [F.asc("score"), F.asc("vec_id")]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
