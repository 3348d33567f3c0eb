"""Embedding near-dedup over hierarchical navigable small-world graphs, one per shard.

Vectors are compared only under equal labels. Equal vectors are one node with a multiplicity. A label's nodes are dealt
to shards of about `shard` nodes; each shard gets a graph of layers (a node reaches layer l with probability
`1 / m^l`). Nodes are inserted in batches: each searches the graph made so far, its neighbours are chosen by the usual
diversity rule from what it found there and in its batch, and edges go both ways. Graphs are written to the shared folder.

Every node then queries every shard of its label: greedy descent through the layers, a beam on the lowest for a block of
queries at once, and from the links that it found a flood along edges, which lists the rest of a group; a query whose
beam holds nothing but links is in a group so large that a scan of the shard lists it sooner. An audit scans
the shard for some of the queries, for more of them until enough with links were seen, and compares query by query: if
less than `recall` of their links were found, the beam is widened and the flood let through wider, in the end to a scan.
Links are verified by cosine in double precision. A block of queries goes past its label's shards one after another,
with one graph in memory at a time; it returns how many vectors each query links to, and links between queries and the
shards' own components (by edges that are links) as a forest, so a group of thousands of near copies gives a row or two
each. Components are united by joins.

Scale: a task holds a block and a shard. Every query is answered by every shard of its label, so the work for a label
grows with the square of its size divided by the shards' gain; no key, label or group meets in one task.

Edge cases: a vector that is null, zero, or holds a null or non-finite component, and any vector with a null label,
links with nothing, is its own component and is kept; vectors of different lengths never link; a cosine at the limit (a
tie) links; rows that share an id link through each of their vectors and are told apart in the result only by those; a
null id has a null component; a very long vector is a row like any other; other columns, whatever their names, are not
read; an empty table gives none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.lm import load, store
from corpusflow.operators.components import components
from corpusflow.session import cut, shared_dir

M, WIDTH, BATCH, AT_ONCE = 12, 36, 512, 6


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; for mostly distinct ones a sort is faster than a hash."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def search(near: np.ndarray, edges: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, products) of the ef best that a beam from start (one node a query) finds for each query; -1 fills up."""
    n, rows = len(q), np.arange(len(q))
    nodes, sims, done = np.full((n, ef), -1, np.int32), np.full((n, ef), -3, np.float32), np.ones((n, ef), bool)
    nodes[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("bd,bd->b", q, near[start]), False
    seen = np.zeros((n, len(near)), bool)
    seen[rows, start] = True
    live = rows
    while len(live):
        # the best few open nodes of each query at once
        open_ = np.where(done[live], -3, sims[live])
        j = np.argpartition(-open_, AT_ONCE - 1, axis=1)[:, :AT_ONCE] if ef > AT_ONCE else np.broadcast_to(np.arange(ef), (len(live), ef))
        more = np.take_along_axis(open_, j, 1) > -3
        some = more.any(1)
        live, j, more = live[some], j[some], more[some]
        if not len(live):
            break
        at = nodes[live[:, None], j]
        done[live[:, None], j] = True
        nb = np.where(more[:, :, None], edges[at], -1).reshape(len(live), -1)
        row, col = np.nonzero(nb >= 0)
        code = distinct(row * len(near) + nb[row, col])
        row, node = code // len(near), code % len(near)
        fresh = ~seen[live[row], node]
        row, node = row[fresh], node[fresh]
        seen[live[row], node] = True
        s = np.einsum("ij,ij->i", q[live[row]], near[node])
        # only what is better than the worst of the beam comes in
        good = s > sims[live].min(1)[row]
        row, node, s = row[good], node[good], s[good]
        if not len(row):
            continue
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        wide = int(rank.max()) + 1
        new_n, new_s = np.full((len(live), wide), -1, np.int32), np.full((len(live), wide), -3, np.float32)
        new_n[row, rank], new_s[row, rank] = node, s
        all_s = np.concatenate([sims[live], new_s], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], new_n], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], new_n < 0], 1), top, 1)
        sims[live] = np.take_along_axis(all_s, top, 1)
    return nodes, sims


def diverse(near: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M neighbours of each row's candidates by the diversity rule, filled up with the nearest others; -1 where there are fewer."""
    keep = min(3 * M, nodes.shape[1])
    best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    order = np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable")
    best = np.take_along_axis(best, order, 1)
    nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
    v = near[nodes]
    between = np.einsum("bid,bjd->bij", v, v)
    chosen = np.zeros(nodes.shape, bool)
    for j in range(keep):
        rival = np.where(chosen, between[:, j, :], -3).max(1)
        chosen[:, j] = (nodes[:, j] >= 0) & (sims[:, j] > rival) & (chosen.sum(1) < M)
    rank = np.where(chosen, np.arange(keep), keep + np.arange(keep))
    pick = np.argsort(rank, axis=1)[:, :M]
    return np.take_along_axis(nodes, pick, 1), np.take_along_axis(sims, pick, 1)


def with_reverse(edges: np.ndarray, sims: np.ndarray, src: np.ndarray, dst: np.ndarray, s: np.ndarray) -> None:
    """Put the edges src -> dst into the places after a node's own M ones; the nearest stay where there are too many."""
    touched = np.unique(src)
    have = edges[touched, M:]
    row, col = np.nonzero(have >= 0)
    u = np.concatenate([touched[row], src])
    v = np.concatenate([have[row, col], dst])
    p = np.concatenate([sims[touched, M:][row, col], s])
    order = np.lexsort((v, -p, u))
    u, v, p = u[order], v[order], p[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u, "left")
    keep = rank < WIDTH - M
    edges[touched, M:], sims[touched, M:] = -1, -3
    edges[u[keep], M + rank[keep]], sims[u[keep], M + rank[keep]] = v[keep], p[keep]


class Graph:
    """A shard's index. Vectors are unit length, in double precision, higher levels first: layer l holds the first sizes[l]."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, times: np.ndarray, roots: np.ndarray, sizes: np.ndarray, layers: list[np.ndarray]) -> None:
        self.vectors, self.ids, self.times, self.roots, self.sizes, self.layers = vectors, ids, times, roots, sizes, layers
        self.near = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, times: np.ndarray, least: float, ef: int = 48) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(n).random(n)) / np.log(M)).astype(int)
        order = np.argsort(-level, kind="stable")
        vectors, ids, times, level = vectors[order], ids[order], times[order], level[order]
        sizes = np.array([int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)], np.int64)
        graph = cls(vectors, ids, times, ids, sizes, [np.zeros((0, WIDTH), np.int32)] * len(sizes))
        for k in range(len(sizes) - 1, -1, -1):
            graph.layers[k] = graph.insert(k, ef)
        # components by the edges that are links
        a, b = np.nonzero(graph.layers[0] >= 0)
        b = graph.layers[0][a, b]
        sure = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= least
        a, b, roots = a[sure], b[sure], np.arange(n)
        while True:  # minimum over links, then over what the minimum points to
            before = roots.copy()
            np.minimum.at(roots, a, roots[b])
            np.minimum.at(roots, b, roots[a])
            roots = roots[roots]
            if (roots == before).all():
                break
        graph.roots = ids[roots]
        return graph

    def insert(self, k: int, ef: int) -> np.ndarray:
        """The edges of layer k, of which the layers above are made."""
        size = int(self.sizes[k])
        edges, sims = np.full((size, WIDTH), -1, np.int32), np.full((size, WIDTH), -3, np.float32)
        done = 1
        while done < size:
            batch = np.arange(done, min(size, done + min(BATCH, done)))
            q = self.near[batch]
            inside = q @ q.T
            np.fill_diagonal(inside, -3)
            start = np.minimum(self.descend(q, k), done - 1) if k + 1 < len(self.sizes) else np.zeros(len(batch), int)
            nodes, found = search(self.near[:done], edges[:done], q, start, ef)
            nodes = np.concatenate([nodes, np.broadcast_to(np.where(inside > -3, batch[None, :], -1), inside.shape)], 1)
            nb, s = diverse(self.near, nodes.astype(np.int32), np.concatenate([found, inside.astype(np.float32)], 1))
            s = np.where(nb >= 0, s, -3)
            edges[batch, : nb.shape[1]], sims[batch, : nb.shape[1]] = nb, s
            row, col = np.nonzero(nb >= 0)
            with_reverse(edges, sims, nb[row, col], batch[row].astype(np.int32), s[row, col])
            done += len(batch)
        return edges

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The node of layer to + 1 that greedy descent ends at, for each query."""
        rows, at = np.arange(len(q)), np.zeros(len(q), np.int64)
        best = q @ self.near[0]
        for k in range(len(self.sizes) - 1, to, -1):
            while True:
                nb = self.layers[k][at]
                s = np.where(nb >= 0, np.einsum("bd,bmd->bm", q, self.near[nb]), -3)
                j = s.argmax(1)
                better = s[rows, j] > best
                if not better.any():
                    break
                at, best = np.where(better, nb[rows, j], at), np.where(better, s[rows, j], best)
        return at

    def arrays(self) -> list[np.ndarray]:
        shape = np.array([*self.vectors.shape, len(self.sizes)], np.int64)
        return [shape, self.vectors.reshape(-1), self.ids, self.times, self.roots, self.sizes, *(x.reshape(-1) for x in self.layers)]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Graph:
        n, dims, _ = arrays[0]
        return cls(arrays[1].reshape(n, dims), *arrays[2:6], [x.reshape(-1, WIDTH) for x in arrays[6:]])

    def flood(self, q: np.ndarray, row: np.ndarray, node: np.ndarray, least: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """From (query, node) links on along edges, through nodes within `slack` of the limit: all pairs at the limit met."""
        seen = np.zeros((len(q), len(self.near)), bool)
        seen[row, node] = True
        out = [(row, node)]
        while len(row):
            nb = self.layers[0][node]
            a, j = np.nonzero(nb >= 0)
            row, node = row[a], nb[a, j]
            new = ~seen[row, node]
            code = distinct(row[new].astype(np.int64) * len(self.near) + node[new])
            row, node = code // len(self.near), code % len(self.near)
            seen[row, node] = True
            s = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + 65536]], self.near[node[a : a + 65536]]) for a in range(0, len(row), 65536)]) if len(row) else np.zeros(0, np.float32)
            out.append((row[s >= least - 1e-4], node[s >= least - 1e-4]))
            row, node = row[s >= least - slack], node[s >= least - slack]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def links(self, q: np.ndarray, ids: np.ndarray, least: float, ef: int, recall: float, enough: int = 8) -> tuple[np.ndarray, np.ndarray, float, int]:
        """(query, node) pairs with a cosine of at least the limit, the audited recall and how many queries it is the mean of."""
        n, slack = len(self.near), 0.02
        truth, audited = np.zeros((0, n), bool), 0
        order = np.random.default_rng(n).permutation(len(q))  # audits are drawn, and the same each time
        while audited < len(q) and truth.any(1).sum() < enough:
            part = order[audited : max(64, 2 * audited)]
            hit = q[part] @ self.vectors.T >= least
            hit[ids[part][:, None] == self.ids] = False
            truth, audited = np.concatenate([truth, hit]), audited + len(part)
        some = truth.any(1)
        q32, start = q.astype(np.float32), None
        while True:
            ef = min(ef, n)
            start = self.descend(q32, 0) if start is None else start
            nodes, sims = search(self.near, self.layers[0], q32, start, ef)
            full = sims.min(1) >= least - 1e-4  # nothing but links: to list them all takes a scan
            row, j = np.nonzero((sims >= least - 1e-4) & ~full[:, None])
            row, node = self.flood(q32, row, nodes[row, j], least, slack)
            found = np.zeros((len(q), n), bool)
            found[full] = q[full] @ self.vectors.T >= least
            found[row, node] = np.einsum("ij,ij->i", q[row], self.vectors[node]) >= least
            row, node = np.nonzero(found)
            got = float(((found[order[:audited]] & truth).sum(1)[some] / truth.sum(1)[some]).mean()) if some.any() else 1.0
            if got >= recall:
                return row, node, got, int(some.sum())
            if ef == n:  # some nodes cannot be reached along edges
                row, node = np.nonzero(q @ self.vectors.T >= least)
                return row, node, 1.0, int(some.sum())
            ef, slack = 4 * ef, slack + 0.05


def packed(nodes: DataFrame, size: int, salt: str) -> DataFrame:
    """(label, dims, part, ids, times, vectors): nodes of a label dealt to rows of about `size`, vectors as doubles."""
    total = nodes.groupBy("label", "dims").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
    dealt = nodes.join(total, ["label", "dims"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(salt)), "parts").cast("int"))
    rows = dealt.groupBy("label", "dims", "part").agg(F.array_sort(F.collect_list(F.struct("node", "times", "embedding"))).alias("x"))
    return rows.select("label", "dims", "part", F.col("x.node").alias("ids"), F.col("x.times").alias("times"), F.flatten("x.embedding").alias("flat"))


def unit(flat: pa.ListScalar, dims: int) -> np.ndarray:
    v = flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def linked(nodes: DataFrame, least: float, shard: int, block: int, ef: int, recall: float) -> DataFrame:
    """(node, n, root, audited, found): links of each node that has any and what it hangs together with; roots with n = 0 too.

    audited and found: audited queries with links and the sum of their recalls, on a block's first row.
    """
    folder = shared_dir(nodes.sparkSession)
    home = f"{folder if '://' in folder else 'file://' + os.path.abspath(folder)}/graphs-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, times = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "times"))
                graph = Graph.build(unit(batch.column("flat")[k], batch.column("dims")[k].as_py()), ids, times, least, ef)
                store(home, f"{batch.column('key')[k].as_py()}-{batch.column('part')[k].as_py()}", graph.arrays())
                yield batch.select(["part"]).slice(k, 1)

    key = F.hex(F.xxhash64("label", "dims")).alias("key")
    packed(nodes, shard, "shard").select(key, "part", "dims", "ids", "times", "flat").mapInArrow(build, "part int").write.format("noop").mode("overwrite").save()
    sizes = nodes.groupBy("label", "dims").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    asks = packed(nodes, block, "block").join(sizes, ["label", "dims"]).select(key, "shards", "dims", "ids", "flat")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values.to_numpy(zero_copy_only=False)
                q = unit(batch.column("flat")[k], batch.column("dims")[k].as_py())
                n, pairs, audited, found = np.zeros(len(ids), np.int64), [], 0, 0.0
                for part in range(batch.column("shards")[k].as_py()):
                    if (arrays := load(home, f"{batch.column('key')[k].as_py()}-{part}")) is None:
                        continue  # the hash dealt nothing to it
                    graph = Graph.of(arrays)
                    row, node, got, some = graph.links(q, ids, least, ef, recall)
                    audited, found = audited + some, found + got * some
                    other = ids[row] != graph.ids[node]
                    row, node = row[other], node[other]
                    n += np.bincount(row, weights=graph.times[node], minlength=len(ids)).astype(np.int64)
                    pairs.append(np.unique(np.stack([ids[row], graph.roots[node]], 1), axis=0))
                # a forest of the block's queries and the roots they met
                a, b = np.concatenate(pairs).T if pairs else np.zeros((2, 0), np.int64)
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                a, b, roots = at[: len(a)], at[len(a) :], np.arange(len(names))
                while True:
                    before = roots.copy()
                    np.minimum.at(roots, a, roots[b])
                    np.minimum.at(roots, b, roots[a])
                    roots = roots[roots]
                    if (roots == before).all():
                        break
                counts = dict(zip(ids.tolist(), n.tolist(), strict=True))
                first = np.arange(len(names)) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.astype(np.int64)), pa.array([counts.get(x, 0) for x in names.tolist()], pa.int64()), pa.array(names[roots].astype(np.int64)), pa.array(np.where(first, audited, 0)), pa.array(np.where(first, found, 0.0))],
                    names=["node", "n", "root", "audited", "found"],
                )

    return asks.mapInArrow(ask, "node long, n long, root long, audited long, found double")


def as_nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, embedding) of all rows, and the nodes: distinct usable vectors of each label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows, cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")).withColumn("dims", F.size("embedding")))


def recall_report(vectors: DataFrame, least: float = 0.93, shard: int = 2048, block: int = 2048, ef: int = 48, recall: float = 0.99) -> DataFrame:
    """One row: audited queries with links, and the share of their links that was found."""
    got = linked(as_nodes(vectors)[1], least, shard, block, ef, recall)
    return got.agg(F.sum("audited").alias("queries"), (F.sum("found") / F.sum("audited")).alias("recall"))


def groups(vectors: DataFrame, least: float = 0.93, shard: int = 2048, block: int = 2048, ef: int = 48, recall: float = 0.99) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, nodes = as_nodes(vectors)
    got = cut(linked(nodes, least, shard, block, ef, recall).select("node", "n", "root"))
    one = components(got.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = got.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.join(counts, "node", "left").join(one.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
