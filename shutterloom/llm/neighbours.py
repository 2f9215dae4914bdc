"""Most similar vectors for every vector, by robust-pruned directed graphs over shards.

1. Usable vectors (the asked length, finite, not all zero, one per id) are scaled to length 1; exact copies become one
   point with its smallest ids, so a vector that a third of all rows share is one node.
2. Shard centres are fitted by spherical k-means on a bounded sample (``CENTRE_SAMPLE``), one for about ``shard_rows``
   points. Every point is stored in its nearest shard and in those about as near (``COPY_WITHIN``), and asked in those
   a little farther as well (``PROBE_WITHIN``), or in all. Shards that come out too large get centres of their own from
   a sample of their points; what no centre can part is split at random and asked in every part.
3. In a shard, points enter a directed graph in growing batches: a greedy beam search over the graph so far proposes
   neighbours, and robust pruning with a relaxed distance keeps diverse edges; reverse edges are added and pruned
   alike. Queries are answered by beam search, and the similarities of what it finds are computed in double precision.
4. Answers of the shards are merged, and copies are expanded through their smallest ids.

Defined results: null, short, long, non-finite and zero vectors and null ids take no part; of several rows of one id the
smallest vector counts; ties of similarity go to the smaller id; fewer than k others give fewer rows; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage

#: Points of the sample on which shard centres are fitted (eight a shard, at least the first number of points); every
#: point is then stored and asked.
CENTRE_SAMPLE = (20_000, 131_072)
#: Points aimed at in a shard before copies, and the most shards (the centres are sent to the tasks: 512 bytes each).
#: Beyond their product, 32 million points, shards grow with the table: a graph is searched in logarithmic time.
SHARD_ROWS = 2_000
MAX_SHARDS = 16_384
#: Relative squared distance, against that to the nearest centre, up to which a point is also stored, and asked.
COPY_WITHIN, PROBE_WITHIN = 0.08, 0.14
#: Rounds in which shards that come out too large are parted by centres of their own.
REFINE = 2
_SEED = 7


class Graph:
    """A robust-pruned directed graph over unit vectors, built and asked in batches of numpy arrays."""

    def __init__(self, points: np.ndarray, degree: int = 24, beam: int = 32, alpha: float = 1.2) -> None:
        self.x = np.ascontiguousarray(points, np.float32)
        self.n, self.degree, self.beam, self.alpha = len(points), degree, beam, alpha
        self.edges = np.full((self.n, degree), -1, np.int32)
        self.count = np.zeros(self.n, np.int32)
        order = np.random.default_rng(_SEED).permutation(self.n)
        if self.n:
            self.start = int(np.argmax(self.x @ self.x.mean(axis=0)))
            order = np.concatenate([[self.start], order[order != self.start]])
        done = min(self.n, 1)
        while done < self.n:
            size = min(max(64, done), 1024, self.n - done)
            self._insert(order[done : done + size], order[:done] if done <= 4 * beam else None)
            done += size

    def _insert(self, new: np.ndarray, all_old: np.ndarray | None) -> None:
        """Add one batch; while the graph is small its points are all candidates, as are the batch's own points."""
        if all_old is not None:
            cand = np.broadcast_to(np.concatenate([all_old, new]).astype(np.int32), (len(new), len(all_old) + len(new)))
            sim = self.x[new] @ self.x[cand[0]].T
            sim = np.where(cand == new[:, None], -9, sim)
            top = np.argsort(-sim, axis=1)[:, : self.beam]
            cand, sim = np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1)
        else:
            cand, sim = self._walk(self.x[new], self.beam)
            own = self.x[new] @ self.x[new].T  # neighbours within the batch, which the graph does not hold yet
            np.fill_diagonal(own, -9)
            top = np.argpartition(-own, min(8, len(new) - 1), axis=1)[:, : min(8, len(new))]
            cand = np.concatenate([cand, new[top].astype(np.int32)], axis=1)
            sim = np.concatenate([sim, np.take_along_axis(own, top, 1)], axis=1)
        cand = np.where(sim < -5, -1, cand)
        self._set(new, cand, sim)
        source = np.repeat(new, self.degree)
        target = self.edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, times = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, times)
        fits = self.count[target] + place < self.degree
        whole = self.count[hit] + times <= self.degree
        easy = np.repeat(whole, times) & fits
        self.edges[target[easy], self.count[target[easy]] + place[easy]] = source[easy]
        self.count[hit[whole]] += times[whole].astype(np.int32)
        full = hit[~whole]
        for s in range(0, len(full), 512):
            part = full[s : s + 512]
            width = int(times[~whole][s : s + 512].max())
            cand = np.full((len(part), self.degree + width), -1, np.int32)
            cand[:, : self.degree] = self.edges[part]
            mine = np.isin(target, part)
            cand[np.searchsorted(part, target[mine]), self.degree + place[mine]] = source[mine]
            sim = np.einsum("bd,bcd->bc", self.x[part], self.x[cand])
            self._set(part, cand, sim)

    def _set(self, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Robust pruning: take the nearest candidate, drop those it covers by the relaxed distance, and so on."""
        order = np.argsort(np.where(cand < 0, 9, -sim), axis=1)[:, : 2 * self.beam]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        same = np.sort(cand, axis=1)
        if (same[:, 1:] == same[:, :-1]).any():  # repeated candidates: keep the first of each
            rank = np.argsort(cand, axis=1, kind="stable")
            ordered = np.take_along_axis(cand, rank, 1)
            again = np.zeros_like(cand, bool)
            again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            back = np.zeros_like(again)
            np.put_along_axis(back, rank, again, 1)
            cand = np.where(back, -1, cand)
        far = np.where(cand < 0, np.inf, 2 - 2 * sim)
        alive = (cand >= 0) & (cand != nodes[:, None])
        among = 2 - 2 * np.matmul(self.x[cand], self.x[cand].transpose(0, 2, 1))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, k] = cand[rows, pick][some]
            alive &= ~((self.alpha**2 * among[rows, pick] <= far) & some[:, None])
            alive[rows, pick] = False
        self.edges[nodes] = out
        self.count[nodes] = (out >= 0).sum(axis=1)

    def _walk(self, q: np.ndarray, beam: int, width: int = 4, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of many queries at once: (ids, similarities), best first, -1 where there are fewer. ``start``
        has the node a query begins at, -1 for the entry point of the graph."""
        m = len(q)
        first = np.full(m, self.start) if start is None else np.where(start < 0, self.start, start)
        ids = np.full((m, beam), -1, np.int32)
        sim = np.full((m, beam), -9, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], sim[:, 0], open_[:, 0] = first, np.einsum("nd,nd->n", q, self.x[first]), True
        seen = np.zeros((m, self.n + 1), bool)
        seen[:, self.n] = seen[np.arange(m), first] = True
        live = np.arange(m)
        while len(live):
            rank = np.argsort(~open_[live], axis=1, kind="stable")[:, :width]
            going = np.take_along_axis(open_[live], rank, 1)
            node = np.where(going, np.take_along_axis(ids[live], rank, 1), -1)
            open_[live[:, None], rank] = False
            nxt = np.where(node[:, :, None] >= 0, self.edges[node], -1).reshape(len(live), -1)
            nxt = np.where(nxt < 0, self.n, nxt)
            nxt = np.where(seen[live[:, None], nxt], self.n, nxt)
            nxt.sort(axis=1)
            keep = min(nxt.shape[1], max(1, int((nxt < self.n).sum(axis=1).max())))
            nxt = nxt[:, :keep]
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = self.n
            seen[live[:, None], nxt] = True
            fresh = nxt < self.n
            got = np.where(fresh, np.matmul(self.x[np.where(fresh, nxt, 0)], q[live][:, :, None])[:, :, 0], -9).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(fresh, nxt, -1).astype(np.int32)], axis=1)
            all_sim = np.concatenate([sim[live], got], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[live], sim[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1)
            open_[live] = np.take_along_axis(all_open, top, 1)
            live = live[open_[live].any(axis=1)]
        return ids, sim

    def ask(self, q: np.ndarray, k: int, beam: int, start: np.ndarray | None = None, cells: int = 8_000_000) -> np.ndarray:
        """Ids of the ``k`` best of a beam search for each query, -1 where there are fewer; blocks of queries are as large
        as ``cells`` marks of visited nodes allow."""
        q = np.ascontiguousarray(q, np.float32)
        block = max(16, min(256, cells // max(1, self.n)))
        out = np.full((len(q), k), -1, np.int32)
        for s in range(0, len(q) if self.n else 0, block):
            ids = self._walk(q[s : s + block], max(beam, k), start=None if start is None else start[s : s + block])[0][:, :k]
            out[s : s + block, : ids.shape[1]] = ids
        return out


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(_SEED)
    c = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        order = np.argsort(near, kind="stable")
        hit, first = np.unique(near[order], return_index=True)
        c[hit] = np.add.reduceat(sample[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def usable(rows: DataFrame, id_col: str, vector_col: str, length: int) -> DataFrame:
    """(id, vec): unit vectors as 8-byte numbers in one binary value, one row per id."""
    v = F.col(vector_col).cast("array<double>")
    kept = (
        rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & (F.size("v") == length))
        .where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"id": b["id"], "vec": [r.tobytes() for r in x]})

    return kept.mapInPandas(scale, "id long, vec binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _near_shards(vectors: np.ndarray, c: np.ndarray, most: int, within: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the vector, shard): the nearest centre of each and those up to ``within`` farther, at most ``most``
    (a geometric bound on copies; with None for ``within`` exactly that many)."""
    out_i, out_s = [], []
    for at in range(0, len(vectors), max(64, 4_000_000 // len(c))):
        far = 2 - 2 * (vectors[at : at + max(64, 4_000_000 // len(c))] @ c.T)
        near = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(c) else np.broadcast_to(np.arange(len(c)), far.shape)
        far = np.take_along_axis(far, near, 1)
        i, j = np.nonzero(np.ones_like(far, bool) if within is None else far <= (1 + within) * far.min(axis=1, keepdims=True) + 1e-12)
        out_i.append(at + i)
        out_s.append(near[i, j])
    return np.concatenate(out_i), np.concatenate(out_s)


def top_similar(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 10,
    length: int = 64,
    min_similarity: float | None = None,
    only: str | None = None,
    probes: int | None = 8,
    copies: int = 5,
    beam: int = 32,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, neighbour_id, similarity, place): the k most similar other vectors of each, places from 1.

    ``min_similarity`` leaves out less similar ones, ``only`` is a condition on ``id`` for the rows that ask (all are
    answered from), ``copies`` and ``probes`` the most shards a point is stored and asked in, None for asking all.
    """
    keyed = usable(rows, id_col, vector_col, length).withColumn("mark", F.sha2("vec", 256))  # one vector, one mark
    of_vector = keyed.groupBy("mark").agg(F.min("id").alias("node"), F.first("vec").alias("vec"))
    points = cut_lineage(keyed.select("id", "mark"))
    by_vector = Window.partitionBy("mark").orderBy("id")
    groups = points.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1).groupBy("mark").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = cut_lineage(groups.select("mark", F.col("ids")[0].alias("node"), "ids"))
    members = cut_lineage(of_vector.select("node", "vec"))
    n = members.count()
    if not n:
        return points.select("id", F.col("id").alias("neighbour_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("place")).limit(0)
    wanted = max(1, min(MAX_SHARDS, math.ceil(n / shard_rows)))
    size = max(CENTRE_SAMPLE[0], min(CENTRE_SAMPLE[1], 8 * wanted))
    taken = _matrix(members.select("vec").orderBy(F.xxhash64("vec")).limit(size).toPandas()["vec"])
    c = centres(taken, max(1, min(wanted, len(taken) // 8)))
    aim = max(shard_rows, math.ceil(n / len(c)))

    asking = members  # a copy asks through its group's node
    if only is not None:
        asking = points.where(only).select("mark").distinct().join(groups, "mark").select("node").join(members, "node")

    def place(batches: Iterator[pd.DataFrame], c: np.ndarray, hold: bool, ask: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, nodes, vecs = _matrix(b["vec"]), b["node"].to_numpy(), b["vec"].to_numpy()
                hi, hs = _near_shards(x, c, min(copies, len(c)), COPY_WITHIN) if hold else (np.empty(0, int),) * 2
                ai, as_ = _near_shards(x, c, len(c) if probes is None else min(probes, len(c)), None if probes is None else PROBE_WITHIN) if ask else (np.empty(0, int),) * 2
                both, at = np.unique(np.concatenate([hi * len(c) + hs, ai * len(c) + as_]), return_inverse=True)
                held, asked = np.zeros(len(both), bool), np.zeros(len(both), bool)
                held[at[: len(hi)]] = True
                asked[at[len(hi) :]] = True
                yield pd.DataFrame({"shard": both % len(c), "held": held, "ask": asked, "node": nodes[both // len(c)], "vec": vecs[both // len(c)]})

    kind = "shard long, held boolean, ask boolean, node long, vec binary"

    def spread(c: np.ndarray) -> DataFrame:
        if only is None:
            return members.mapInPandas(lambda it: place(it, c, True, True), kind)
        return members.mapInPandas(lambda it: place(it, c, True, False), kind).unionByName(asking.mapInPandas(lambda it: place(it, c, False, True), kind))

    most = 8 * aim
    for round_ in range(REFINE + 1):
        # at most a row for each shard
        counts = {r.shard: (r.h, r.a) for r in spread(c).groupBy("shard").agg(F.count_if("held").alias("h"), F.count_if("ask").alias("a")).where((F.col("h") > most) | (F.col("a") > most)).collect()}
        full = [s for s, (h, _) in counts.items() if h > most]
        room = MAX_SHARDS - len(c)
        if not full or round_ == REFINE or room < len(full):
            break
        # centres of their own for crowded shards, from a bounded sample of each
        parts = {s: min(math.ceil(counts[s][0] / aim), max(2, room // len(full)), CENTRE_SAMPLE[1] // (8 * len(full))) for s in full}
        each = max(16, CENTRE_SAMPLE[1] // len(full))
        nth = Window.partitionBy("shard").orderBy(F.xxhash64("node"))
        some = spread(c).where(F.col("held") & F.col("shard").isin(full)).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= each).select("shard", "vec").toPandas()
        own = [centres(x, min(parts[s], max(1, len(x) // 8))) for s, x in ((s, _matrix(g["vec"])) for s, g in some.groupby("shard"))]
        c = np.concatenate([np.delete(c, full, axis=0), *own])

    # what no centre parts: (parts of the points) x (larger parts of the questions, so that graphs are built few times)
    def split(df: DataFrame) -> DataFrame:
        crowd = {s: (math.ceil(h / most), math.ceil(a / (8 * most))) for s, (h, a) in counts.items()}
        crowd = {s: v for s, v in crowd.items() if v > (1, 1) or v[1] > 1}
        if not crowd:
            return df.withColumn("p_part", F.lit(0)).withColumn("q_part", F.lit(0))
        number = lambda at: F.coalesce(F.create_map(*[F.lit(x) for s, v in crowd.items() for x in (s, v[at])])[F.col("shard")], F.lit(1))
        own = lambda at: F.pmod(F.xxhash64("node"), number(at)).cast("int")
        every = lambda at: F.explode(F.sequence(F.lit(0), (number(at) - 1).cast("int")))
        held = df.where("held").withColumn("ask", F.lit(False)).withColumn("p_part", own(0)).withColumn("q_part", every(1))
        asked = df.where("ask").withColumn("held", F.lit(False)).withColumn("q_part", own(1)).withColumn("p_part", every(0))
        few = ~F.col("shard").isin(list(crowd))
        whole = df.where(few).withColumn("p_part", F.lit(0)).withColumn("q_part", F.lit(0))
        return whole.unionByName(held.where(~few)).unionByName(asked.where(~few))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        held, ask = group["held"].to_numpy(), group["ask"].to_numpy()
        if not held.any() or not ask.any():
            return empty
        nodes, vectors = group["node"].to_numpy(), _matrix(group["vec"])
        data, queries, x, q = nodes[held], nodes[ask], vectors[held], vectors[ask]
        start = np.where(held, np.cumsum(held) - 1, -1)[ask]  # a point that is stored here begins at its own node
        best = Graph(x).ask(q, min(2 * (k + 1), len(x)), beam, start)  # more than asked: double precision decides among them
        out = []
        for s in range(0, len(q), 4096):
            i, j = np.nonzero(best[s : s + 4096] >= 0)
            t = best[s : s + 4096][i, j]
            sim = np.einsum("nd,nd->n", q[s + i], x[t])
            keep = np.ones(len(sim), bool) if min_similarity is None else sim >= min_similarity - 1e-9
            order = np.lexsort((-sim, i))
            first = np.searchsorted(i[order], i[order])
            keep[order[np.arange(len(order)) - first > k]] = False
            out.append(pd.DataFrame({"node": queries[s + i][keep], "other": data[t][keep], "similarity": sim[keep]}))
        return pd.concat(out)

    met = split(spread(c)).groupBy("shard", "p_part", "q_part").applyInPandas(search, "node long, other long, similarity double")
    met = met.groupBy("node", "other").agg(F.max("similarity").alias("similarity"))
    # every node meets itself, so that copies of one vector meet each other
    met = met.where("node <> other").unionByName(asking.select("node", F.col("node").alias("other"), F.lit(1.0).alias("similarity")))
    nodes = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    met = met.withColumn("nth", F.row_number().over(nodes)).where(F.col("nth") <= k + 1).drop("nth")
    met = met.join(groups.select(F.col("node").alias("other"), "ids"), "other").select("node", "similarity", F.explode("ids").alias("neighbour_id"))
    ranked = Window.partitionBy("node").orderBy(F.desc("similarity"), "neighbour_id")
    best = met.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1).drop("nth")
    own = points.join(groups.select("mark", "node"), "mark").select("id", "node")
    if only is not None:
        own = own.where(only)
    answers = own.join(best, "node").where(F.col("id") != F.col("neighbour_id"))
    if min_similarity is not None:
        answers = answers.where(F.col("similarity") >= min_similarity)
    final = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return answers.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).select("id", "neighbour_id", "similarity", "place")
