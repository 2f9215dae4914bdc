"""Exact vector retrieval, centroids, nearest centroid, absorption and online clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.functions.predicates import cosine
from shutterloom.session import stored_blocks


def nearest(df: DataFrame, id_col: str, vector_col: str, queries: list[list[float]], k: int | None = None, where=None) -> DataFrame:
    """(id, distance): the cosine distance to the closest of the query vectors; other lengths are passed over."""
    rows = df if where is None else df.where(where)
    asked = [F.array(*[F.lit(float(x)) for x in q]) for q in queries]
    best = [F.lit(1.0) - cosine(F.col(vector_col), q) for q in asked]
    out = rows.select(F.col(id_col).alias("id"), (F.least(*best) if len(best) > 1 else best[0]).alias("distance")).where("distance is not null")
    return out if k is None else out.orderBy("distance", "id").limit(k)


def over_fetch(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, where, factor: int = 2) -> DataFrame:
    """(id, distance): the ``k`` nearest that meet ``where``, out of the ``factor`` * k nearest of all, as an index without
    filters answers; may give fewer than k. Distances are floored at 0."""
    first = nearest(df, id_col, vector_col, [query], factor * k)
    kept = df.where(where).select(F.col(id_col).alias("id"))
    return first.join(kept, "id", "left_semi").select("id", F.greatest(F.lit(0.0), "distance").alias("distance")).orderBy("distance", "id").limit(k)


def mean_vectors(df: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """(group, centroid, n): the normalised mean of the unit vectors of each group, summed by dimension before the
    shuffle, so a group of any size is only its partial sums."""
    unit = df.where(F.col(vector_col).isNotNull()).withColumn("_norm", F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).where("_norm > 0")
    parts = unit.select(F.col(group_col).alias("group"), "_norm", F.posexplode(vector_col).alias("pos", "x")).groupBy("group", "pos").agg(F.avg(F.col("x").cast("double") / F.col("_norm")).alias("m"), F.count("*").alias("n"))
    arrays = parts.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("a"), F.max("n").alias("n"))
    raw = F.transform("a", lambda e: e["m"])
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return arrays.select("group", F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("centroid"), "n")


#: Centroids or concepts that are sent to the tasks at once; more lie in the shared folder in blocks of about this size.
CLASS_BLOCK = 4096


def _against(df: DataFrame, id_col: str, vector_col: str, classes: DataFrame, keep: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, key, similarity) of the pairs that ``keep`` picks from each block's matrix of cosines; classes: (key,
    centroid). The classes are a query set: rows are read once and meet them block by block as matrix products."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    schema = T.StructType([rows.schema["id"], classes.schema["key"], T.StructField("similarity", T.DoubleType())])
    known = classes.select("key", F.col("centroid").cast("array<double>").alias("centroid")).where("centroid is not null and size(centroid) > 0")
    blocks = max(1, math.ceil(known.count() / (0.9 * CLASS_BLOCK)))

    def sizes(part: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
        part = part.sort_values("key")
        by = part["centroid"].map(len)
        out = []
        for size in by.unique():
            x = np.stack(part["centroid"][by == size].to_numpy()).astype(float)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            out.append((size, part["key"][by == size].to_numpy(), x / np.where(norm == 0, 1.0, norm)))
        return out

    if blocks == 1:
        sent = [sizes(known.toPandas())]  # one block
        read = lambda: sent
    else:
        _, frames = stored_blocks(known, blocks)
        read = lambda: map(sizes, frames())

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            long = b["v"].map(len)
            for block in read():
                for size, keys, centroids in block:
                    own = b[long == size]
                    if len(own):
                        x = np.stack(own["v"].to_numpy())
                        norm = np.linalg.norm(x, axis=1, keepdims=True)
                        x = x / np.where(norm == 0, 1.0, norm)
                        i, j = keep(x @ centroids.T)
                        yield pd.DataFrame({"id": own["id"].to_numpy()[i], "key": keys[j], "similarity": np.einsum("nd,nd->n", x[i], centroids[j])})

    return rows.mapInPandas(meet, schema)


def closest_centroid(df: DataFrame, id_col: str, vector_col: str, centroids: DataFrame, key_col: str = "group") -> DataFrame:
    """(id, key, similarity): the most similar centroid of each row; ties go to the smaller key."""
    classes = centroids.select(F.col(key_col).alias("key"), "centroid")
    best = _against(df, id_col, vector_col, classes, lambda s: (np.arange(len(s)), np.argmax(s, axis=1)))
    best = best.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "key")).alias("s"))
    return best.select("id", F.col("s.key").alias("key"), (-F.col("s.d")).alias("similarity"))


def absorb(clusters: DataFrame, threshold: float = 0.5, most: int | None = 200) -> DataFrame:
    """(from_id, into_id, similarity): unnamed clusters that a named one absorbs, against centroids as they were at the
    start; ``clusters`` has id, named, centroid. The best ``most`` go."""
    named = clusters.where("named").select(F.col("id").alias("group"), "centroid")
    found = closest_centroid(clusters.where("not named"), "id", "centroid", named).where(F.col("similarity") >= threshold)
    found = found.select(F.col("id").alias("from_id"), F.col("key").alias("into_id"), "similarity")
    return found if most is None else found.orderBy(F.desc("similarity"), "from_id").limit(most)


def cluster_online(df: DataFrame, shard_col: str, order_col: str, vector_col: str, threshold: float = 0.363) -> DataFrame:
    """(shard, id, cluster): each vector joins the best running centroid of its shard or founds a cluster, in order.

    The rule depends on order, so a shard is worked through by one task; shards are independent libraries.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        centroids = np.zeros((64, len(group["v"].iloc[0])))
        n, counts, out = 0, [], []
        for v in group["v"]:
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0)
            sims = centroids[:n] @ v
            best = int(np.argmax(sims)) if n else -1
            if best >= 0 and sims[best] >= threshold:
                counts[best] += 1
                c = (centroids[best] * (counts[best] - 1) + v) / counts[best]
                centroids[best] = c / (np.linalg.norm(c) or 1.0)
            else:
                if n == len(centroids):
                    centroids = np.vstack([centroids, np.zeros_like(centroids)])
                centroids[n], best = v, n
                counts.append(1)
                n += 1
            out.append(best + 1)
        return pd.DataFrame({"shard": key[0], "id": group["id"], "cluster": [f"person-{c:06d}" for c in out]})

    rows = df.select(F.col(shard_col).cast("string").alias("shard"), F.col(order_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("shard is not null and v is not null and size(v) > 0")
    return rows.groupBy("shard").applyInPandas(run, "shard string, id long, cluster string")


def concepts(df: DataFrame, id_col: str, vector_col: str, concept_rows: DataFrame, keep: int = 5) -> DataFrame:
    """(id, concept, similarity): the best concepts of each row at or above the concept's own threshold."""
    classes = concept_rows.select(F.col("concept").alias("key"), "centroid")
    least = concept_rows.agg(F.min("threshold")).first()[0]
    pairs = _against(df, id_col, vector_col, classes, lambda s: np.nonzero(s >= (least or 0.0)))
    pairs = pairs.join(concept_rows.select(F.col("concept").alias("key"), "threshold"), "key").where(F.col("similarity") >= F.col("threshold"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "key")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).select("id", F.col("key").alias("concept"), "similarity")
