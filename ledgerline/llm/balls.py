"""Ball k-means, exact over integers.

Vectors become integers, so that distances and centroids are exact and don't depend on the order of summation.

A cluster is a ball: its centroid and the largest distance of a member.  When the centroid moves, the ball's radius
grows by the distance moved at most, so the driver knows a bound of each radius before it looks at any vector.  Only
centroids nearer than twice the radius can take a member away: the ball's neighbours, in order of distance.  A
member whose distance to its own centroid is less than half of that of the nearest neighbour lies in the stable core
and is compared with none; the others lie in annuli: in the one between the j-th and the (j+1)-th half distance only the
first j neighbours are compared.  All tests are done in whole numbers, so the result is that of plain k-means.

A round is one pass over the vectors and makes the next state (vectors with their cluster) and the sums of each cluster
at once.  The state is a narrow function of the state before and of the centroids, kept in the executors' caches:
nothing is shuffled but sums (clusters times components rows from each task), and a lost executor's part is made
anew from the vectors.  The driver holds k centroids and k * k distances, nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, own_columns
from ledgerline.llm.vectors import finite

#: Clusters, rounds, components, scale and seed of the contract.
CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Rounds after which the lineage is cut.
CUT = 16
#: Largest magnitude of a scaled component: sums of squares of differences stay below 2^61.
LARGEST = 1 << 25


def scaled(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor(scale * x) of each component) of the vectors that take part.

    Vectors that are null, have another number of components, or have null or non-finite ones take no part, nor do
    those with a scaled component of 2^25 or more, whose distances would not fit a long.  Rows with a null id take part.
    """
    rows = own_columns(vectors, ["vec_id", "embedding"]).withColumn("x", F.col("embedding").cast("array<double>"))
    rows = rows.filter((F.size("x") == components) & finite(F.col("x")) & ~F.exists("x", lambda c: F.abs(c) * scale >= LARGEST))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id, in that order; repeated ids in the order of their vectors."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.orderBy(rank, "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _squares(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = rows - centre
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids with their mutual squared distances, and of each ball the neighbours that can take a member away."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray | None):
        """``radii``: bounds of the distances of members to these centroids; None if nothing is assigned yet."""
        self.centroids, k = centroids, len(centroids)
        self.gaps = np.stack([_squares(centroids, c) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        self.neighbours = []
        for i in range(k):
            near = np.argsort(self.gaps[i], kind="stable")
            near = near[near != i]
            # The radius is rounded; a little slack keeps all that matter.
            self.neighbours.append(near if radii is None else near[np.sqrt(self.gaps[i][near].astype(float)) <= 2 * radii[i] * (1 + 1e-9) + 1e-6])

    def assign(self, rows: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, number of distances computed) of each row; ties go to the smaller number."""
        own = np.zeros(len(rows), np.int64) if cluster is None else cluster
        new, best, work = own.copy(), np.empty(len(rows), np.int64), len(rows)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.centroids) + 1))
        for i in range(len(self.centroids)):
            members = order[edges[i] : edges[i + 1]]
            if not len(members):
                continue
            inside = rows[members]
            home = _squares(inside, self.centroids[i])
            nearest, label = home.copy(), np.full(len(members), i)
            for j in self.neighbours[i].tolist():
                # Beyond half the way to neighbour j; the neighbours after it are farther, so their annuli lie inside.
                ring = np.flatnonzero(4 * home >= self.gaps[i, j])
                if not len(ring):
                    break
                there, work = _squares(inside[ring], self.centroids[j]), work + len(ring)
                won = (there < nearest[ring]) | ((there == nearest[ring]) & (j < label[ring]))
                nearest[ring[won]], label[ring[won]] = there[won], j
            new[members], best[members] = label, nearest
        return new, best, work


def _passed(state: DataFrame, balls: Balls, d: int, fresh: bool) -> DataFrame:
    """The next state (vec_id, v, cluster, distance) of a state."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, d).astype(np.int64)
            cluster, best, _ = balls.assign(rows, None if fresh else batch.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "v", "cluster", "distance"])

    return state.mapInArrow(work, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, v binary, cluster int, distance long")


def _sums(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, component sums, largest squared distance) of each cluster; k * (d + 1) rows come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, most = np.zeros((k, d + 1), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, d).astype(np.int64)
            cluster = batch.column(2).to_numpy()
            np.maximum.at(most, cluster, batch.column(3).to_numpy())
            totals[:, d] += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                totals[c, :d] += rows[cluster == c].sum(axis=0)
        full = np.flatnonzero(totals[:, d])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, d + 1).astype(np.int32)), pa.array(np.tile(np.arange(d + 1, dtype=np.int32), len(full))), pa.array(totals[full].reshape(-1)), pa.array(np.repeat(most[full], d + 1))],
            names=["cluster", "place", "total", "most"],
        )

    # As decimals: sums over very many vectors may leave the longs.
    found = state.mapInArrow(work, "cluster int, place int, total long, most long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")).collect()
    counts, totals, most = [0] * k, np.zeros((k, d), object), np.zeros(k, np.int64)
    for r in found:
        if r["place"] == d:
            counts[r["cluster"]], most[r["cluster"]] = int(r["total"]), r["most"]
        else:
            totals[r["cluster"], r["place"]] = int(r["total"])
    return np.array(counts, object), totals, most


def _moved(centroids: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floors of the means; empty clusters keep their centroid."""
    out = centroids.copy()
    for c in range(len(centroids)):
        if counts[c]:
            out[c] = [int(t) // int(counts[c]) for t in totals[c]]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector that takes part (``scaled``): vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Defined results: with fewer than k vectors each is a first centroid; repeated rows come back as often; of equally
    near centroids the smaller number counts; an empty table gives no rows; further columns are not looked at.
    """
    exact = scaled(vectors, components, scale)
    # A long is more than a component needs: four bytes each, packed.
    packed = exact.select("vec_id", "v").mapInArrow(_packed(components), f"vec_id {exact.schema['vec_id'].dataType.simpleString()}, v binary")
    state, kept = packed.persist(StorageLevel.MEMORY_AND_DISK), []
    centroids = first_centroids(exact, k, seed)
    k = len(centroids)
    fresh, radii, made = True, None, state
    for step in range(rounds if k else 0):
        made = _passed(state, Balls(centroids, radii), components, fresh)
        made = durable(made) if step % CUT == CUT - 1 else made.persist(StorageLevel.MEMORY_AND_DISK)
        counts, totals, most = _sums(made, k, components)
        new = _moved(centroids, counts, totals)
        radii = np.sqrt(most.astype(float)) + np.sqrt(np.array([float(_squares(new[c : c + 1], centroids[c])[0]) for c in range(k)]))
        # Two states are kept: should a part of the new one be lost, the one before makes it anew.
        kept.append(state)
        if len(kept) > 1:
            kept.pop(0).unpersist()
        state, centroids, fresh = made, new, False
    if not k:
        state.unpersist()
        return exact.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    last = durable(_passed(state, Balls(centroids, radii), components, fresh).drop("v"))
    for old in [*kept, state]:
        old.unpersist()
    own = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    place = F.col("cluster") + 1
    return last.select(
        "vec_id", "cluster", "distance", F.element_at(_literals([own.get(c, 0) for c in range(k)]), place).alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(x) for x in digests]), place).alias("centroid_sha256"),
    )


def _literals(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def _packed(d: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, d).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "v"])

    return work
