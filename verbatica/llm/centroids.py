"""Centroid clustering by a bisector tournament, in integers throughout.

A vector's components become integers, floor(``SCALE`` * x).  For two centroids a < b the vector x is nearer to b exactly if
x . 2 (b - a) > b . b - a . a: a linear test whose normal and threshold are computed once a round for all pairs.  For each vector centroid 0
meets 1, the nearer of them meets 2, and so on; k - 1 sign tests leave the nearest one, and as a test that gives zero favours the smaller number,
so does a tie.  Only the winner's distance is computed.

The centroids start as the vectors whose key hashes lowest and move to the floor of their vectors' mean in each round.  A task adds up its vectors
by centroid, so at most tasks x centroids rows of sums are shuffled, whatever the size of a cluster or of a group of copies.  The sums are exact
at any size: they travel in limbs of ``LIMB`` bits.  Centroids and their pairs (k * k * components integers) are bounded by the parameter k; the driver
holds nothing that grows with the vectors.

Kept are the vectors with exactly ``DIM`` components, none null, infinite or not a number; a null vector, like any other that is not kept, gives no
row.  Rows that repeat a key are vectors of their own; those whose hashes tie are taken in the order of their components, a null key last.  With fewer
than k vectors there are as many centroids as vectors; an empty table gives no row.  Integers too large for 64 bits are reckoned at full length; only
where a distance itself passes 2**63 - 1 is that number reported instead, and sums of such distances may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import cut, table

CENTROIDS, ROUNDS, SCALE, DIM, SEED = 40, 5, 256, 64, 2
#: Bits of a limb, and limbs kept apart for a component.
LIMB, LIMBS = 32, 40
#: Components up to this size leave every sum and product of a test within 64 bits.
SMALL = 1 << 26
#: Vectors that are compared at once.
BLOCK = 2048
_MOST = (1 << 63) - 1


def kept(rows: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(key, x): the vectors with dim components, all finite, as doubles."""
    def fits(v: F.Column) -> F.Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    x = F.col(vector).cast("array<double>")
    return rows.select(F.col(key), x.alias("x")).where((F.size("x") == dim) & F.forall("x", fits))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value), as 64-bit integers or, where one is large, as Python's."""
    scaled = np.floor(values * scale)
    if not len(scaled) or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(np.floor(v * scale)) if abs(v) < 1e300 else int(v) * scale for v in values.ravel().tolist()]
    return out


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, object).reshape(len(centroids), -1)
        self.small = bool(all(abs(v) <= SMALL for v in c.ravel()))
        self.centroids = c.astype(np.int64) if self.small else c
        self.normal = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        square = (self.centroids * self.centroids).sum(axis=1)
        self.threshold = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance."""
        winner, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        exact = x.dtype != object and self.small
        for at in range(0, len(x), BLOCK):
            part, best = x[at : at + BLOCK], winner[at : at + BLOCK]
            for challenger in range(1, len(self.centroids)):
                normal, threshold = self.normal[best, challenger], self.threshold[best, challenger]
                side = (np.einsum("ij,ij->i", part, normal) if exact else (part * normal).sum(axis=1)) - threshold
                best[side > 0] = challenger
            away = part - self.centroids[best]
            far = (away * away).sum(axis=1)
            distance[at : at + BLOCK] = far if exact else np.array([min(int(d), _MOST) for d in far], np.int64)
        return winner, distance


@lru_cache(maxsize=1)
def _bisectors(centroids: tuple[tuple[int, ...], ...]) -> Bisectors:
    return Bisectors([list(c) for c in centroids])


def _vectors(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    column = batch.column(1)
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), scale)


def limbs(total: int) -> list[tuple[int, int]]:
    """(place, limb) with the sum of limb << LIMB * place equal to total; all but the last are not negative."""
    out, place = [], 0
    while not -(1 << (LIMB - 1)) <= total < 1 << (LIMB - 1):
        out.append((place, total & ((1 << LIMB) - 1)))
        total >>= LIMB
        place += 1
    return [*out, (place, total)]


def _sums(centroids: tuple[tuple[int, ...], ...], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = _bisectors(centroids)
        total = np.zeros((len(centroids), len(centroids[0])), object)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, scale)
            cluster, _ = bisectors.nearest(x)
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            total[there] += np.add.reduceat(x[order], first, axis=0).astype(object)
            count += np.bincount(cluster, minlength=len(centroids))
        rows = [(c, LIMBS * d + place, limb) for c in np.flatnonzero(count).tolist() for d, t in enumerate(total[c]) for place, limb in limbs(int(t))]
        rows += [(c, -1, int(count[c])) for c in np.flatnonzero(count).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "part"])

    return run


def _assigned(centroids: tuple[tuple[int, ...], ...], scale: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = _bisectors(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = bisectors.nearest(_vectors(batch, scale))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[key, "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, key: str, k: int = CENTROIDS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The k vectors whose keys hash lowest, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), F.transform("x", lambda v: F.floor(v * scale))).limit(k).collect()
    return [whole(np.array([r["x"]]), scale)[0].tolist() for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    found = vectors.mapInArrow(_sums(tuple(map(tuple, centroids)), scale), "cluster int, place int, part long").groupBy("cluster", "place").agg(F.sum("part").alias("part")).collect()
    count = {r["cluster"]: r["part"] for r in found if r["place"] < 0}
    total = {c: [0] * len(centroids[c]) for c in count}
    for r in found:
        if r["place"] >= 0:
            total[r["cluster"]][r["place"] // LIMBS] += r["part"] << (LIMB * (r["place"] % LIMBS))
    return [[t // count[c] for t in total[c]] if c in count else old for c, old in enumerate(centroids)]


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
              scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """(key, cluster, distance, centroid) of every kept vector of rows after so many rounds; centroid lists its final components as decimals."""
    vectors = kept(rows, key, vector, dim)
    kind = rows.select(key).schema[0].dataType.simpleString()
    centroids = first_centroids(vectors, key, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, scale)
    named = rows.sparkSession.createDataFrame([(c, list(map(str, components))) for c, components in enumerate(centroids)], "cluster int, centroid array<string>")
    if not centroids:
        return vectors.select(key, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("array<string>").alias("centroid")).limit(0)
    found = vectors.mapInArrow(_assigned(tuple(map(tuple, centroids)), scale, key), f"`{key}` {kind}, cluster int, distance long")
    return found.join(F.broadcast(named), "cluster").select(key, "cluster", "distance", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ","), 256)
    found = cut(found.select("vec_id", "cluster", "distance", digest.alias("centroid_sha256")), "assigned")
    by_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid
    inertia = sum(r["cluster_inertia"] for r in by_cluster) if all(r["cluster_inertia"] is not None for r in by_cluster) else None
    sums = spark.createDataFrame([tuple(r) for r in by_cluster], "cluster int, cluster_inertia long")
    return (found.join(F.broadcast(sums), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia if inertia is None or inertia <= _MOST else None).cast("long").alias("inertia"), "centroid_sha256"))


def _round(number: int) -> str:
    """SQL of the vectors' nearest centroids in c<number>, as a<number>."""
    return f"""
a{number} as materialized (select v.row, v.vec_id, v.x, min((list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c)) as best
       from v cross join c{number} c group by all)"""


_DIFF = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
_MOVES = ",".join(f"""{_round(i)},
u{i} as (select (best)[2] as c, unnest(x) as x, unnest(range({DIM})) as d from a{i}),
m{i} as (select c, d, ({_DIFF})::bigint as x from u{i} group by c, d),
g{i} as (select c, list(x order by d) as x from m{i} group by c),
c{i + 1} as materialized (select o.c, coalesce(g.x, o.x) as x from c{i} o left join g{i} g on g.c = o.c)""" for i in range(ROUNDS))
ORACLE = f"""
with e as (select vec_id, embedding::double[] as q from embeddings where len(embedding) = {DIM}),
f as (select vec_id, q from e where len(list_filter(q, lambda t: t is not null and isfinite(t))) = {DIM}),
v as materialized (select row_number() over () as row, vec_id, list_transform(q, lambda t: floor({SCALE} * t)::bigint) as x from f),
c0 as materialized (select (row_number() over (order by sha256('{SEED}:' || vec_id::varchar), x))::int - 1 as c, x from v order by c limit {CENTROIDS}),
{_MOVES},
{_round(ROUNDS)},
z as (select vec_id, (best)[2] as c, (best)[1]::bigint as distance from a{ROUNDS})
select vec_id, z.c::int as cluster, distance, (sum(distance) over (partition by z.c))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(k.x, ',')) as centroid_sha256 from z join c{ROUNDS} k on k.c = z.c
"""

QUERIES = {"op11_centroid_clusters": (query, ORACLE)}
