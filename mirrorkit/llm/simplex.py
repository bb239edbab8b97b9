"""Integer centroid clustering with candidates filtered by an n-simplex projection.

A few vectors are pivots. Their distances to one another fix a simplex, and the distances of any vector
to them fix one more corner, its apex: as many coordinates as there are pivots, of which the last is the
height above the pivots' plane. For two apexes, the Euclidean distance is a lower bound of the distance
of the vectors, and the one with the second height mirrored is an upper bound. Vectors do not move, so
their distances to the pivots are computed once and kept with them. In each round, a centroid whose lower
bound exceeds a vector's least upper bound is out; the others are compared by exact integer distances.
The bounds carry a slack for rounding, so they decide what is computed and never what is nearest.

A round is one pass without a shuffle of vectors: a task adds up its vectors by centroid and returns one
row per centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import small_batches
from mirrorkit.session import stored

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
PIVOTS = 8
SEED = 1
# Scaled components are held to this magnitude, so squared distances of 64 components fit 63 bits.
LIMIT = 1 << 27
# Part of a squared distance that rounding may take, and least height of a pivot over those before it.
SLACK = 1e-6
FLAT = 1e-2


# --- projection ----------------------------------------------------------------------------------------


class Simplex:
    """The pivots' simplex: turns squared distances to the pivots into apex coordinates."""

    def __init__(self, pivots: np.ndarray) -> None:
        """``pivots`` has one row of integers per pivot; those that lie close to the plane of others before are left out."""
        self.base: list[np.ndarray] = []
        chosen: list[np.ndarray] = []
        for row in pivots:
            apex = self._apex(np.array([[_squared(row, p) for p in chosen]], dtype=float).reshape(1, -1))[0]
            if not chosen or apex[-1] > FLAT * (1.0 + np.abs(apex).max()):
                self.base.append(apex)
                chosen.append(row)
        self.pivots = np.array(chosen, dtype=np.int64).reshape(len(chosen), pivots.shape[1])

    def _apex(self, squares: np.ndarray) -> np.ndarray:
        """Apexes (n x k) of points with these squared distances (n x k) to the first k pivots.

        Pivot i has i coordinates, the last of them its height above those before it. The equations of two
        pivots differ by a linear one, so coordinates follow one by one; the height is what is left.
        """
        n, k = squares.shape
        out = np.zeros((n, k))
        if not k:
            return out
        for i in range(1, k):
            corner = self.base[i]
            # |x|^2 - |x - corner|^2 = 2 x.corner - |corner|^2, where the first pivot lies at the origin.
            dot = (squares[:, 0] - squares[:, i] + float(corner @ corner)) / 2
            out[:, i - 1] = (dot - out[:, :i - 1] @ corner[:-1]) / corner[-1]
        out[:, k - 1] = np.sqrt(np.maximum(squares[:, 0] - (out[:, :k - 1] ** 2).sum(axis=1), 0.0))
        return out

    def apex(self, squares: np.ndarray) -> np.ndarray:
        return self._apex(np.asarray(squares, dtype=float))


def _squared(a: np.ndarray, b: np.ndarray) -> int:
    d = a.astype(np.int64) - b.astype(np.int64)
    return int((d * d).sum())


def squares_to(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centers."""
    out = np.empty((len(points), len(centers)), dtype=np.int64)
    for j, center in enumerate(centers):
        d = points - center
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def bounds(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds, points x centers, from their apexes."""
    low = np.zeros((len(points), len(centers)))
    for i in range(points.shape[1] - 1):
        low += (points[:, i, None] - centers[None, :, i]) ** 2
    a, b = points[:, -1, None], centers[None, :, -1]
    return low + (a - b) ** 2, low + (a + b) ** 2


def nearest(points: np.ndarray, squares: np.ndarray, centers: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest center, squared distance, exact comparisons made); ties go to the smaller number."""
    best = np.full(len(points), -1, dtype=np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max, dtype=np.int64)
    low, high = bounds(simplex.apex(squares), simplex.apex(squares_to(centers, simplex.pivots)))
    reach = high.min(axis=1)
    # Rounding errors are relative to the squared distances that the coordinates came from.
    slack = SLACK * (1.0 + squares.max(axis=1) + float(squares_to(centers, simplex.pivots).max()))
    made = 0
    for j in range(len(centers)):
        # A center must also beat the exact distance that an earlier one has reached.
        rows = np.flatnonzero((low[:, j] <= reach + slack) & (low[:, j] - slack <= least))
        made += len(rows)
        d = points[rows] - centers[j]
        exact = np.einsum("ij,ij->i", d, d)
        closer = exact < least[rows]
        best[rows[closer]], least[rows[closer]] = j, exact[closer]
    return best, least, made


# --- distributed rounds --------------------------------------------------------------------------------


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors with ``DIMS`` components, all finite, as integers floor(``SCALE`` * x).

    Vectors that are null, of another length, or hold a null or a number that is not finite are left out.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == DIMS)
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = F.lit(float(LIMIT))
    whole = F.transform("x", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, bound), -bound)), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return rows.filter(ok).select("vec_id", whole.alias("v"))


def _first_by_hash(rows: DataFrame, seed: int, n: int) -> np.ndarray:
    """The ``n`` vectors whose ids have the smallest hashes under a seed, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(n).collect()
    return np.array([row.v for row in drawn], dtype=np.int64).reshape(-1, DIMS)


def _cached(batches, simplex):
    """Vectors with their squared distances to the pivots."""
    import pyarrow as pa

    simplex = simplex.value
    k = len(simplex.pivots)
    for batch in batches:
        squares = squares_to(_matrix(batch.column("v"), DIMS).astype(np.int64), simplex.pivots)
        offsets = pa.array(np.arange(0, k * (len(squares) + 1), k, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(squares.ravel()))], names=["vec_id", "v", "squares"],
        )


def _batches(batches, shared):
    """(batch, points, number, distance) of each batch, by the centers at hand."""
    simplex, centers = shared.value
    for batch in batches:
        if batch.num_rows:
            points = _matrix(batch.column("v"), DIMS).astype(np.int64)
            number, distance, _ = nearest(points, _matrix(batch.column("squares"), len(simplex.pivots)), centers, simplex)
            yield batch, points, number, distance


def _summed(batches, shared):
    """One row per center that got a vector in this task: number, count, sums."""
    import pyarrow as pa

    k = len(shared.value[1])
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, DIMS), dtype=np.int64)
    for _, points, number, _ in _batches(batches, shared):
        counts += np.bincount(number, minlength=k)
        for j in np.unique(number):
            sums[j] += points[number == j].sum(axis=0)
    own = np.flatnonzero(counts)
    offsets = pa.array(np.arange(0, DIMS * (len(own) + 1), DIMS, dtype=np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array(counts[own]), pa.ListArray.from_arrays(offsets, pa.array(sums[own].ravel()))], names=["cluster", "n", "sums"],
    )


def _assigned(batches, shared):
    import pyarrow as pa

    for batch, _, number, distance in _batches(batches, shared):
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"],
        )


def _moved(rows: DataFrame, simplex: Simplex, centers: np.ndarray) -> np.ndarray:
    """The centers after one round; a center without vectors stays."""
    shared = rows.sparkSession.sparkContext.broadcast((simplex, centers))
    parts = rows.mapInArrow(lambda batches: _summed(batches, shared), "cluster long, n long, sums array<long>")
    # Sums of tasks are added as decimals: they cannot overflow.
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMS)],
    )
    out = centers.copy()
    for row in totals.collect():  # one row per center
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(DIMS)]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(rows ``vec_id, cluster, distance``, centers): stored assignments after ``rounds`` rounds.

    Needs ``vec_id`` and ``embedding``; other columns are ignored. Vectors that :func:`integer_vectors`
    leaves out give no row. With fewer than ``k`` vectors there are as many centers as vectors; with none,
    no rows. Equal vectors get equal answers, repeated rows each their own; a null id counts as an empty
    one when the first centers are drawn. Scaled components are held to +-2^27, which no vector reaches
    whose components are below two million.
    """
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    rows = integer_vectors(vectors)
    centers = _first_by_hash(rows, seed, k)
    simplex = Simplex(_first_by_hash(rows, seed + 1, n_pivots))
    schema = "vec_id long, cluster int, distance long"
    if not len(centers):
        return spark.createDataFrame([], schema), centers
    fixed = spark.sparkContext.broadcast(simplex)
    cached = stored(rows.mapInArrow(lambda batches: _cached(batches, fixed), "vec_id long, v array<int>, squares array<long>"), "simplex-vectors")
    for _ in range(rounds):
        centers = _moved(cached, simplex, centers)
    shared = spark.sparkContext.broadcast((simplex, centers))
    return stored(cached.mapInArrow(lambda batches: _assigned(batches, shared), schema), "simplex-clusters"), centers


def cluster_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector."""
    rows, centers = cluster(vectors)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()  # one row per center
    most = np.iinfo(np.int64).max
    inertia = {row.cluster: int(row.inertia) for row in sums}
    total = min(sum(inertia.values()), most)
    facts = [
        (j, min(own, most), total, hashlib.sha256(",".join(map(str, centers[j].tolist())).encode()).hexdigest()) for j, own in inertia.items()
    ]
    told = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql() -> str:
    """The same rows in SQL: a pair of common table expressions for each round."""
    square = "list_sum(list_transform(list_zip(v, c), lambda z: cast(z[1] - z[2] as bigint) * (z[1] - z[2])))"
    near = (
        "a{r} as (select vec_id, v, cluster, distance from (select vec_id, v, cluster, {square} as distance, "
        "row_number() over (partition by vec_id order by {square}, cluster) as nth from k, c{r}) where nth = 1)"
    )
    mean = (
        "m{n} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from "
        "(select cluster, i, sum(cast(v[i] as hugeint)) as s, cast(count(*) as hugeint) as n "
        f"from a{{r}}, (select unnest(range(1, {DIMS + 1})) as i) group by cluster, i) group by cluster), "
        "c{n} as (select c{r}.cluster, coalesce(m{n}.c, c{r}.c) as c from c{r} left join m{n} using (cluster))"
    )
    parts = [
        f"k as (select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v "
        f"from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS})",
        f"c0 as (select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as cluster, v as c from k "
        f"order by sha256('{SEED}:' || vec_id) limit {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts += [near.format(r=r, square=square), mean.format(r=r, n=r + 1)]
    parts.append(near.format(r=ROUNDS, square=square))
    return (
        "with " + ",\n".join(parts) + "\nselect vec_id, cast(a.cluster as integer) as cluster, cast(distance as bigint) as distance, "
        "cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, "
        f"sha256(array_to_string(c.c, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on a.cluster = c.cluster"
    )


CLUSTERS_SQL = _clusters_sql()
