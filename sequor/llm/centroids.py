"""Centroid clustering of vectors by exact integer rounds.

Vectors become integers and travel as blocks of rows.  A block's squared
distances come from one matrix product, ``|x|^2 - 2 x.c + |c|^2`` in float64
BLAS, which is exact while every partial sum stays under 2**53; a block whose
magnitudes could pass that is computed in int64, and beyond 2**63 in Python
integers, so results never depend on rounding.  Each round is one
``treeAggregate`` over the blocks: what meets in a task, and in the driver, is
``k`` sums of ``dim`` integers whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.operators.storage import materialize

#: Vectors of a block: a block of 64 doubles is 2 MB, its distances to 16 centroids half a MB.
BLOCK_ROWS = 4096
_EXACT = 1 << 53
_WIDE = 1 << 63
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _floors(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` as doubles, and where the product passes all doubles: there stands ``x``, itself an integer."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    far = ~np.isfinite(q)
    return np.where(far, x, q), far


def _integers(q: np.ndarray, far: np.ndarray, scale: int) -> np.ndarray:
    """The block as doubles that are integers, or as Python integers where some are no doubles."""
    if not far.any():
        return q
    whole = np.array([int(v) for v in q.ravel()], dtype=object)
    whole[far.ravel()] *= scale
    return whole.reshape(q.shape)


def _blocks(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                q, far = _floors(x, scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                row = [ids, pa.array([q.tobytes()], pa.binary()), pa.array([far.tobytes() if far.any() else None], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["ids", "q", "far"])

    return run


def _loaded(q: bytes, far: bytes | None, dim: int, scale: int) -> np.ndarray:
    block = np.frombuffer(q, np.float64).reshape(-1, dim)
    if far is None:
        return block
    return _integers(block, np.frombuffer(far, bool).reshape(-1, dim), scale)


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _exact_type(bound: int):
    return np.float64 if bound < _EXACT else np.int64 if bound < _WIDE else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return x.astype(kind)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and its squared distance, exactly.

    No term nor partial sum of the expansion passes ``dim * (max|x| + max|c|)**2``.
    """
    kind = _exact_type(x.shape[1] * (_most(x) + _most(centroids)) ** 2)
    x, c = _as(x, kind), _as(centroids, kind)
    apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    who = apart.argmin(axis=1)
    return who, apart[np.arange(len(x)), who]


def sums(x: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the rows of each cluster, as Python integers."""
    kind = _exact_type(max(1, len(x)) * _most(x))
    member = (who[None, :] == np.arange(k)[:, None]).astype(kind)
    out = member @ _as(x, kind)
    return _as(out, object)


def _partial(dim: int, scale: int, centroids: np.ndarray):
    """``(sums, counts, inertia)`` of a block; the adding of two such is associative and exact."""
    k = len(centroids)

    def of(row) -> tuple:
        x = _loaded(row.q, row.far, dim, scale)
        who, apart = nearest(x, centroids)
        inertia = [0] * k
        for j in range(k):
            inertia[j] = sum(int(v) for v in apart[who == j])
        return sums(x, who, k), np.bincount(who, minlength=k), np.array(inertia, dtype=object)

    return of


def _added(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))


def _round(blocks: DataFrame, dim: int, scale: int, centroids: np.ndarray) -> tuple:
    of = _partial(dim, scale, centroids)
    return blocks.select("q", "far").rdd.treeAggregate(None, lambda acc, row: _added(acc, of(row)), _added, 2)


def _assigned(dim: int, scale: int, centroids: np.ndarray, inertia: list[int], digests: list[str]):
    top = _WIDE - 1
    total = min(top, sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                q, far = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                who, apart = nearest(_loaded(q, far, dim, scale), centroids)
                own = who.tolist()
                columns = [ids, pa.array(own, pa.int32()), pa.array([min(top, int(v)) for v in apart], pa.int64())]
                columns += [pa.array([min(top, inertia[j]) for j in own], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([digests[j] for j in own])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null, NaN or infinite;
    component ``x`` counts as the integer ``floor(scale * x)``.  Centroids start
    as the ``k`` kept vectors of smallest sha256 of ``seed:id`` (equal ids: by
    their components; a null id hashes as ``null``), fewer where there are
    fewer.  A round assigns each vector to the nearest centroid (ties: the
    smaller number) and replaces each centroid that has vectors by the floor of
    their mean; others stay.  After the rounds vectors are assigned once more.
    Repeated rows count and are returned as often as they stand; distances and
    inertias over 2**63 - 1 are returned as that, though all comparisons are
    exact.  Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & F.coalesce(finite, F.lit(False)))
    blocks = materialize(kept.mapInArrow(_blocks(dim, scale), "ids array<long>, q binary, far binary"), "blocks")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = [r.v for r in kept.orderBy(order, "v").limit(k).select("v").collect()]
    if not first:
        return spark.createDataFrame([], _RESULT)
    x = np.array(first, dtype=np.float64)
    centroids = _as(_integers(*_floors(x, scale), scale), object)
    for _ in range(rounds):
        total, count, _ = _round(blocks, dim, scale, centroids)
        centroids = np.array([[s // int(n) for s in row] if n else list(old) for row, n, old in zip(total, count, centroids)], dtype=object)
    inertia = _round(blocks, dim, scale, centroids)[2]
    digests = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centroids]
    return blocks.mapInArrow(_assigned(dim, scale, centroids, [int(v) for v in inertia], digests), _RESULT)
