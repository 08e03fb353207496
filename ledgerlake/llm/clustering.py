"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

Every vector has an upper bound of the distance to its own centroid and a
lower bound of that to any other. While the gap between them is positive,
the vector can't change its cluster. Centroids that move make gaps shrink
by at most (own drift + largest other drift), the same for all vectors of a
cluster: so a gap is stored once, offset by its cluster's drift so far, and
it expires when the accumulated drift reaches it. Each cluster keeps these
expiries in a heap; a round pops only what has expired, scans those vectors
against all centroids and pushes them onto the heap of the cluster that is
nearest now. Centroids follow from sums that only moved vectors change.

On Spark: vectors become integers once and are packed into blocks, a table
bucketed by block, so that no round shuffles them again. A block has one
small heap for each cluster; heaps travel as a table of their own (12 bytes
a vector) that is written in every round and joined with the blocks that
have an expired top; other blocks are not scanned. The driver holds the
centroids and the sums of moved vectors (k x components numbers).

Results are exact: distances are squared integers, bounds are floats that
are shrunk by more than their rounding errors, and a vector whose gap may
have gone is scanned exactly. Ties go to the smaller centroid number.

Defined results: vectors that are null, of another length, or with a null
or non-finite component are left out; a component of 2^27 or more after
scaling stops the job with a message, as squared distances would leave a
``long``; rows with equal ids or vectors are vectors of their own, and as
first centroids they are taken in the order of their values, null ids last;
with fewer vectors than ``k`` there are fewer centroids; without any, the
result is empty; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import shuffle_partitions
from ledgerlake.session import shared_dir

SEED = "3"
#: Vectors of one block.
BLOCK_ROWS = 2048
#: Bytes of vectors in one bucket, about.
BUCKET_BYTES = 64 << 20
MAX_BUCKETS = 100_000
LIMIT = 1 << 27
#: Up to here float64 holds every product and sum of a distance exactly.
_EXACT = 1 << 22
#: Bounds are shrunk by this share: far more than float64 rounds away.
_SLACK = 1e-9

_BLOCKS = "block long, ids array<bigint>, width int, data binary"
_HEAPS = "block long, tops array<double>, sizes array<int>, keys binary, members binary, moved array<bigint>"
_HEAPS_ARROW = pa.schema(
    [("block", pa.int64()), ("tops", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("members", pa.binary()), ("moved", pa.list_(pa.int64()))]
)
_ASSIGNED = "id long, cluster int, distance long"
_ASSIGNED_ARROW = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
_INTS = {2: "<i2", 4: "<i4"}


def _usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dim) & finite


def _quantised(vectors: DataFrame, id_column: str, column: str, dim: int, scale: int) -> DataFrame:
    """``id`` and ``v``: integer components as an array of doubles."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return rows.where(_usable(F.col("v"), dim)).select(
        "id", F.transform("v", lambda x: F.rint(F.floor(x * float(scale)).cast("double"))).alias("v")
    )


def _checked(values: np.ndarray) -> np.ndarray:
    if len(values) and np.abs(values).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT} or more after scaling: squared distances would not fit a long")
    return values


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS vectors, in the smallest integers."""
    task, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids: list = []
    parts: list[np.ndarray] = []

    def block(ids: list, values: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        width = 2 if np.abs(values).max() < 1 << 15 else 4
        made += 1
        arrays = [[(task << 32) + made], [ids], [width], [values.astype(_INTS[width]).tobytes()]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["block", "ids", "width", "data"])

    for batch in batches:
        ids += batch.column(0).to_pylist()
        parts.append(_checked(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
        while len(ids) >= BLOCK_ROWS:
            values = np.concatenate(parts)
            yield block(ids[:BLOCK_ROWS], values[:BLOCK_ROWS])
            ids, parts = ids[BLOCK_ROWS:], [values[BLOCK_ROWS:]]
    if ids:
        yield block(ids, np.concatenate(parts))


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    x = rows.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def _bounds(distances: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, expiry): the nearest centroid (ties: the smaller number)
    and the accumulated drift of that cluster at which the gap may close."""
    nearest = distances.argmin(1)
    if distances.shape[1] == 1:
        return nearest, np.full(len(distances), np.inf)
    two = np.sqrt(np.partition(distances, 1, axis=1)[:, :2].astype(np.float64))
    upper, lower = two.min(1), two.max(1)
    gone = drift[nearest]
    return nearest, (lower - upper) - _SLACK * (lower + upper + gone) + gone


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a round may shrink the gaps of each cluster, at most."""
    moved = np.sqrt(((new.astype(np.float64) - old.astype(np.float64)) ** 2).sum(1)) * (1 + _SLACK)
    if len(moved) == 1:
        return moved
    order = np.argsort(moved)
    other = np.full(len(moved), moved[order[-1]])
    other[order[-1]] = moved[order[-2]]
    return (moved + other) * (1 + _SLACK)


def _load(row: dict, k: int) -> list[list[tuple[float, int]]]:
    keys, members = np.frombuffer(row["keys"], "<f8").tolist(), np.frombuffer(row["members"], "<i4").tolist()
    heaps, at = [], 0
    for n in row["sizes"]:
        heaps.append(list(zip(keys[at : at + n], members[at : at + n])))
        at += n
    return heaps


def _matrix(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["data"], _INTS[row["width"]]).reshape(-1, dim)


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pop what has expired, scan it, push it; blocks without heaps are
    scanned whole. ``moved`` holds the change of each cluster's count and
    component sums."""
    k, dim = centroids.shape
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            values = _matrix(row, dim)
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
            if row.get("sizes") is None:
                popped, before = list(range(len(values))), np.full(len(values), -1)
            else:
                heaps, popped, owners = _load(row, k), [], []
                for cluster, heap in enumerate(heaps):
                    while heap and heap[0][0] <= drift[cluster]:
                        popped.append(heapq.heappop(heap)[1])
                        owners.append(cluster)
                before = np.asarray(owners, np.int64)
            moved = np.zeros((k, dim + 1), np.int64)
            if popped:
                scanned = values[popped]
                now, expiry = _bounds(squared_distances(scanned, centroids), drift)
                for cluster, key, member in zip(now.tolist(), expiry.tolist(), popped):
                    heapq.heappush(heaps[cluster], (key, member))
                for cluster in range(k):
                    for which, sign in (((now == cluster) & (before != cluster), 1), ((before == cluster) & (now != cluster), -1)):
                        moved[cluster, 0] += sign * int(which.sum())
                        moved[cluster, 1:] += sign * scanned[which].sum(0, dtype=np.int64)
            flat = [x for heap in heaps for x in heap]
            out.append((
                row["block"],
                [heap[0][0] if heap else None for heap in heaps],
                [len(heap) for heap in heaps],
                np.array([x[0] for x in flat], "<f8").tobytes(),
                np.array([x[1] for x in flat], "<i4").tobytes(),
                moved.ravel().tolist() if moved.any() else None,
            ))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HEAPS_ARROW)], schema=_HEAPS_ARROW)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every vector with its cluster and its exact distance."""
    k, dim = centroids.shape
    for batch in batches:
        for row in batch.to_pylist():
            values, cluster, at = _matrix(row, dim), np.empty(len(row["ids"]), np.int64), 0
            members = np.frombuffer(row["members"], "<i4")
            for c, n in enumerate(row["sizes"]):
                cluster[members[at : at + n]] = c
                at += n
            distance = np.empty(len(cluster), np.int64)
            for c in range(k):
                own = cluster == c
                distance[own] = squared_distances(values[own], centroids[c : c + 1])[:, 0]
            arrays = [pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ASSIGNED_ARROW)


def _first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return _checked(np.array([r["v"] for r in first], np.float64)).astype(np.int64)


def _bucketed(rows: DataFrame, dim: int, base: str) -> str:
    """The packed blocks as a table bucketed by block; its name."""
    size = 2 * dim * rows.count()
    buckets = min(max(shuffle_partitions(rows), -(-size // BUCKET_BYTES)), MAX_BUCKETS)
    name = f"blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(lambda it: _pack(it, dim), _BLOCKS).repartition(buckets, "block")
    packed.write.bucketBy(buckets, "block").sortBy("block").option("path", f"{base}/blocks").saveAsTable(name)
    return name


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    id_column: str = "vec_id",
    column: str = "embedding",
    dim: int = 64,
    scale: int = 1024,
    seed: str = SEED,
) -> DataFrame:
    """Each usable vector with ``cluster``, ``distance`` (squared, in units
    of 1/``scale``), ``cluster_inertia``, ``inertia`` and ``centroid`` (the
    integer components of its final centroid), after ``rounds`` rounds of
    assigning and averaging and a last assignment. Runs jobs; rounds after
    one in which no centroid moved are left out, as they change nothing."""
    spark = vectors.sparkSession
    rows = _quantised(vectors, id_column, column, dim, scale)
    out = T.StructType([
        T.StructField(id_column, T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
        T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())),
    ])
    centroids = _first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], out)
    k = len(centroids)
    base = shared_dir(spark, f"clusters-{uuid.uuid4().hex}")
    table = _bucketed(rows, dim, base)
    blocks = spark.table(table)
    drift, heaps = np.zeros(k), None
    totals = [[0] * (dim + 1) for _ in range(k)]
    for n in range(rounds + 1):
        heaps, change = _assign(blocks, heaps, centroids, drift, f"{base}/heaps-{n}")
        for at, value in change.items():
            totals[at // (dim + 1)][at % (dim + 1)] += value
        if n == rounds:
            break
        new = np.array([[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(totals, centroids.tolist())], np.int64)
        if (new == centroids).all():
            break
        drift, centroids = drift + drifts(centroids, new), new
    blocks.join(heaps.drop("moved"), "block").mapInArrow(lambda it, c=centroids: _assigned(it, c), _ASSIGNED).write.parquet(f"{base}/assigned")
    spark.sql(f"DROP TABLE {table}")
    done = spark.read.schema(_ASSIGNED).parquet(f"{base}/assigned")
    # At most k rows.
    inertia = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}

    def by_cluster(values: dict[int, Column]) -> Column:
        return F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]), F.col("cluster"))

    return done.select(
        F.col("id").alias(id_column),
        "cluster",
        "distance",
        by_cluster({c: _long(x) for c, x in inertia.items()}).alias("cluster_inertia"),
        _long(sum(inertia.values())).alias("inertia"),
        by_cluster({c: F.array(*[F.lit(int(x)).cast("long") for x in v]) for c, v in enumerate(centroids)}).alias("centroid"),
    )


def _long(value: int) -> Column:
    """A literal; null where a sum has left the range of a long."""
    return F.lit(value if value < 1 << 63 else None).cast("long")


def _assign(blocks: DataFrame, heaps: DataFrame | None, centroids: np.ndarray, drift: np.ndarray, path: str) -> tuple[DataFrame, dict[int, int]]:
    """One assignment: the new heaps (written to ``path``) and the changes of
    the flattened (count, sums) of all clusters."""
    spark = blocks.sparkSession
    work = lambda it: _round(it, centroids, drift)
    if heaps is None:
        new = blocks.mapInArrow(work, _HEAPS)
    else:
        expired = F.exists(
            F.arrays_zip(F.col("tops").alias("top"), F.array(*[F.lit(float(d)) for d in drift]).alias("drift")), lambda p: F.coalesce(p["top"] <= p["drift"], F.lit(False))
        )
        heaps = heaps.drop("moved").withColumn("due", expired)
        scanned = blocks.join(heaps.where("due").drop("due"), "block").mapInArrow(work, _HEAPS)
        rest = heaps.where("NOT due").drop("due").withColumn("moved", F.lit(None).cast("array<bigint>"))
        new = scanned.unionByName(rest)
    new.write.parquet(path)
    heaps = spark.read.schema(_HEAPS).parquet(path)
    changed = heaps.where("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "value"))
    # At most k x (components + 1) rows.
    sums = changed.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    return heaps, {r["at"]: int(r["value"]) for r in sums}
