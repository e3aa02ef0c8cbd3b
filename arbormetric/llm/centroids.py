"""Centroid clustering over a vector-approximation file (VA-file)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arbormetric.llm.tables import discard, small, stored, table
from arbormetric.llm.topk import integer_vector

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Bits of a cell, two cells in a byte, and the accuracy of the quantiles that part them.
BITS = 4
CELLS = 1 << BITS
ACCURACY = 2000
#: Components beyond this have squared distances beyond a long; vectors that hold one raise.
LARGEST = 1 << 27
#: Rows whose intervals are computed at once.
ROWS = 8192


def kept_vectors(embeddings: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``key, v`` of the rows whose vector has exactly ``dimensions`` components, all of them finite."""
    own = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.when(F.size(vector) == dimensions, integer_vector(F.col(vector))).alias("v"))
    sound = F.assert_true(F.forall("v", lambda x: F.abs(x) <= LARGEST), F.lit("a component is too large for exact distances"))
    return own.filter("v is not null").select("vec_id", F.when(sound.isNull(), F.col("v").cast("array<int>")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the least hashes of seed and id; equal hashes go by the components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()
    return np.array([row.v for row in chosen], np.int64)


def cell_borders(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """``(dimensions, CELLS + 1)``: least value, inner borders at about equal shares, largest value of
    each dimension. Cell c holds the values from border c up to the next, that one excluded; the
    last cell holds its end as well."""
    shares = [i / CELLS for i in range(1, CELLS)]
    each = vectors.select(F.posexplode("v").alias("at", "x"))
    of = each.groupBy("at").agg(F.min("x").alias("low"), F.percentile_approx("x", shares, ACCURACY).alias("inner"), F.max("x").alias("high"))
    rows = {row["at"]: [row["low"], *row["inner"], row["high"]] for row in of.collect()}
    return np.array([rows[i] for i in range(dimensions)], np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)


def _bytes_matrix(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), -1)


def approximations(vectors: DataFrame, borders: np.ndarray) -> DataFrame:
    """``key, cells, cluster``: the vectors' cells, two in a byte, and no cluster yet (-1)."""

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            cell = np.zeros(v.shape, np.uint8)
            for i, border in enumerate(borders):
                cell[:, i] = np.searchsorted(border[1:-1], v[:, i], "right")
            pair = cell if cell.shape[1] % 2 == 0 else np.pad(cell, ((0, 0), (0, 1)))
            packed = pair[:, ::2] | pair[:, 1::2] << BITS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(np.full(len(v), -1, np.int32))],
                                             names=["key", "cells", "cluster"])

    return vectors.select("key", "v").mapInArrow(approximate, "key long, cells binary, cluster int")


def distance_tables(borders: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(clusters, dimensions, CELLS)``: least and largest squared distance of a centroid's component
    to the integers of a cell."""
    low, high = borders[None, :, :-1], borders[None, :, 1:].copy()
    # The last cell holds its end; an empty one is never looked up.
    high[:, :, :-1] = np.maximum(high[:, :, :-1] - 1, low[:, :, :-1])
    own = centroids[:, :, None]
    outside = np.maximum(np.maximum(low - own, own - high), 0)
    return outside**2, np.maximum((own - low) ** 2, (high - own) ** 2)


def candidates(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``(rows, clusters)``: where the interval of a row's distance reaches below the least upper end."""
    unpacked = np.empty((len(cells), least.shape[1]), np.intp)
    unpacked[:, ::2] = cells & CELLS - 1
    unpacked[:, 1::2] = (cells >> BITS)[:, : least.shape[1] // 2]
    at = np.arange(least.shape[1])
    lower = np.stack([table[at, unpacked].sum(axis=1) for table in least], axis=1)
    upper = np.stack([table[at, unpacked].sum(axis=1) for table in most], axis=1)
    return lower <= upper.min(axis=1, keepdims=True)


def _judged(state: DataFrame, borders: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """``key, cells, cluster, mask, new``: the centroids that can be nearest, as bits, and the one that
    is if the intervals leave no other, else -1."""
    least, most = distance_tables(borders, centroids)
    # Of equal centroids the first is nearest.
    other = np.array([any((c == d).all() for d in centroids[:i]) for i, c in enumerate(centroids)])
    bit = 1 << np.arange(len(centroids), dtype=np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                near = candidates(_bytes_matrix(part.column(1)), least, most) & ~other
                new = np.where(near.sum(axis=1) == 1, near.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near @ bit), pa.array(new)], names=["key", "cells", "cluster", "mask", "new"])

    return state.select("key", "cells", "cluster").mapInArrow(judge, "key long, cells binary, cluster int, mask long, new int")


def _settled(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Of the fetched rows ``key, cluster, mask, v``: ``key, new`` each, and for each batch, with a null
    key, ``new, n, sums``: how many rows a cluster wins, less those it loses, and the sums of theirs."""
    schema = "key long, new int, n long, sums array<long>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old, mask = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            v = _matrix(batch.column(3))
            new = _nearest(v, mask, centroids)[0]
            moved = new != old
            count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            np.add.at(count, new[moved], 1)
            np.add.at(sums, new[moved], v[moved])
            lost = moved & (old >= 0)
            np.add.at(count, old[lost], -1)
            np.subtract.at(sums, old[lost], v[lost])
            rows, k = len(v), len(centroids)
            own = lambda a, t: pa.concat_arrays([pa.nulls(rows, t), pa.array(a, t)])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column(0), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([new, np.arange(k)]), pa.int32()),
                 own(count, pa.int64()), own(sums.tolist(), pa.list_(pa.int64()))], names=["key", "new", "n", "sums"])

    return fetched.select("key", "cluster", "mask", "v").mapInArrow(settle, schema)


def _nearest(v: np.ndarray, mask: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids in each row's mask, of equally near ones the first, and its squared
    distance."""
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), -1)
    for c, centroid in enumerate(centroids):
        own = np.flatnonzero(mask >> c & 1)
        distance = ((v[own] - centroid) ** 2).sum(axis=1)
        nearer = distance < best[own]
        best[own[nearer]], at[own[nearer]] = distance[nearer], c
    return at, best


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, distance = _nearest(_matrix(batch.column(2)), batch.column(1).to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "mask", "v").mapInArrow(assign, "vec_id long, cluster int, distance long")


def _next(centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    moved = centroids.copy()
    some = counts > 0
    moved[some] = sums[some] // counts[some, None]
    return moved


def cluster_vectors(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors without exactly ``dimensions`` components, or with one that is null or not finite, take no
    part; components become integers, ``floor(1024 * x)``, and all that follows is exact. The first
    centroids are the vectors of the least hashes of seed and id (a null id counts as empty text, rows
    of equal id go by their components); fewer vectors make fewer centroids, an empty table none and no
    rows. Repeated rows are vectors of their own; columns besides id and vector are not read.

    A VA-file holds each vector as four bits a dimension, cut at quantiles. In a round, tables of the
    least and largest share that a cell adds to a centroid's distance turn it into intervals, and
    where one of them lies below all others the nearest centroid is known. Full vectors are fetched
    only for rows whose intervals overlap, and for those that change their cluster, as the sums of the
    clusters are kept up by what moves. What the driver sees is a sum per cluster and dimension. A
    round without a move repeats itself, so that the rounds after it are left out.
    """
    vectors = stored(kept_vectors(embeddings, key, vector, dimensions).withColumn("key", F.monotonically_increasing_id()))
    centroids = first_centroids(vectors, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return embeddings.sparkSession.createDataFrame([], schema)
    borders = cell_borders(vectors, dimensions)
    state = stored(approximations(vectors, borders))
    moved = np.zeros((len(centroids), dimensions + 1), np.int64)
    for _ in range(rounds):
        judged = stored(_judged(state, borders, centroids))
        wanted = judged.filter("new = -1 or new <> cluster").select("key", "cluster", "mask")
        settled = stored(_settled(small(wanted).join(vectors.select("key", "v"), "key"), centroids))
        # Counts go as one more dimension.
        parts = settled.filter("key is null").select("new", F.posexplode(F.concat("sums", F.array("n"))).alias("at", "x"))
        for move in parts.groupBy("new", "at").agg(F.sum("x").alias("x")).collect():
            moved[move["new"], move["at"]] += move["x"]
        known = small(settled.filter("key is not null").select("key", F.col("new").alias("fetched")))
        after = stored(judged.join(known, "key", "left").select("key", "cells", F.coalesce("fetched", "new").alias("cluster")))
        for old in (state, judged, settled):
            discard(old)
        state, before = after, centroids
        centroids = _next(centroids, moved[:, -1], moved[:, :-1])
        if (before == centroids).all():
            break
    judged = _judged(state, borders, centroids).select("key", "mask")
    rows = stored(_assigned(judged.join(vectors, "key"), centroids))
    discard(state)
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = inertia.agg(F.sum("own")).first()[0] or 0
    names = {c: hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest() for c, own in enumerate(centroids)}
    shown = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return rows.join(F.broadcast(inertia), "cluster").select(
        "vec_id", "cluster", "distance", F.col("own").cast("long").alias("cluster_inertia"), F.lit(int(whole)).cast("long").alias("inertia"), shown[F.col("cluster")].alias("centroid_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for ``embeddings``."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op11_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    near = """d{n} AS (SELECT id, min((s, c)) AS near FROM (
  SELECT id, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS s FROM kept, c{n}) GROUP BY id)"""
    move = """c{m} AS MATERIALIZED (SELECT c, coalesce(any_value(moved), any_value(w)) AS w FROM c{n} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM (
    SELECT struct_extract(near, 2) AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM d{n} JOIN kept USING (id), range(1, {top}) r(i) GROUP BY 1, 2) GROUP BY c) USING (c) GROUP BY c)"""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY name, w) - 1)::INTEGER AS c, w FROM (
  SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS name, v AS w FROM kept ORDER BY 1, 2 LIMIT {clusters}))""",
    ]
    for n in range(rounds):
        parts += [near.replace("{n}", str(n)), move.replace("{n}", str(n)).replace("{m}", str(n + 1)).replace("{top}", str(DIMENSIONS + 1))]
    parts.append(near.replace("{n}", str(rounds)))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, struct_extract(near, 1) AS distance, (sum(struct_extract(near, 1)) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(struct_extract(near, 1)) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM d{rounds} JOIN kept USING (id) JOIN c{rounds} ON c = struct_extract(near, 2)"""


OP11_SQL = _op11_sql()
