"""Nearest neighbours by multiprobe p-stable hashing, candidates reranked by the exact inner product.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors, which turns the largest
inner product into the nearest point. A table hashes with ``k`` Gaussian (2-stable) projections floor((a x + b) / width).
A neighbour at similarity s projects to s u with variance 1 - s**2 where the query projects to u, so the chance that it lies in
a bucket is a product of normal integrals; buckets are visited in falling order of that chance until it adds up to
``reach`` in each table. s is each query's own: the similarity that ``top`` of all vectors exceed, judged from a bounded sample.

Equal vectors are one class, of which the ``top`` + 1 smallest ids can be among the answers; the classes that hold queries are
the queries. Buckets travel in blocks: vectors of a bucket packed by salt, queries of a bucket packed likewise, and a block
pair is one matrix product. A candidate that
so many of the sample beat that ``top`` + 5 of all vectors do (but for a chance of 1e-8) isn't emitted.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part; repeated rows of one id answer once; ties go to the smaller id; with fewer candidates than asked all are given;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import written
from revgrain.llm.minhash import mixed, multipliers

#: Tables, width of a hash step, chance to be reached in each table, and the vectors aimed at in a bucket.
TABLES, WIDTH, REACH, BUCKET = 2, 1.6, 0.75, 400
#: Vectors of the sample at most; vectors and queries of a block; salts of a bucket.
SAMPLE, BLOCK, QUERY_BLOCK, SALTS = 4_096, 1_024, 256, 4
SEED = 7


def normal_below(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)) / 2 + 0.5


class Tables:
    """The hash functions of all tables, and the visiting order of buckets."""

    def __init__(self, dim: int, k: int, top_norm: float, tables: int = TABLES, width: float = WIDTH, reach: float = REACH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.a, self.b = draw.normal(size=(tables, dim + 1, k)), draw.uniform(0, width, size=(tables, k))
        self.k, self.top_norm, self.width, self.reach = k, top_norm, width, reach
        self.mix = multipliers(k + 1, seed)

    def _key(self, table: int, cells: np.ndarray) -> np.ndarray:
        return mixed((cells.astype(np.int64).view(np.uint64) * self.mix[:-1]).sum(axis=-1, dtype=np.uint64) + self.mix[-1:] * np.uint64(table + 1)).view(np.int64)

    def index_keys(self, x: np.ndarray) -> np.ndarray:
        """Keys of the buckets of each vector, a column a table."""
        x = x / self.top_norm
        x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)
        return np.stack([self._key(t, np.floor((x @ a + b) / self.width)) for t, (a, b) in enumerate(zip(self.a, self.b))], axis=1)

    def probes(self, q: np.ndarray, near: np.ndarray) -> Iterator[np.ndarray]:
        """Keys to visit for each query, whose neighbours have a similarity of ``near``."""
        q = q / np.linalg.norm(q, axis=1)[:, None]
        near = np.clip(near, 0.0, 0.999)[:, None]
        spread = np.sqrt(1 - near**2)
        steps = int(math.ceil(8 / self.width)) + 1
        sides = []
        for a, b in zip(self.a, self.b):
            u = near * (q @ a[:-1])
            low = np.floor((u - 4 * spread + b) / self.width)
            edges = (low[:, :, None] + np.arange(steps + 1)) * self.width - b[None, :, None]
            sides.append((low, np.diff(normal_below((edges - u[:, :, None]) / spread[:, :, None]), axis=2)))
        for i in range(len(q)):
            yield np.concatenate([self._key(t, self._ordered(low[i], chance[i])) for t, (low, chance) in enumerate(sides)])

    def _ordered(self, low: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Cells in falling order of their chance, until ``reach`` is met."""
        order = np.argsort(-chance, axis=1, kind="stable")
        chance = np.take_along_axis(chance, order, axis=1).tolist()
        best = math.prod(c[0] for c in chance)
        heap, met, cells, last = [(-best, (0,) * self.k, 0)], 0.0, [], len(chance[0]) - 1
        while heap and met < self.reach:
            p, at, since = heapq.heappop(heap)
            met -= p
            cells.append(at)
            for j in range(since, self.k):  # each cell is pushed once: only places from the last moved one on move further
                if at[j] < last and chance[j][at[j] + 1] > 0:
                    heapq.heappush(heap, (p * chance[j][at[j] + 1] / chance[j][at[j]], (*at[:j], at[j] + 1, *at[j + 1:]), j))
        chosen = np.array(cells)
        return low[None, :] + order[np.arange(self.k)[None, :], chosen]


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim, norm) of the rows that take part; ``vec`` as little-endian doubles."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    fine = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    fine = fine.filter(F.forall("v", number) & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.asarray(v.values, dtype="<f8") + 0.0 for v in batch.column(1)]  # + 0.0 makes -0.0 equal to 0.0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array([len(a) for a in arrays], pa.int32()), pa.array([float(np.linalg.norm(a)) for a in arrays]),
            ], names=["id", "vec", "dim", "norm"])

    return fine.mapInArrow(pack, "id long, vec binary, dim int, norm double")


def matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype="<f8").reshape(len(column), -1)


def fit(classes: DataFrame, dim: int, n: int, **settings) -> tuple[Tables, np.ndarray]:
    """Hash tables for ``n`` classes, and the sample from which queries judge their neighbourhood."""
    top_norm = classes.agg(F.max("norm")).first()[0]
    some = classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("vec").collect()
    k = max(2, round(math.log(max(n / BUCKET, 1.0)) / math.log(3.4)))
    return Tables(dim, k, top_norm, **settings), np.frombuffer(b"".join(bytes(r.vec) for r in some), dtype="<f8").reshape(len(some), dim)


def neighbourhood(score: np.ndarray, share: float) -> np.ndarray:
    """The score that a ``share`` of all vectors exceeds, for each query, from its sorted scores with the sample.

    The lower of two: the sample's own quantile, and a normal tail fitted to the middle half.
    """
    m = score.shape[1]
    seen = score[:, max(0, m - 2 - math.ceil(share * m))]
    middle, side = score[:, m // 2], (score[:, 3 * m // 4] - score[:, m // 4]) / 1.349
    return np.minimum(seen, middle + side * NormalDist().inv_cdf(1 - share))


def blocks(rows: DataFrame, size: int, extra: str | None = None) -> DataFrame:
    """Rows (key, class, vec[, extra]) packed: (key, ids, data[, extras]) of up to ``size`` rows of one key."""
    names = ["class", "vec", *([extra] if extra else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            ids, data, *more = zip(*held)
            columns = [pa.array([key], pa.int64()), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns + [pa.array([np.array(m, dtype="<f8").tobytes()], pa.binary()) for m in more], names=["key", "ids", "data", "extras"][:len(columns) + len(more)])

        for batch in batches:
            for k, *rest in zip(batch.column("key").to_pylist(), *(batch.column(c).to_pylist() for c in names)):
                if held and (k != key or len(held) >= size):
                    yield row()
                    held = []
                key = k
                held.append(rest)
        if held:
            yield row()

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)))
    spread = salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "class").select("key", *names)
    return spread.mapInArrow(pack, "key long, ids binary, data binary" + (", extras binary" if extra else ""))


def nearest(rows: DataFrame, query: DataFrame, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """The ``top`` nearest rows found for each row of ``query``, which is part of ``rows``: (query_id, rank, id, score)."""
    spark = rows.sparkSession
    base = written(vectors(rows, id_col, vec_col), "vectors")
    sizes = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    none = spark.range(0).selectExpr("id as query_id", "cast(0 as int) as rank", "id", "cast(0 as double) as score")
    if sizes is None:
        return none
    dim = sizes["dim"]
    base = base.filter(F.col("dim") == dim).dropDuplicates(["id", "vec"])
    first = base.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("nth") <= top + 1)
    classes = written(first.groupBy("vec", "norm").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("members")), "vector-classes")
    n = classes.count()
    tables, sample = fit(classes, dim, n, **settings)
    share = min(0.5, top / n)
    # Of ``top`` + 5 nearest, the sample holds this many by chance, with six deviations and a few to spare.
    there = (top + 5) * min(1.0, SAMPLE / n)
    spare = math.ceil(there + 6 * math.sqrt(there) + 6)
    asking = vectors(query, id_col, vec_col).filter(F.col("dim") == dim).dropDuplicates(["id", "vec"]).select(F.col("id").alias("query_id"), "vec")
    asking = written(asking.join(classes.select("vec", "class"), "vec").select("query_id", "class"), "vector-queries")
    heads = classes.select("class", "vec").join(asking.select("class").distinct(), "class", "left_semi")
    sent = spark.sparkContext.broadcast(sample)  # the tables go with the functions

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = tables.index_keys(matrix(batch.column("vec"))) if batch.num_rows else np.zeros((0, 1), dtype=np.int64)
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column("class"), batch.column("vec")], names=["key", "class", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sent.value
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                q = matrix(part.column("vec"))
                score = np.sort(q @ sample.T, axis=1)
                floor = score[:, -spare] - 1e-9 * np.abs(score).max() if len(sample) > 2 * spare else np.full(len(q), -np.inf)
                near = neighbourhood(score, share) / (np.linalg.norm(q, axis=1) * tables.top_norm)
                for i, keys in enumerate(tables.probes(q, near)):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([part.column("class")[i].as_py()] * n, pa.int64()), pa.array([part.column("vec")[i].as_py()] * n, pa.binary()), pa.array([floor[i]] * n)], names=["key", "class", "vec", "floor"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, qids, qdata, extras in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "qids", "qdata", "extras"))):
                ids, qids = np.frombuffer(ids, dtype="<i8"), np.frombuffer(qids, dtype="<i8")
                score = np.frombuffer(qdata, dtype="<f8").reshape(len(qids), dim) @ np.frombuffer(data, dtype="<f8").reshape(len(ids), dim).T
                good = score >= np.frombuffer(extras, dtype="<f8")[:, None]
                if len(ids) > top + 1:
                    good &= score >= np.partition(score, -(top + 1), axis=1)[:, -(top + 1)][:, None]
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[j]), pa.array(score[i, j])], names=["asked", "class", "score"])

    held = blocks(classes.select("class", "vec").mapInArrow(index, "key long, class long, vec binary"), BLOCK)
    asked = blocks(heads.mapInArrow(probe, "key long, class long, vec binary, floor double"), QUERY_BLOCK, "floor")
    met = asked.select("key", F.col("ids").alias("qids"), F.col("data").alias("qdata"), "extras").join(held, "key")
    found = met.select("ids", "data", "qids", "qdata", "extras").mapInArrow(rank, "asked long, class long, score double")
    found = found.groupBy("asked", "class").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "class"))
    best = written(found.withColumn("place", place).filter(F.col("place") <= top + 1), "vector-found")
    pairs = best.join(classes.select("class", "members"), "class").select("asked", "score", F.explode("members").alias("id"))
    answers = asking.select("query_id", F.col("class").alias("asked")).join(pairs, "asked").filter("query_id <> id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", order).filter(F.col("rank") <= top).select("query_id", "rank", "id", "score")
