"""Packing of token sequences by length patterns and non-negative least squares.

All decisions are made on the histogram of lengths, which has ``size`` numbers however large the corpus is. Patterns are
multisets of up to three lengths that fill a sequence exactly. Repeat counts x minimise |A x - h| with x >= 0, where h is the
histogram; they are rounded down to whole numbers that never use more documents of a length than there are, and what is left
is packed best-fit, longest first, again on counts. The plan lists patterns with their repeats; documents of a
length are numbered and take the places of that length in turn, so no document passes through the driver.

Defined cases: a null text is one piece with the end id alone; pieces never exceed ``size``; the first piece of a cut
document is the short one; repeated rows are packed each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import sliced, written
from revgrain.llm.tokens import encoded

SIZE = 1024
#: Steps of the multiplicative updates; the rest is left to rounding and best fit.
STEPS = 200
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, words: bool, end: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids (with ``end``), of at most ``size``: (doc_id, piece, start, length, ids_crc32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), encoded(path, words, batch.column(1), end)):
                n = len(raw) // 4
                first = n % size or size
                for k, a in enumerate([0, *range(first, n, size)]):
                    b = first if k == 0 else a + size
                    rows.append((doc, k, a, b - a, crc32(raw[4 * a:4 * b])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def patterns(size: int) -> np.ndarray:
    """Every multiset of two or three lengths with sum ``size``, in rows of three, 0 where there is none."""
    pairs = [(a, size - a, 0) for a in range(1, size // 2 + 1)]
    triples = []
    for a in range(1, size // 3 + 1):
        b = np.arange(a, (size - a) // 2 + 1)
        triples.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate([np.array(pairs).reshape(-1, 3), *triples]).astype(np.int64)


def repeats(rows: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - hist| by multiplicative updates; column j of A counts the lengths of pattern j."""
    x = np.full(len(rows), max(hist.sum(), 1) / max(len(rows), 1))
    there = lambda v: (v[rows] * (rows > 0)).sum(axis=1)  # noqa: E731  A^T v
    x[(hist[rows] == 0).__and__(rows > 0).any(axis=1)] = 0  # a length that doesn't occur
    goal = there(hist.astype(float))
    for _ in range(steps):
        now = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=len(hist)).astype(float)
        now[0] = 0
        x *= goal / np.maximum(there(now), 1e-12)
    return x


def whole(rows: np.ndarray, x: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats in the order of x, none beyond the documents there are; what is left of the histogram."""
    left, times = hist.copy(), np.floor(x + 1e-9).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        used = [n for n in rows[j].tolist() if n]
        most = min(left[n] // used.count(n) for n in used)
        times[j] = min(int(np.ceil(x[j])) if x[j] > 0.5 else 0, most)
        for n in used:
            left[n] -= times[j]
    return times, left


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats for the rest: longest lengths first, each into the fullest sequences it fits in."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(size, 0, -1):
        count = int(left[n])
        # A length of at most half a sequence can go several times into the same one, so go on until all are placed.
        while count:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                per = size // n
                full, rest = divmod(count, per)
                for times, k in ((full, per), (1 if rest else 0, rest)):
                    if times:
                        open_.setdefault(size - n * k, []).append(((n,) * k, times))
                break
            pattern, times = open_[room].pop()
            used = min(times, count)
            if times > used:
                open_[room].append((pattern, times - used))
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - n, []).append(((*pattern, n), used))
            count -= used
    return [x for some in open_.values() for x in some]


def plan(hist: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, for ``hist[n]`` documents of length n."""
    hist = hist.astype(np.int64)
    rest = hist.copy()
    rest[size] = 0
    out: list[tuple[tuple[int, ...], int]] = [((size,), int(hist[size]))] if hist[size] else []
    rows = patterns(size)
    rows = rows[((rest[rows] > 0) | (rows == 0)).all(axis=1)]
    if len(rows):
        times, rest = whole(rows, repeats(rows, rest), rest)
        out += [(tuple(n for n in rows[j].tolist() if n), int(times[j])) for j in np.flatnonzero(times)]
    return out + best_fit(rest, size)


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where each run of its numbers begins, and the first sequence and the offset in the sequence of that run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in chosen:
        offset = 0
        for n in pattern:
            runs.setdefault(n, []).append((taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 0 within each length: numbers within a part, then the counts of the parts before it.

    The parts are written, so they stay as they are. A length of any share of the rows is spread over all parts.
    """
    # Numbers are counted by Spark: a function behind the one that makes the rows would take a second Python worker a task.
    parts = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    local = written(parts, "packing-pieces")
    own = Window.partitionBy("length", "part").orderBy("at")
    local = local.withColumn("nth", F.row_number().over(own).cast("long") - 1).drop("at")
    sums = local.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    return local.join(sums.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before"))


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` (with ``length``) with ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    counted = numbered(rows)
    hist = np.zeros(size + 1, dtype=np.int64)
    for r in counted.groupBy("length").count().collect():  # at most ``size`` rows
        hist[r["length"]] = r["count"]
    sent = spark.sparkContext.broadcast(places(plan(hist, size)))
    columns = [*rows.columns, "nth"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(nth), dtype=np.int64), np.zeros(len(nth), dtype=np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                begins, first, offsets = sent.value[n]
                run = np.searchsorted(begins, nth[at], side="right") - 1
                sequence[at], offset[at] = first[run] + nth[at] - begins[run], offsets[run]
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = counted.select(*columns).schema.simpleString().removeprefix("struct<").removesuffix(">")
    return counted.select(*columns).mapInArrow(place, f"{schema}, sequence_id: bigint, offset: bigint").drop("nth")
