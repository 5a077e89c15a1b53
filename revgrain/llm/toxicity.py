"""Toxicity by maximum-scoring segments over token log-odds.

Units are words (runs of letters, lower-cased) and their first four to six letters. A unit's score is its log-odds between
toxic and other labelled texts under a Dirichlet prior taken from the counts of the whole corpus. A word counts once a
text, and once for all texts of a class with the same least shingle hash, which near copies mostly share; so repeated lines and much-copied
texts don't weigh more, and no text is left out. Only units whose likelihood ratio stands out are kept, and a word takes the score of its most specific
kept unit. All other words share one small negative score. A linear scan (Ruzzo and Tompa) finds all maximal segments. A segment of
score S in n words has the extreme-value score S' = lambda S - ln(K n): lambda and K are fitted to the words of texts that
are not toxic. Segments with a chance of at most ``LEVEL`` are significant; their S' add up to the text's evidence, which a
logistic curve turns into a score.

The classifier is fitted on ``LABELLED`` labelled rows at most, taken by hash, and holds ``UNITS`` units at most, those that stand out most; prior counts cover every text. Labels,
language, source and ids are never inputs of a score.

Defined cases: null texts count as empty and get the score of a text without evidence; labels that are null are left
out, of several labels of one text the highest holds; without both classes among the labels no unit is kept; repeated rows
are scored each; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgrain.llm.common import give_back, release_worker, steps, written
from revgrain.llm.minhash import shingle_sets

LABELLED, UNITS, LEAST, STANDS_OUT, LEVEL = 20_000, 65_536, 5, 25.0, 0.02
#: Letters of a prefix unit; words of prior for each word of the other labelled texts, dealt by the corpus, and a flat part for each unit.
PREFIXES, PRIOR, FLAT = (6, 5, 4), 0.003, 0.5
MODEL = {"units": {}, "rest": 0.0, "lambda": 1.0, "K": 1.0, "bias": -10.0, "slope": 0.0}


def units_of(word: str) -> list[str]:
    """The word, marked as whole, and its prefixes, the most specific first."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the word number of every word in order, and where each text begins."""
    lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " "), " ")
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    words = flat.dictionary_encode()
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(there)))[bounds]
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)[there], bounds


def segments(scores: list[float], before: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence in linear time: (score, first hit, last hit).

    ``scores`` are the positive terms in order, ``before`` the sum of all terms ahead of each. Every candidate keeps a link to
    the last one before it with a smaller left sum, so each link is followed once.
    """
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    for k, (s, low) in enumerate(zip(scores, before)):
        high, begin = low + s, k
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], span[j][0]
            del left[j:], right[j:], span[j:], link[j:]
        left.append(low)
        right.append(high)
        span.append((begin, k))
        link.append(j)
    return [(r - l, a, b) for l, r, (a, b) in zip(left, right, span)]


def passages(texts: pa.Array, model: dict) -> Iterator[tuple[float, list[tuple[float, int, int]]]]:
    """For each text: its evidence, and its significant passages (S', first word, end word)."""
    release_worker()
    score: dict[str, float] = model["units"]
    for some in steps(texts):
        words, numbers, bounds = coded(some)
        own = np.array([next((score[u] for u in units_of(w) if u in score), 0.0) for w in words] or [0.0])
        hits = np.flatnonzero(own[numbers] > 0)
        sums = np.cumsum(np.where(own[numbers] > 0, own[numbers], model["rest"])) if len(numbers) else np.zeros(0)
        cuts = np.searchsorted(hits, bounds)
        for a, b, first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            found = []
            if b > a:
                at = hits[a:b]
                s = own[numbers[at]]
                for total, i, j in segments(s.tolist(), (sums[at] - s).tolist()):
                    normal = model["lambda"] * total - math.log(model["K"] * (end - first))
                    if -math.expm1(-math.exp(-normal)) <= LEVEL:
                        found.append((normal, int(at[i]) - first, int(at[j]) - first + 1))
            yield sum(f[0] for f in found), found
    give_back()


def _count(kept: dict):
    """Counts of the units ``kept`` in texts: (unit, n), and of all words as unit ""."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            sums: Counter = Counter()
            for some in steps(batch.column(0)):
                words, numbers, _ = coded(some)
                for w, c in zip(words, np.bincount(numbers, minlength=len(words)).tolist()):
                    if c:
                        sums[""] += c
                        for u in units_of(w):
                            if u in kept:
                                sums[u] += c
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], names=["unit", "n"])

    return count


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each text: (kin, toxic, word) from (text, toxic), ``kin`` being the least shingle hash."""
    release_worker()
    for batch in batches:
        classes, at = batch.column(1).to_numpy(zero_copy_only=False), 0
        for some in steps(batch.column(0)):
            words, numbers, bounds = coded(some)
            texts = np.repeat(np.arange(len(some)), np.diff(bounds))
            if len(words):
                texts, numbers = np.divmod(np.unique(texts * len(words) + numbers), len(words))
                kin = kin_of(some).take(pa.array(texts))
                toxic = pa.array(classes[at + texts], pa.int32())
                yield pa.RecordBatch.from_arrays([kin, toxic, pa.array(words, pa.string()).take(pa.array(numbers))], names=["kin", "toxic", "word"])
            at += len(some)


COUNTS = "unit string, n long"


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_on) -> DataFrame:
    """Different labelled texts (text, toxic), from ``LABELLED`` labels at most that ``fit_on`` allows."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    some = known.filter(fit_on(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id")).limit(LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    joined = texts.join(F.broadcast(some), "id")  # LABELLED rows of two numbers at most
    return written(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-training")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, y1, y0): in how many toxic and other texts a word stands, texts of one class and least shingle hash counted once."""
    different = rows.mapInArrow(_words, "kin long, toxic int, word string").distinct()
    of = lambda kind: F.sum(F.when((F.col("toxic") > 0) == kind, 1).otherwise(0))
    return written(different.groupBy("word").agg(of(True).alias("y1"), of(False).alias("y0")), "toxicity-words")


def unit_rows(words: DataFrame) -> DataFrame:
    """A row for each unit of each word, the most specific (place 0) first: (word, y1, y0, place, unit), as ``units_of`` names them."""
    starts = [F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in PREFIXES]
    return words.select("*", F.posexplode(F.array_compact(F.array(F.concat("word", F.lit("$")), *starts))).alias("place", "unit"))


def kin_of(texts: pa.Array) -> pa.Array:
    """The least shingle hash of each text, which near copies mostly share."""
    return pa.array([int(s[0] >> np.uint64(1)) if len(s) else 0 for s in shingle_sets(texts)], pa.int64())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_on=lambda i: F.lit(True)) -> dict:
    """The model, a dictionary of plain values (see ``MODEL``)."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels, id_col, text_col, fit_on)
    words = word_counts(rows)
    n1, n0 = words.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return dict(MODEL)
    by_class = unit_rows(words).groupBy("unit").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    both = F.col("y1") + F.col("y0")
    ratio = 2 * (F.col("y1") * F.log(F.col("y1") / both * (n1 + n0) / n1) + F.when(F.col("y0") > 0, F.col("y0") * F.log(F.col("y0") / both * (n1 + n0) / n0)).otherwise(0.0))
    wanted = by_class.filter((F.col("y1") >= LEAST) & (F.col("y1") * n0 > F.col("y0") * n1) & (ratio >= STANDS_OUT))
    wanted = {r.unit: (r.y1, r.y0) for r in wanted.orderBy(ratio.desc(), "unit").limit(UNITS).collect()}  # a model of UNITS entries at most
    if not wanted:
        return dict(MODEL)
    sent = spark.sparkContext.broadcast(dict.fromkeys(wanted, True))

    def prior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(sent.value)(batches)

    whole = {r.unit: r.n for r in docs.select(F.col(text_col).alias("text")).mapInArrow(prior, COUNTS).groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    strength = PRIOR * n0
    extra = {u: strength * whole.get(u, 0) / max(whole.get("", 1), 1) + FLAT for u in wanted}
    toxic = lambda u, y: (y + extra[u]) / (n1 + strength)
    quiet = lambda u, y: (y + extra[u]) / (n0 + strength)
    units = {u: math.log(toxic(u, y1) / quiet(u, y0)) for u, (y1, y0) in wanted.items()}
    # Chances under the rule that a word takes its most specific unit.
    names = F.broadcast(spark.createDataFrame([(u,) for u in units], "unit string"))  # UNITS at most
    first = unit_rows(words).join(names, "unit").groupBy("word", "y1", "y0").agg(F.min_by("unit", "place").alias("unit"))
    dealt = {r.unit: (r.y1, r.y0) for r in first.groupBy("unit").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).collect()}
    chance = [(units[u], quiet(u, y0)) for u, (y1, y0) in dealt.items() if units[u] > 0]
    p0, p1 = sum(p for _, p in chance), sum(toxic(u, y1) for u, (y1, _) in dealt.items())
    model = MODEL | {"units": {u: v for u, v in units.items() if v > 0}, "rest": min(math.log((1 - min(p1, 0.9)) / (1 - min(p0, 0.8))), -1e-6)}
    low, high = 0.05, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p * math.exp(mid * v) for v, p in chance) + (1 - p0) * math.exp(mid * model["rest"]) < 1 else (low, mid)
    model |= {"lambda": low, "K": max(1e-9, sum(p * math.exp(low * v) for v, p in chance))}
    return _calibrated(model, rows)


def _calibrated(model: dict, rows: DataFrame) -> dict:
    """Bias and slope of the logistic curve, by Newton steps with a small ridge, from a histogram of the training evidence."""
    evidence = rows.select("toxic", evidence_of(model)("text").alias("e")).groupBy("toxic", F.round("e", 1).alias("e")).count().collect()
    x = np.array([math.log1p(max(r.e, 0.0)) for r in evidence])
    y, n = np.array([float(r.toxic > 0) for r in evidence]), np.array([float(r["count"]) for r in evidence])
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (y - p)) - 1e-2 * w
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return model | {"bias": float(w[0]), "slope": float(max(w[1], 0.0))}


def evidence_of(model: dict):
    """A column function from texts to their evidence."""

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array([e for e, _ in passages(texts, model)], pa.float64())

    return evidence


def score_of(model: dict):
    """A column function from texts to scores between 0 and 1."""
    bias, slope = model["bias"], model["slope"]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([1 / (1 + math.exp(-max(-500.0, bias + slope * math.log1p(max(e, 0.0))))) for e, _ in passages(texts, model)], pa.float64())

    return score


def toxic_passages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: (id, evidence, first_word, end_word, text_evidence), words as runs of letters."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, a, b, e) for i, (e, found) in zip(batch.column(0).to_pylist(), passages(batch.column(1), model)) for s, a, b in found]
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "evidence", "first_word", "end_word", "text_evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, "id long, evidence double, first_word long, end_word long, text_evidence double")
