"""Near duplicates by MinHash with tensored banding, links confirmed on the full sets.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two collections of ``HALVES`` half keys are made of
``ROWS`` minhashes each; a table key joins one half of either collection, so 2 x 8 x 2 = 32 minhashes make 64 tables of four
minhashes where separate tables would need 256. A pair of similarity s is missed with a chance below 2 (1 - s**2)**8:
7e-5 at 0.85, 3e-6 at 0.9.

Documents with the same set are one class, which the search knows by a number of its own: rows may share an id and still
hold different texts. Buckets never list their pairs: in a round every member is paired with two centres of its bucket, pairs are confirmed, and components merge. Rounds go on in
buckets that still hold more than one component while they find links. Candidates that then are still unlike meet again under
their rarest shingles, of which linked sets must share one (an exact filter): rounds of centres again, and last, members of
different components. So copies cost a pair each, crowds of half-alike texts part, and every candidate pair ends up
linked, refused, or inside one component. Pairs whose sizes rule the link out, or of which fewer than ``AGREE`` of 32 minhashes
agree (chance below 3e-5 at 0.85), are refused unread.

Defined cases: a null text counts as empty; without words a document is linked with nothing; with fewer than five words the
whole sequence is the one shingle; null ids join their class and are kept only if nobody else is in it; repeated rows
give a row each; rows of one id with unlike texts are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import looked_up, release_worker, sliced, steps, tidied, written
from revgrain.llm.graph import components
from revgrain.session import cut_lineage

WORDS, HALVES, ROWS, AGREE, ROUNDS = 5, 8, 2, 17, 4
#: Shingles hashed at once.
WIDE = 16_384
SEED = 20_240_229
FEATURES = "id long, text_key long, n long, class binary, left array<long>, right array<long>, sketch binary"


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words between blanks, tabs and line ends."""
    for some in steps(texts):
        yield from _sets(some, words)


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(there)))[bounds]
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)[there]]
    factors = multipliers(words + 1, SEED)
    if len(word) >= words:
        runs = mixed(sum(word[k:len(word) - words + 1 + k] * factors[k] for k in range(words)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(runs[a:b - words + 1])
        elif b > a:
            short = word[a:b]
            yield mixed((short * factors[:len(short)]).sum(keepdims=True) + factors[words:] * np.uint64(len(short)))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), WIDE):
        least = np.minimum(least, (shingles[None, at:at + WIDE] * factors[:, None]).min(axis=1))
    return least


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, class, left, right, sketch) of every row.

    ``text_key`` tells the texts of one id apart, ``class`` is a digest of the set; an empty set has no keys.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        factors = multipliers(2 * HALVES * ROWS, SEED + 1)
        mix = multipliers(ROWS, SEED + 2)
        for batch in sliced(batches):
            n, kind, left, right, sketch = [], [], [], [], []
            for s in shingle_sets(batch.column(2)):
                n.append(len(s))
                kind.append(xxhash.xxh3_128_digest(s.tobytes()))
                least = minhashes(s, factors)
                keys = mixed((least.reshape(2 * HALVES, ROWS) * mix).sum(axis=1, dtype=np.uint64)).view(np.int64)
                left.append(keys[:HALVES] if len(s) else [])
                right.append(keys[HALVES:] if len(s) else [])
                sketch.append((least >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kind, pa.binary()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
            ], names=["id", "text_key", "n", "class", "left", "right", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(make, FEATURES)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def table_rows(heads: DataFrame) -> DataFrame:
    """One row (key, id) for each of the tensored tables."""
    lefts = heads.select("id", "right", F.posexplode("left").alias("i", "l"))
    both = lefts.select("id", "i", "l", F.posexplode("right").alias("j", "r"))
    return both.select(F.xxhash64("i", "j", "l", "r").alias("key"), "id")


def _sets_of(docs: DataFrame, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of classes (id, head_id, text_key): the set of the row that stands for each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], names=["id", "shingles"])

    rows = _texts(docs, id_col, text_col).withColumnRenamed("id", "head_id")
    some = rows.join(heads, ["head_id", "text_key"])
    return written(some.select("id", "text").mapInArrow(make, "id long, shingles binary"), "shingle-sets")


def _ids(pairs: DataFrame) -> DataFrame:
    """The different ids in ``pairs`` (a, b), each side made distinct first: a centre's id goes out once a task, however many it is paired with."""
    sides = [pairs.select(F.col(c).alias("id")).distinct() for c in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def _met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose ids are in ``pairs`` (a, b), so a round of few pairs sends few rows."""
    return rows.join(_ids(pairs), "id", "left_semi")


def likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and minhashes don't rule out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= AGREE)).select(["a", "b"])

    heads = _met(heads.select("id", "n", "sketch"), pairs)
    one = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 x intersection >= ``percent`` x union. The member's set travels, the centre's is met at its place."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sets = _met(sets, pairs)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _pairs(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


class Search:
    """Components (id, component) that the links found so far among ``heads`` make, and the pairs that were tested."""

    def __init__(self, heads: DataFrame, sets: DataFrame, percent: int):
        self.heads, self.sets, self.percent = heads, sets, percent
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def test(self, pairs: DataFrame) -> bool:
        """Confirm pairs that are new and merge components; whether there were links.

        Pairs are written as tables, so their size is known to the joins that follow, and those of few pairs shuffle nothing.
        """
        fresh = written(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), "minhash-pairs")
        some = written(likely(fresh, self.heads, self.percent), "minhash-likely")
        good = written(confirmed(some, self.sets, self.percent), "minhash-links")
        self.tested = fresh if self.tested is None else self.tested.unionByName(fresh)
        if good.isEmpty():
            return False
        # The components so far are stars, which stand for the links found before.
        known = good if self.labels is None else good.unionByName(self.labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.labels = cut_lineage(components(known))
        return True

    def centres(self, rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
        """Pair the members of each bucket with two centres, round by round; returns what is still unlike (key, id, component)."""
        for _ in range(rounds):
            open_, spread = _open(rows, self.labels)
            ends = F.array(*[F.struct(F.col(c).alias("c"), F.col(f"{c}_head").alias("h")) for c in ("lo", "hi")])
            star = open_.join(spread, "key").select("id", "component", F.explode(ends).alias("to")).filter("component <> to.c")
            if not self.test(star.select(*_pairs("id", "to.h")).distinct()):
                return open_
            rows = open_.select("key", "id")  # a bucket of one component stays one
        return _open(rows, self.labels)[0]

    def across(self, open_: DataFrame, places: DataFrame) -> None:
        """Pair the members outside a bucket's largest component with all of another component.

        ``places`` says where the key stands among the ``n`` ordered shingles of a member. If it is the first that two sets
        share, they share at most what follows in either, itself included; where that is too little, the pair is left to
        another key or isn't linked.
        """
        open_ = open_.join(places, ["key", "id"])
        sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("many"))
        main = sizes.groupBy("key").agg(F.max(F.struct("many", "component")).alias("main"))
        minor = open_.join(main, "key").filter("component <> main.component").select("key", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
        others = open_.select("key", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"))
        share = self.percent
        least = f"(least(nx - px, ny - py) + 1) * {100 + share} >= {share} * (nx + ny) and least(nx, ny) * 100 >= greatest(nx, ny) * {share}"
        # Of two minor members the pair is met once.
        met = minor.join(others.join(main, "key").withColumn("minor", F.col("cy") != F.col("main.component")).drop("main"), "key")
        self.test(met.filter(f"cx <> cy and (not minor or x < y) and {least}").select(*_pairs("x", "y")).distinct())


def prefixes(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Rows (key, id, n, place): the rarest shingles of each set, so many that two linked sets must share one of them.

    Of n shingles, two sets with the wanted similarity share at least percent/100 n; any order will do for that, and the
    rarest first makes keys of few members. Shingles that only one of the sets has fill places but are no keys.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("shingles").to_pylist()):
                s = np.frombuffer(raw, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["id", "n", "key"])

    flat = sets.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(spell, "id long, n long, key long")
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    rows = flat.join(shared, "key")
    own = Window.partitionBy("id")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    place = alone + F.row_number().over(own.orderBy("many", "key"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return kept.select("key", "id", "n", "place")


def links(docs: DataFrame, heads: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Components (id, component) of linked classes ``heads`` (id, head_id, text_key, n, left, right, sketch)."""
    rows = table_rows(heads)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key")
    rows = written(rows.join(shared, "key"), "minhash-buckets")
    met = heads.select("id", "head_id", "text_key").join(rows.select("id").distinct(), "id", "left_semi")
    search = Search(heads, _sets_of(docs, met, id_col, text_col), percent)
    unlike = search.centres(rows).select("id").distinct()
    rare = written(prefixes(search.sets, unlike, percent), "rare-shingles")
    search.across(search.centres(rare.select("key", "id")), rare)
    return rows.sparkSession.range(0).selectExpr("id", "id as component") if search.labels is None else search.labels


def _open(rows: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, component) of buckets with more than one component, and (key, lo, hi, lo_head, hi_head) of these.

    The centres are the smallest members of the bucket's first and last component.
    """
    named = rows.withColumn("component", F.col("id")) if labels is None else rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("key").agg(F.min(F.struct("component", "id")).alias("lo"), F.max(F.struct("component", (-F.col("id")).alias("id"))).alias("hi"))
    heads = heads.filter("lo.component < hi.component")
    spread = cut_lineage(heads.selectExpr("key", "lo.component as lo", "hi.component as hi", "lo.id as lo_head", "-hi.id as hi_head"))
    return cut_lineage(named.select("key", "id", "component").join(spread.select("key"), "key", "left_semi")), spread


def named_rows(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row (id, text_key, n_shingles, component, component_id): ``component`` numbers the groups of linked rows.

    It is null where a row has no set, or where no row with an id has its set. Two groups may share a smallest id where
    rows share an id, never a number.
    """
    rows = written(features(docs, id_col, text_col), "minhash-features")
    full = rows.filter("n > 0")
    head = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_key", "n", "left", "right", "sketch"))).alias("head")
    heads = full.groupBy("class").agg(head, F.count(F.lit(1)).alias("many")).filter("head is not null")
    # Numbers follow the ids, so the centres of buckets are their smallest members.
    number = F.monotonically_increasing_id().alias("id")
    heads = heads.sort("head.id", "head.text_key", "class")
    heads = written(heads.select(number, "class", "many", F.col("head.id").alias("head_id"), *[f"head.{c}" for c in ("text_key", "n", "left", "right", "sketch")]), "minhash-heads")
    with tidied(docs.sparkSession):
        labels = links(docs, heads.drop("class", "many"), percent, id_col, text_col)
    classes = heads.select("id", "class", "many", "head_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes = cut_lineage(classes.select("class", "many", "head_id", "component"))
    least = classes.groupBy("component").agg(F.min("head_id").alias("component_id"), F.count(F.lit(1)).alias("many"))
    classes = looked_up(classes.withColumnRenamed("many", "n_rows"), least, "component").select("class", F.col("n_rows").alias("many"), "component", "component_id")
    named = looked_up(full.select("id", "text_key", F.col("n").alias("n_shingles"), "class"), cut_lineage(classes), "class").drop("class")
    none = F.lit(None).cast("long").alias("component")
    return named.unionByName(rows.filter("n = 0").select("id", "text_key", F.col("n").alias("n_shingles"), none, F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row (id, n_shingles, component_id, kept): linked documents share the smallest id they reach.

    Links: 100 x intersection >= ``percent`` x union of the shingle sets.
    """
    rows = named_rows(docs, percent, id_col, text_col)
    return rows.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked rows one (id, text), that of the smallest id.

    Rows without an id or without words stay. Rows that agree in id and text are one document, and stay or go together.
    """
    rows = named_rows(docs, percent, id_col, text_col).filter("id is not null")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.*")
    stay = first.unionByName(rows.filter("component is null").select("id", "text_key"))
    own = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"))
    known = docs.filter(F.col(id_col).isNotNull()).select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), own.alias("own"))
    known = known.join(stay.select(F.struct("id", "text_key").alias("own")), "own", "left_semi").select("row.*")
    return known.unionByName(docs.filter(F.col(id_col).isNull()))
