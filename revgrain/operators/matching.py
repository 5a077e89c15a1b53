"""Substring joins: texts with the values of their key that they contain.

Keys with few values carry them as one array beside each text, tested inside generated code. Keys with many values go another way:
values and texts meet in one sorted run, the values first; a Python worker builds an automaton of the values (Aho-Corasick) and
streams the texts through it, so each text is read once whatever the number of values, and memory follows the values of a block and not the
texts. A key with many texts is dealt over several runs, each with all its values; a key with very many values is cut into
blocks that all its texts pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Values of a key that are tested one by one, texts of a run and values of a block before a key is split further, and keys that may be broadcast.
FEW, RUN_TEXTS, BLOCK_VALUES, BROADCAST_KEYS = 128, 20_000, 10_000, 200_000


class Finder:
    """The values that a text contains, by one automaton."""

    def __init__(self, values: list[str]):
        import ahocorasick

        self.always = [v for v in values if not v]
        self.machine = ahocorasick.Automaton()
        for v in values:
            if v:
                self.machine.add_word(v, v)
        self.machine.make_automaton()

    def find(self, text: str) -> list[str]:
        return self.always + (list({v for _, v in self.machine.iter(text)}) if len(self.machine) else [])


def _large(counts: DataFrame, keys: list[str], per: int, name: str) -> DataFrame:
    """Keys with more than ``per`` rows and into how many parts they go; as a broadcast if they are few."""
    large = counts.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias(name)).where(F.col(name) > 1)
    return F.broadcast(large) if large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else large


def contained(rows: DataFrame, values: DataFrame, keys: list[str], text: str, value: str, once: str | None = None, both: bool = False) -> DataFrame:
    """``rows`` with each different value of the same key that ``text`` contains, one output row for each match.

    ``once``: "row" leaves one match of each row, "value" at least one match of each value of a key and maybe fewer of the rest.
    ``both``: a text matches as well if the value contains it. Null keys, texts and values match nothing; an empty string is in every
    text. ``rows`` must not have a column named like the value.
    """
    some = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    values = values.where(some & F.col(value).isNotNull()).select(*keys, value)
    rows = rows.where(some & F.col(text).isNotNull())
    # Counting rows is far cheaper than counting different values, and mostly settles it.
    if values.groupBy(*keys).count().where(F.col("count") > FEW).isEmpty():
        return _tested(rows, values, keys, text, value, once, both)
    values = values.distinct()
    many = values.groupBy(*keys).count().where(F.col("count") > FEW).select(*keys)
    n_many = many.limit(BROADCAST_KEYS + 1).count()
    if not n_many:
        return _tested(rows, values, keys, text, value, once, both)
    many = F.broadcast(many) if n_many <= BROADCAST_KEYS else many
    few = _tested(rows.join(many, keys, "left_anti"), values.join(many, keys, "left_anti"), keys, text, value, once, both)
    rows, values = rows.join(many, keys, "left_semi"), values.join(many, keys, "left_semi")
    hits = _scanned(rows, values, keys, text, value, None if both else once)
    if both:
        inside = _scanned(values, rows.select(*keys, text).distinct(), keys, value, text, None).where(F.col(text) != F.col(value))
        hits = hits.unionByName(rows.join(inside, [*keys, text]).select(*hits.columns))
    return few.unionByName(hits)


def _tested(rows: DataFrame, values: DataFrame, keys: list[str], text: str, value: str, once: str | None, both: bool) -> DataFrame:
    """Matches of keys that have ``FEW`` values at most."""
    packed = values.groupBy(*keys).agg(F.collect_set(value).alias("_values"))
    test = lambda v: F.contains(F.col(text), v) | F.contains(v, F.col(text)) if both else F.contains(F.col(text), v)
    hits = F.filter("_values", test)
    hits = F.slice(hits, 1, 1) if once == "row" else hits
    return rows.join(packed, keys).select(*[F.col(c) for c in rows.columns], F.explode(hits).alias(value))


def _scanned(rows: DataFrame, values: DataFrame, keys: list[str], text: str, value: str, once: str | None) -> DataFrame:
    """Matches of any keys, by automaton."""
    runs, blocks = _large(rows, keys, RUN_TEXTS, "_runs"), _large(values, keys, BLOCK_VALUES, "_blocks")
    left, right = rows.join(runs, keys, "left").join(blocks, keys, "left"), values.join(runs, keys, "left").join(blocks, keys, "left")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    one = lambda c, by: F.pmod(F.xxhash64(*by), F.coalesce(c, F.lit(1))).cast("int")
    left = left.withColumn("_run", one("_runs", [text])).withColumn("_block", every("_blocks"))
    right = right.withColumn("_run", every("_runs")).withColumn("_block", one("_blocks", [value]))
    group = F.to_json(F.struct(*keys, "_run", "_block")).alias("_group")
    kinds = {f.name: f.dataType for f in rows.schema}
    texts = left.select(*rows.columns, F.lit(None).cast("string").alias(value), group)
    told = right.select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], value, group)
    met = texts.unionByName(told).repartition("_group").sortWithinPartitions("_group", F.col(value).isNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, finder, found = None, [], None, set()
        for batch in batches:
            at, hits = [], []
            for i, (group, v, said) in enumerate(zip(batch["_group"].to_pylist(), batch[value].to_pylist(), batch[text].to_pylist())):
                if group != now:
                    now, held, finder, found = group, [], None, set()
                if v is not None:
                    held.append(v)
                    continue
                if not held:
                    continue
                finder = finder or Finder(held)
                mine = finder.find(said)
                if once == "row":
                    mine = mine[:1]
                elif once == "value":
                    mine = [x for x in mine if x not in found]
                    found.update(mine)
                at += [i] * len(mine)
                hits += mine
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[out[c] for c in kinds], pa.array(hits, pa.string())], names=[*kinds, value])

    schema = texts.drop("_group").schema
    return met.mapInArrow(scan, schema)
