"""Alignment of two tokenizers over whole texts, and how often their token pairs stand for the same bytes in a corpus.

Both tokenizers cover the bytes of a blank and the text. Where a token of each ends at the same byte, the tokens are cut into
groups. The common ends are found by galloping: the ends of the tokenizer with fewer tokens are looked up one after the other in the
longer list, by steps that double from the last place on and a binary search in the last step. The ranks of a common end in both lists
cut the groups, their differences are the ranges of tokens that share it. A link is a pair of tokens of one group.

Every document keeps its different id pairs with their number of links, as two id arrays. Pairs are counted in numpy for each
step of documents and summed by Spark, so a pair of all documents is one row a step. Then counts go back to the documents: pairs
so frequent that at most ``HOT_PAIRS`` of them can exist are sent to all tasks and looked up there; the few others
are joined by pair, combined before and after.

Encoding: both tokenizers are exact on words (see ``tokens``); no piece of the second vocabulary holds a blank behind another character or a
line feed, so its merges never cross a word's start, which is checked when the vocabulary is read. Words met before keep
their ids, up to a bound; texts with several blanks in a row are encoded whole.

Defined cases: null and empty texts, and texts whose tokens of either kind don't give the bytes back, have no tokens; control strings
are plain text; repeated rows count each as a document; null ids stay; an empty table gives an empty result; a text's links of any number are counted, in steps of
the first vocabulary's ids, so a step holds about ``STEP_LINKS`` pairs unless one id alone has more.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgrain.llm.common import per_worker, sliced, steps, written
from revgrain.llm.tokens import Encoder

#: Pairs that go to every task, at most: 20 bytes each.
HOT_PAIRS = 200_000
#: Bytes of text aligned at once, and pairs of one step.
STEP_BYTES, STEP_LINKS = 2_000_000, 2_000_000
#: Words of a generation (a worker keeps two) and the longest that is kept.
KEPT, LONGEST = 150_000, 48
MARK = "▁"
GROUPS = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>"
PAIR = 20  # bits of the second id in a pair


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(free)}


class Pieces:
    """Ids of words and texts by a piece vocabulary that puts a marked blank before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.by_word = not any(MARK in n.lstrip(MARK) or "\n" in n for n in names)
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(len(names))]
        self.bytes = [b"" if special[i] else bytes([int(n[1:-1], 16)]) if self.library.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def words(self, keys: list[str]) -> list[bytes]:
        """Ids of words as 32-bit integers; one that begins with NUL stands at the start of a line, without a blank, and "\\n" is the line feed."""
        kept, older = self.kept, self.older
        fresh = [k for k in keys if k not in kept and k not in older]
        bare = [k[1:] if k[:1] == "\0" else k for k in fresh]
        # A line's first word is encoded behind a line feed, which no merge crosses: the blank and the feed go.
        ids = self.whole(["\n" + w if k[:1] == "\0" else w for k, w in zip(fresh, bare)])
        skip = [2 if k[:1] == "\0" else 1 if k == "\n" else 0 for k in fresh]
        made = {k: array("I", x[n:]).tobytes() for k, x, n in zip(fresh, ids, skip)}
        out = [kept[k] if k in kept else older[k] if k in older else made[k] for k in keys]
        kept.update((k, x) for k, x in zip(keys, out) if len(k) <= LONGEST)
        if len(kept) > KEPT:
            self.kept, self.older = {}, kept
        return out


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Ranks in both ascending lists of the values that both hold; the shorter list drives."""
    if len(short) > len(long):
        second, first = gallop(long, short)
        return first, second
    ranks: list[int] = []
    found: list[int] = []
    low, n = 0, len(long)
    for rank, end in enumerate(short):
        if low == n:
            break
        if long[low] < end:
            step = 1
            while low + step < n and long[low + step] < end:
                low += step
                step += step
            # The place is behind ``low`` and not behind ``low + step``.
            low = low + 1 if step == 1 else bisect_left(long, end, low + 1, min(low + step, n))
            if low == n:
                break
        if long[low] == end:
            ranks.append(rank)
            found.append(low)
            low += 1
    return ranks, found


def _flat(parts: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words ``which`` in a row, and where each word's ids begin (with the end)."""
    sizes = np.fromiter(map(len, parts), "<i8", len(parts)) // 4
    table = np.frombuffer(b"".join(parts), dtype="<u4")
    place = np.cumsum(sizes) - sizes
    count = sizes[which]
    upto = np.concatenate(([0], np.cumsum(count)))
    return table[np.repeat(place[which] - upto[:-1], count) + np.arange(upto[-1])].astype("<i8"), upto


class Aligner:
    """Token groups of texts by a byte-level vocabulary (first) and a piece vocabulary (second)."""

    def __init__(self, first: str, second: str):
        self.first, self.second = Encoder(first, words=False, plain=True), Pieces(second)
        table = byte_table()
        vocab = self.first.library.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, n in vocab.items():
            self.bytes[n] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.sizes = [np.array([len(x) for x in some], dtype="<i8") for some in (self.bytes, self.second.bytes)]
        top = max(len(self.bytes), len(self.second.bytes))
        #: Each id with what may follow it, so the groups of a text are one lookup and one join.
        self.said = [f"{n}{c}" for n in range(top) for c in ",|;"]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both vocabularies for each text that isn't empty."""
        keys = pc.split_pattern(pc.replace_substring(texts, "\n", " \n \0"), " ")
        words = keys.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        a = self.first._met(names)
        odd = np.array([x is None for x in a]) if self.second.by_word else np.ones(len(a), dtype=bool)
        known = [k for k, o in zip(names, odd.tolist()) if not o]
        b = dict(zip(known, self.second.words(known)))
        which = words.indices.to_numpy(zero_copy_only=False)
        flat_a, upto_a = _flat([x or b"" for x in a], which)
        flat_b, upto_b = _flat([b.get(k, b"") for k in names], which)
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False)))).astype("<i8")
        met = np.concatenate(([0], np.cumsum(odd[which])))[bounds]
        slow = (met[1:] > met[:-1]) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        out = []
        for i, whole in enumerate(slow.tolist()):
            if whole:
                text = texts[i].as_py()
                out.append((np.frombuffer(self.first._slowly(" " + text), dtype="<u4").astype("<i8"), np.array(self.second.whole([text])[0], dtype="<i8")))
            else:
                at, to = bounds[i], bounds[i + 1]
                out.append((flat_a[upto_a[at]:upto_a[to]], flat_b[upto_b[at]:upto_b[to]]))
        return out

    def groups(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The group of each token of both kinds; None if the tokens don't give back the text's bytes."""
        told = b" " + text.encode()
        if b"".join(map(self.bytes.__getitem__, a.tolist())) != told or b"".join(map(self.second.bytes.__getitem__, b.tolist())) != told:
            return None
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # Several tokens may end at one byte only if one is empty, and none is.
        ranks_a, ranks_b = gallop(ends_a.tolist(), ends_b.tolist())
        return _numbered(ranks_a), _numbered(ranks_b)

    def spell(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """The groups as text: ids of the first kind, a bar, ids of the second, groups parted by semicolons."""
        where = np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(where, kind="stable")
        where = where[order]
        after = np.append(where[1:], where[-1] + 1) - where  # 0 inside a list, 1 at its end
        mark = np.where(after == 0, 0, 1 + (where & 1))
        return "".join(map(self.said.__getitem__, (3 * np.concatenate((a, b))[order] + mark).tolist()))[:-1]


def _numbered(ranks: list[int]) -> np.ndarray:
    """The group of each token up to the last common end."""
    return np.repeat(np.arange(len(ranks)), np.diff(ranks, prepend=-1))


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id) in the order of groups, with how often each occurs."""
    keys, times = np.unique((group << PAIR) | ids, return_counts=True)
    return keys >> PAIR, keys & ((1 << PAIR) - 1), times


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different pairs of ids that share a group, with their links, ascending, in steps of the first id.

    A pair is the first id shifted by ``PAIR`` bits and the second. Groups may be of several documents, if ids carry the document in higher bits.
    """
    ga, ia, ta = _counted(group_a, a)
    gb, ib, tb = _counted(group_b, b)
    begin = np.searchsorted(gb, np.arange(n_groups + 1))
    count = begin[ga + 1] - begin[ga]
    by_id = np.argsort(ia, kind="stable")
    upto = np.cumsum(count[by_id])
    cut = 0
    while cut < len(by_id):
        base = upto[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(upto, base + STEP_LINKS, side="right")))
        while stop < len(by_id) and ia[by_id[stop]] == ia[by_id[stop - 1]]:
            stop += 1  # an id's pairs stay together
        some = by_id[cut:stop]
        n = count[some]
        first = np.cumsum(n) - n
        other = np.repeat(begin[ga[some]] - first, n) + np.arange(int(n.sum()))
        pairs = (np.repeat(ia[some], n) << PAIR) | ib[other]
        times = np.repeat(ta[some], n) * tb[other]
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        yield pairs[at], np.add.reduceat(times[order], at)
        cut = stop


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def aligned(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Groups and pairs of every document, see ``GROUPS``; ``groups`` is the text or, by ``digest``, its SHA-256 ('' without tokens).

    A document of very many pairs has further rows, whose ``n_a`` and other counts are null.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = per_worker(f"aligner:{first}:{second}", lambda: Aligner(first, second))
        for batch in batches:
            at = 0
            for texts in steps(batch.column(2), STEP_BYTES):
                ids = batch.slice(at, len(texts))
                at += len(texts)
                yield from _step(made, texts, ids.column(0), ids.column(1), digest)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(align, GROUPS)


def _step(made: Aligner, texts: pa.Array, rows: pa.Array, ids: pa.Array, digest: bool) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    told = texts.take(pa.array(some))
    whole = []  # (place, tokens and their groups of both kinds, groups, links)
    for i, text, (a, b) in zip(some.tolist(), told.to_pylist(), made.encode(told)):
        cut = made.groups(text, a, b)
        if cut is not None:
            n = int(cut[0][-1]) + 1
            whole.append((i, a, cut[0], b, cut[1], n, int((np.bincount(cut[0], minlength=n) * np.bincount(cut[1], minlength=n)).sum())))

    def rows_of(docs: list, heads: bool, lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at = pa.array([x[0] for x in docs], pa.int64())
        offsets = np.cumsum([0] + [len(p) for p, _ in lists])
        pairs, times = (np.concatenate([np.zeros(0, "<i8"), *some]) for some in (zip(*lists) if lists else ((), ())))
        pairs &= (1 << 2 * PAIR) - 1
        counts = [pa.array([x[k] if heads else None for x in stats], pa.int64()) for stats in [[(len(x[1]), len(x[3]), x[5], x[6]) for x in docs]] for k in range(4)]
        said = [made.spell(x[1], x[3], x[2], x[4]) if heads and x[5] else "" for x in docs]
        said = pa.array([(hashlib.sha256(s.encode()).hexdigest() if digest and s else s) if heads else None for s in said], pa.string())
        columns = [rows.take(at), ids.take(at), *counts, said, _lists(pairs >> PAIR, offsets), _lists(pairs & ((1 << PAIR) - 1), offsets), _lists(times, offsets)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in GROUPS.split(", ")])

    none = np.zeros(0, "<i8")
    bare = [(i, none, none, none, none, 0, 0) for i in sorted(set(range(len(texts))) - {x[0] for x in whole})]
    if bare:
        yield rows_of(bare, True, [(none, none)] * len(bare))
    while whole:
        upto, take = whole[0][6], 1
        while take < len(whole) and upto + whole[take][6] <= STEP_LINKS:
            upto += whole[take][6]
            take += 1
        now, whole = whole[:take], whole[take:]
        if upto > STEP_LINKS:  # one document alone
            _, a, group_a, b, group_b, n, _ = now[0]
            for k, part in enumerate(linked(group_a, a, group_b, b, n)):
                yield rows_of(now, k == 0, [part])
        else:
            pairs, times = _together(now)
            cuts = np.searchsorted(pairs >> (2 * PAIR), np.arange(take + 1))
            yield rows_of(now, True, [(pairs[s:e], times[s:e]) for s, e in zip(cuts[:-1], cuts[1:])])


def _together(docs: list) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of several documents with their links; the document's number stands above the first id."""
    base = np.cumsum([0] + [x[5] for x in docs])
    a, b = np.concatenate([x[1] for x in docs]), np.concatenate([x[3] for x in docs])
    group_a, group_b = (np.concatenate([x[k] + s for x, s in zip(docs, base)]) for k in (2, 4))
    doc = np.repeat(np.arange(len(docs)), [len(x[1]) for x in docs])
    begin = np.searchsorted(group_b, np.arange(base[-1] + 1))
    count = begin[group_a + 1] - begin[group_a]
    first = np.cumsum(count) - count
    other = np.repeat(begin[group_a] - first, count) + np.arange(int(count.sum()))
    return np.unique((np.repeat((doc << PAIR) | a, count) << PAIR) | b[other], return_counts=True)


def pair_counts(groups: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no pair of its first id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype("<i8") for k in range(2))
            for s in range(0, len(a), STEP_LINKS):
                pairs, n = np.unique((a[s:s + STEP_LINKS] << PAIR) | b[s:s + STEP_LINKS], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype("<i8"))], names=["pair", "n"])

    n = written(groups.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    top = n.groupBy(F.shiftright("pair", PAIR).alias("a")).agg(F.max("n").alias("most"))
    return n.join(top, F.shiftright("pair", PAIR) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every document: links whose pair is the best of its first id, and the sum of counts over links."""
    spark = groups.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // HOT_PAIRS
    hot = counts.filter(F.col("n") > least).orderBy("pair").toPandas()  # fewer than HOT_PAIRS rows can have such a count
    sent = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in sliced(batches):
            a, b, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype("<i8") for k in (1, 2, 3))
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("<i8"))))

            def by_row(values: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])

            mine = (a << PAIR) | b
            known = np.zeros(len(mine), dtype=bool)
            own_n, own_best = np.zeros((2, len(mine)), dtype="<i8")
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                known = pairs[at] == mine
                own_n, own_best = np.where(known, n[at], 0), np.where(known, best[at], 0)
            offsets = np.concatenate(([0], np.cumsum(by_row(~known))))
            left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(mine[~known]))
            columns = [batch.column(0), pa.array(by_row(times * own_best)), pa.array(by_row(times * own_n)), left, _lists(times[~known], offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_best", "count_sum", "pairs", "times"])

    seen = written(groups.select("row", "a", "b", "times").mapInArrow(look, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"), "align-scores")
    rest = seen.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    rare = counts.filter(F.col("n") <= least)
    more = rest.join(rare, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return seen.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each document: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    groups = written(aligned(docs, first, second, id_col, text_col, digest), "align-groups")
    counts = written(pair_counts(groups), "align-counts")
    heads = groups.filter("n_a is not null").select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return heads.join(scored(groups, counts), "row").drop("row")
