"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space markers.

``pieces_of`` reads a vocabulary (pieces, scores, kinds) through the sentencepiece library; encoding and decoding are done
here. The trie holds the UTF-8 bytes of all matchable pieces in two arrays: from state s, byte b leads to base[s] + b if check
there says s. The best segmentation maximises the sum of scores; a character that is no piece of its own may be taken as
unknown at the lowest score less ten, and is written as its byte pieces. Of equal sums the one whose last piece begins first
wins, as in the library; sums are in double precision.

No piece crosses the start of a word (a marker behind another character) or a line feed; that is checked when the
vocabulary is read, so a text is the row of its words and each different word of a step is solved once, many words at a time,
position by position. Texts with runs of blanks are cut at their runs.

Defined cases: a null text counts as empty and has no ids; control pieces don't come out of texts; decoding drops control
pieces and the one blank the encoder put in front; bytes that form no UTF-8 become U+FFFD; repeated rows are encoded each;
an empty table gives an empty result; texts are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgrain.llm.common import per_worker, sliced, steps

MARK = "▁"
#: Words of a generation a worker keeps (it keeps two), bytes of a word solved with others, and words solved at once.
KEPT, SHORT, TOGETHER = 220_000, 64, 4_096
RUN = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Vocabulary(NamedTuple):
    """Plain arrays that travel to the workers."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    unknown: float
    byte_ids: list[int]
    unknown_id: int
    written: list[bytes]
    depth: int


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie over sorted, different keys."""
    room = 1 << 10
    base, check, value = [0] * room, [-1] * room, [-1] * room
    free = 1
    work = [(0, 0, len(keys), 0)]
    while work:
        state, low, high, depth = work.pop()
        if len(keys[low][0]) == depth:
            value[state] = keys[low][1]
            low += 1
        groups: list[tuple[int, int, int]] = []
        at = low
        while at < high:
            byte, begin = keys[at][0][depth], at
            while at < high and keys[at][0][depth] == byte:
                at += 1
            groups.append((byte, begin, at))
        if not groups:
            continue
        while free < len(check) and check[free] >= 0:
            free += 1
        place, tries = max(1, free - groups[0][0]), 0
        while True:
            while place + 256 >= len(check):
                base += [0] * len(base)
                value += [-1] * len(value)
                check += [-1] * len(check)
            if all(check[place + byte] < 0 for byte, _, _ in groups):
                break
            place, tries = place + 1, tries + 1
        if tries > 16:  # leave a crowded stretch behind instead of trying it again for every node
            free = place
        base[state] = place
        for byte, _, _ in groups:
            check[place + byte] = state
        work += [(place + byte, begin, end, depth + 1) for byte, begin, end in groups]
    return np.array(base, dtype=np.int64), np.array(check, dtype=np.int64), np.array(value, dtype=np.int64)


def pieces_of(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)], dtype=float)
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    crossing = [pieces[i] for i in plain if re.search(f"[^{MARK}]{MARK}", pieces[i]) or "\n" in pieces[i] or "\0" in pieces[i]]
    if crossing:
        raise ValueError(f"pieces cross word or line starts: {crossing[:5]}")
    keys = sorted((pieces[i].encode(), i) for i in plain)
    bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    said = []
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            said.append(bytes([int(p[3:5], 16)]))
        else:
            said.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode())
    base, check, value = double_array(keys)
    return Vocabulary(base, check, value, scores, float(scores[plain].min()) - 10, [bytes_.get(b, -1) for b in range(256)], model.unk_id(), said, max(len(k) for k, _ in keys))


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kept: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _fallback(self, raw: bytes) -> list[int]:
        ids = [self.v.byte_ids[b] for b in raw]
        return [self.v.unknown_id] if min(ids) < 0 else ids

    def one(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        v, n = self.v, len(word)
        base, check, value, score = v.base, v.check, v.value, v.score
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            first = word[i]
            size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            state, single = 0, False
            for j in range(i, min(n, i + v.depth)):
                then = base[state] + word[j]
                if check[then] != state:
                    break
                state = then
                if (p := value[state]) >= 0:
                    single |= j + 1 - i == size
                    if best[i] + score[p] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = best[i] + score[p], i, int(p)
            if not single and best[i] + v.unknown > best[i + size]:
                best[i + size], back[i + size], piece[i + size] = best[i] + v.unknown, i, -1
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] >= 0 else self._fallback(word[back[n]:n])[::-1]
            n = back[n]
        return out[::-1]

    def many(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, solved side by side."""
        v, n = self.v, len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        width = int(size.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width).astype(np.int64)
        best, back, piece = np.full((n, width + 4), -np.inf), np.zeros((n, width + 4), dtype=np.int64), np.full((n, width + 4), -1, dtype=np.int64)
        best[:, 0] = 0
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (size > i))
            if not len(rows):
                continue
            first = text[rows, i]
            letter = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            single, now = np.zeros(len(rows), dtype=bool), best[rows, i]
            at, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
            for j in range(i, min(width, i + v.depth)):
                live = size[rows[at]] > j
                at, state = at[live], state[live]
                then = v.base[state] + text[rows[at], j]
                live = v.check[then] == state
                at, state = at[live], then[live]
                if not len(at):
                    break
                p = v.value[state]
                whole = np.flatnonzero(p >= 0)
                if len(whole):
                    who, what = at[whole], p[whole]
                    single[who] |= letter[who] == j + 1 - i
                    sums = now[who] + v.score[what]
                    better = sums > best[rows[who], j + 1]
                    r = rows[who[better]]
                    best[r, j + 1], back[r, j + 1], piece[r, j + 1] = sums[better], i, what[better]
            who = np.flatnonzero(~single)
            sums, ends = now[who] + v.unknown, i + letter[who]
            better = sums > best[rows[who], ends]
            r, ends = rows[who[better]], ends[better]
            best[r, ends], back[r, ends], piece[r, ends] = sums[better], i, -1
        steps, place = [], size.copy()
        every = np.arange(n)
        while place.any():
            steps.append(np.where(place > 0, piece[every, place], -2))
            place = np.where(place > 0, back[every, place], 0)
        ids = np.stack(steps[::-1], axis=1)
        there = ids != -2
        ends = np.cumsum(there.sum(axis=1)).tolist()
        raw = ids[there].astype("<u4").tobytes()
        unknown = (ids == -1).any(axis=1).tolist()
        return [array("I", self.one(w)).tobytes() if u else raw[4 * a:4 * b] for w, u, a, b in zip(words, unknown, [0, *ends], ends)]

    def _solve(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        short = sorted((k for k, w in enumerate(words) if 0 < len(w) <= SHORT), key=lambda k: len(words[k]))
        for at in range(0, len(short), TOGETHER):
            some = short[at:at + TOGETHER]
            for k, ids in zip(some, self.many([words[k] for k in some])):
                out[k] = ids
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = array("I", self.one(w)).tobytes()
        return out

    def _met(self, keys: list[str]) -> list[bytes | None]:
        kept, older, fresh, words = self.kept, self.older, [], []
        for k in [k for k in keys if k not in kept]:
            if k in older:
                kept[k] = older[k]
            elif not k or MARK in k or "\0" in k[1:]:
                kept[k] = None  # a run of blanks, or a marker in the text itself
            else:
                fresh.append(k)
                words.append((k if k == "\n" else k[1:] if k[0] == "\0" else MARK + k).encode(errors="replace"))
        kept.update(zip(fresh, self._solve(words)))
        out = list(map(kept.__getitem__, keys))
        for k in fresh:
            if len(k) > SHORT:
                del kept[k]
        if len(kept) > KEPT:
            self.kept, self.older = {}, kept
        return out

    def _slowly(self, text: str) -> bytes:
        """Ids of a text with runs of blanks."""
        if not text:
            return b""
        return b"".join(self._solve([w.encode(errors="replace") for w in RUN.findall(MARK + text.replace(" ", MARK))]))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for some in steps(texts):
            keys = pc.split_pattern(pc.replace_substring(some, "\n", " \n \0"), " ")
            words = keys.flatten().dictionary_encode()
            parts = self._met(words.dictionary.to_pylist())
            which = words.indices.to_numpy(zero_copy_only=False).tolist()
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False)))).astype(int).tolist()
            marked = pc.match_substring(some, "\0").to_pylist()
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                own = [parts[w] for w in which[a:b]]
                yield self._slowly(some[k].as_py()) if marked[k] or None in own else b"".join(own)

    def decode(self, raw: bytes) -> str:
        said = self.v.written
        out = b"".join([said[i] for i in np.frombuffer(raw, dtype="<u4").tolist()])
        return out.removeprefix(b" ").decode(errors="replace")


def _worker(path: str, sent) -> Unigram:
    return per_worker(f"unigram:{path}", lambda: Unigram(Vocabulary(*sent.value)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id, ids) with ``ids`` as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(pieces_of(path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path, sent)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(model.encode(batch.column(1))), pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Texts of every row of ids: (id, ids, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(pieces_of(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path, sent)
        for batch in sliced(batches):
            yield batch.append_column("text", pa.array([model.decode(x) for x in batch.column("ids").to_pylist()], pa.string()))

    return rows.select("id", "ids").mapInArrow(run, "id long, ids binary, text string")
