"""Token ids of whole texts by the tokenizers library, each different piece of text encoded once a worker.

Both tokenizer kinds cut a text at white space and then into pieces (runs of letters, digits or signs) before they merge,
so the ids of a text are those of its pieces in a row. A worker keeps the ids of the chunks and pieces it has met, up to a
bound, and hands only new pieces to the library: to its model, which merges one piece, or, if a piece has rare characters,
many in one text, with separators that show in the ids. A text with rare white space or a control string of the vocabulary,
and a chunk of rare characters, goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from revgrain.llm.common import give_back, per_worker, steps

#: Words of a generation (a worker keeps two) and pieces that are kept, the longest of them, and pieces handed over in one text.
#: An entry takes about 200 bytes, 570 at most, so the words of a worker take about 100 MB, 290 MB at most.
KEPT, PIECES, LONGEST, TOGETHER = 250_000, 40_000, 48, 1_024
#: Bytes of text cut and looked up at once.
STEP = 4_000_000
#: Signs that may end a word; a run of them behind letters is a piece of its own in both vocabularies.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Python's white space and what the library might count as such.
SPACE = re.compile("[\\s\x85\u180e\u200b\ufeff]")
#: White space on which Python and the library might disagree.
RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A word with the blank before it, or a run of white space.
BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Chunks whose lower case and normal form hold no surprise.
COMMON = re.compile("[!-~\xa1-\u017f]+")
#: Byte-level vocabularies spell each byte as a character: those that print as themselves, the others as those from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(PRINTED)))}
#: Whether a piece has characters alone that are spelled as themselves, behind a blank or without one.
PLAIN = re.compile("[ !-~][!-~]*").fullmatch
#: The patterns by which the two vocabularies cut chunks into pieces.
WORD_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTE_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. ``words``: the vocabulary marks word ends and drops white space.

    ``plain``: control strings of the vocabulary inside a text are ordinary text.
    """

    def __init__(self, path: str, words: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.words = Tokenizer.from_file(path), words
        self.library.encode_special_tokens = plain
        self.model = self.library.model
        self.control = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Ids by key (see ``_keys``), the words met lately and those before; None if a text with this key needs a closer look.
        self.kept: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.long = False  # whether a piece of any length is among them
        if words:
            self.last = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.last[[n for t, n in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        else:
            self.feed = self.library.encode("\n", add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._library(texts)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one text of all of them."""
        ids = np.array(self._library([(" " if self.words else "\n").join(pieces)])[0], dtype="<u4")
        if self.words:
            cuts = np.flatnonzero(self.last[ids]) + 1
            begins, ends = [0, *cuts[:-1].tolist()], cuts.tolist()
        else:
            cuts = np.flatnonzero(ids == self.feed[0]).tolist()
            begins, ends = [0, *[c + 1 for c in cuts]], [*cuts, len(ids)]
        if len(ends) != len(pieces) or (not self.words and len(self.feed) != 1):
            return self._alone(pieces)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(begins, ends)]

    def _list(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. The library's model merges a piece of common characters; the library itself takes the others, as it might cut them."""
        merge = self.model.tokenize
        others = [n for n, piece in enumerate(pieces) if not PLAIN(piece)]
        spelled = [f"Ġ{piece[1:]}" if piece[:1] == " " else piece for piece in pieces]
        for n in others:
            spelled[n] = pieces[n].encode().decode("latin-1").translate(SPELLED) if COMMON.fullmatch(pieces[n], pieces[n][:1] == " ") else ""
        out = [array("I", [t.id for t in merge(piece)]).tobytes() if piece else b"" for piece in spelled]
        others = [n for n in others if not spelled[n]]
        for at in range(0, len(others), TOGETHER):
            some = others[at:at + TOGETHER]
            for n, ids in zip(some, self._together([pieces[n] for n in some])):
                out[n] = ids
        return out

    def _many(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces."""
        return dict(zip(pieces, self._list(pieces)))

    def _pieces(self, pieces: set[str]) -> None:
        """Have these pieces at hand; those met before are let go as they get many."""
        if len(self.pieces) > PIECES or self.long:
            self.pieces, self.long = ({}, False) if len(self.pieces) > PIECES else ({p: x for p, x in self.pieces.items() if len(p) <= LONGEST}, False)
        self.pieces.update(self._many(list(pieces.difference(self.pieces))))
        self.long = any(len(p) > LONGEST for p in pieces)

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of different chunks of any kind."""
        if self.words:
            parts = {c: WORD_PIECE.findall(c.lower()) for c in chunks if COMMON.fullmatch(c)}
        else:
            parts = {c: BYTE_PIECE.findall(c) for c in chunks if not c.isspace()}
        self._pieces(set(chain.from_iterable(parts.values())))
        look = self.pieces.__getitem__
        out = {c: b"".join(map(look, p)) for c, p in parts.items()}
        others = [c for c in chunks if c not in out]
        out.update(zip(others, self._alone(others)))
        return out

    def _keys(self, texts: pa.Array) -> pa.Array:
        """Words between single blanks, a list a text. For a byte-level vocabulary, NUL stands before the first word of a line."""
        if self.words:
            return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        marked = pc.binary_join_element_wise(pa.scalar("\0", texts.type), texts, pa.scalar("", texts.type))
        return pc.split_pattern(pc.replace_substring(marked, "\n", " \n \0"), " ")

    def _fresh(self, keys: list[str]) -> dict[str, bytes | None]:
        """Ids by key; None for a control string, and for what shows more than one blank or other white space in its text."""
        plain, signed, others, odd = [], [], {}, []
        for key in keys:
            if key.isalpha() and (not self.words or self._common(key)):
                plain.append(key)
                continue
            word = key[1:] if key[:1] == "\0" and not self.words else key
            bare = word.rstrip(SIGNS)
            if bare.isalpha() and (not self.words or self._common(bare)):
                if len(bare) < len(word):
                    signed.append((key, key[:len(bare) - len(word)], word[len(bare):]))
                else:
                    plain.append(key)
            elif key == "\n":
                others[key] = key
            elif not (word or self.words) or "\0" in word or SPACE.search(word) or any(c in word for c in self.control):
                odd.append(key)
            else:
                others[key] = word if self.words or word is not key else " " + word
        out: dict[str, bytes | None] = dict(zip(plain, self._list([self._letters(k) for k in plain])))
        # Letters with signs behind them: the word may be known by itself.
        heads = [h for h in {h for _, h, _ in signed} if h not in out and h not in self.kept and h not in self.older]
        alone = dict(zip(heads, self._list([self._letters(h) for h in heads])))
        self._pieces({tail for _, _, tail in signed})
        for key, head, tail in signed:
            out[key] = (alone.get(head) or out.get(head) or self.kept.get(head) or self.older[head]) + self.pieces[tail]
        out.update((h, ids) for h, ids in alone.items() if len(h) <= LONGEST)
        ids = self._chunks(list(set(others.values())))
        out.update((k, ids[c]) for k, c in others.items())
        out.update((k, None) for k in odd)
        return out

    @staticmethod
    def _common(letters: str) -> bool:
        return letters.isascii() or bool(COMMON.fullmatch(letters)) and letters.lower().isalpha()

    def _letters(self, key: str) -> str:
        """The piece of a key that is letters alone."""
        return key.lower() if self.words else key[1:] if key[:1] == "\0" else " " + key

    def _met(self, keys: list[str]) -> list[bytes | None]:
        """Ids of different keys."""
        kept, older, fresh = self.kept, self.older, []
        for k in [k for k in keys if k not in kept]:
            if k in older:
                kept[k] = older[k]
            else:
                fresh.append(k)
        kept.update(self._fresh(fresh))
        out = list(map(kept.__getitem__, keys))
        for k in fresh:
            if len(k) > LONGEST:
                del kept[k]
        if len(kept) > KEPT:
            self.kept, self.older = {}, kept
        return out

    def _slowly(self, text: str) -> bytes:
        """Ids of a text with more than one white space between words, rare white space or control strings."""
        if RARE.search(text) or any(c in text for c in self.control):
            return self._alone([text])[0]
        chunks = text.split() if self.words else BYTE_CHUNK.findall(text)
        ids = self._chunks(list(set(chunks)))
        return b"".join(map(ids.__getitem__, chunks))

    def _encode(self, texts: pa.Array) -> list[bytes]:
        keys = self._keys(texts)
        words = keys.flatten().dictionary_encode()
        parts = self._met(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        count = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
        ids = pa.array(parts, pa.large_binary()).take(words.indices)
        bounds = np.concatenate(([0], np.cumsum(count))).astype("<i8")
        odd = np.concatenate(([0], np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))))[bounds]
        odd = (odd[1:] > odd[:-1]) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        _, upto, raw = ids.buffers()
        ends, raw, odd = np.frombuffer(upto, dtype="<i8")[bounds].tolist(), memoryview(raw or b""), odd.tolist()
        return [self._slowly(texts[i].as_py()) if o else raw[ends[i]:ends[i + 1]].tobytes() for i, o in enumerate(odd)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text."""
        out = [ids for some in steps(texts, STEP) for ids in self._encode(some)]
        give_back()
        return out


def encoder(path: str, words: bool) -> Encoder:
    return per_worker(f"encoder:{path}:{words}", lambda: Encoder(path, words))


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")


def encoded(path: str, words: bool, texts: pa.Array, end: int) -> list[bytes]:
    """Ids of each text (null: empty) with the id ``end`` behind them."""
    tail = array("I", [end]).tobytes()
    return [ids + tail for ids in encoder(path, words).encode(texts)]
