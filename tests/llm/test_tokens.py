"""Token ids, token files, packing and the unigram tokenizer against the libraries and plain versions."""

import random
from array import array
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from revgrain.llm import packing, token_store, tokens, unigram
from revgrain.llm.queries import TOKENIZERS

WORDS, BYTES, PIECES = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
ALPHABET = [*"ab cd  \n\t'sS.,!%é ñß12²½ªºÅΣσ İ\x1c\xa0​　漢字é<|>_-\"\0", "<|endoftext|>", "'re", "\r\n", "\n \n", "   ", "don't", "Σ. ", "<|ENDOFTEXT|>"]


def fuzz(n, size=60, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABET, k=draw.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("path, words", [(WORDS, True), (BYTES, False)])
def test_ids_are_the_librarys(path, words):
    library = Tokenizer.from_file(path)
    texts = fuzz(4_000) + ["", " ", "x" * 5_000, "the cat\n\nsat", "The cat sat.\nThe End "]
    want = [array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(path, words)
    assert encoder.encode(pa.array(texts)) == want
    assert encoder.encode(pa.array(texts[::-1])) == want[::-1]
    for part in (pa.array(texts).slice(700, 900), pa.array(texts, pa.large_string()).slice(700, 900).slice(100)):  # views into larger buffers
        assert encoder.encode(part) == want[1_600 - len(part):1_600]
    long = texts * 60  # several steps
    assert encoder.encode(pa.array(long)) == want * 60
    assert encoder.encode(pa.array([None, "a"]))[0] == b"" and encoder.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("path, words", [(WORDS, True), (BYTES, False)])
def test_common_pieces_go_to_the_model_alone(path, words, monkeypatch):
    sent = []
    plain = tokens.Encoder._together
    monkeypatch.setattr(tokens.Encoder, "_together", lambda self, pieces: sent.extend(pieces) or plain(self, pieces))
    draw = random.Random(3)
    common = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180)]]
    texts = [" ".join("".join(draw.choices(common, k=draw.randrange(1, 9))) + draw.choice(["", ".", ",\n", "!?"]) for _ in range(12)) for _ in range(1_500)]
    texts += ["".join(c) for c in zip(common, common[::-1])] + common + ["Grüße, naïve façade\nÀ côté:", "漢字 " + "word " * 3]
    want = [array("I", e.ids).tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(path, words).encode(pa.array(texts)) == want
    assert not [p for p in sent if tokens.COMMON.fullmatch(p.strip(" "))]


def test_token_files_read_back(spark, docs):
    rows = [(5, "the cat sat on the mat " * k) for k in range(3)] + [(2, None), (9, ""), (9, ""), (-3, "x" * 3_000)] + [(i, f"text {i} of many") for i in range(10, 300)]
    library = Tokenizer.from_file(WORDS)
    folder = token_store.write_tokens(docs(rows), path=WORDS, words=True, end=1, shards=5)
    got = token_store.read_all(spark, folder).collect()
    assert len(got) == len(rows) and sorted(r.id for r in got) == sorted(i for i, _ in rows)
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in rows if i != 5}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.id != 5:
            assert (r.n_tokens, r.ids_crc32) == (len(want[r.id]), crc32(want[r.id].tobytes()))
    assert [r.id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows)
    some = token_store.read_documents(spark, folder, [-3, 77])
    assert set(some) == {-3, 77} and all((some[i] == want[i]).all() for i in some)
    with pytest.raises(ValueError):
        token_store.Frames(b"", False).ids(b"", 0, 0, "another")


def test_token_files_of_nothing(spark, docs):
    assert token_store.read_all(spark, token_store.write_tokens(docs([]), path=WORDS, words=True, end=1)).count() == 0


def check_packing(rows, size):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_plan_uses_every_document_once():
    draw = np.random.default_rng(5)
    for n, size in ((0, 64), (1, 64), (500, 64), (40_000, 128), (3_000, 1024)):
        hist = np.bincount(np.minimum(draw.geometric(4 / size, size=n), size), minlength=size + 1)
        used = np.zeros(size + 1, dtype=int)
        sequences = 0
        for pattern, times in packing.plan(hist, size):
            assert sum(pattern) <= size and times > 0
            sequences += times
            for length in pattern:
                used[length] += times
        assert (used == hist).all()
        least = -(-int((hist * np.arange(size + 1)).sum()) // size)
        assert sequences <= max(least * 1.02, least + 3)


def test_packed_pieces(docs):
    draw = random.Random(4)
    rows = [(i, "a b " * draw.choice([1, 5, 5, 5, 40, 700])) for i in range(400)] + [(400, None), (401, ""), (7, "twice"), (7, "twice")]
    library = Tokenizer.from_file(BYTES)
    out = packing.pack(packing.pieces(docs(rows), BYTES, False, 2)).collect()
    n = check_packing(out, 1024)
    total = sum(r.length for r in out)
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows) and n <= -(-total // 1024) * 1.02 + 2
    for r in out:
        assert r.length == 1024 or r.piece == 0
        if r.doc_id == 400:
            assert (r.length, r.ids_crc32) == (1, crc32(array("I", [2]).tobytes()))
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == next(i for i, t in rows if len(t or "") == 2_800))
    assert len(long) == 2 and long[1][1] == long[0][2] and long[1][2] == 1024
    assert packing.pack(packing.pieces(docs([]), BYTES, False, 2)).count() == 0


def test_pieces_take_one_python_worker_a_task(docs, monkeypatch):
    plans = []
    plain = packing.written
    monkeypatch.setattr(packing, "written", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more))
    made = packing.pieces(docs([(i, "a b " * (i % 5)) for i in range(300)]).repartition(3), BYTES, False, 2)
    rows = packing.numbered(made).select("length", "nth").collect()
    assert [p.count("MapInArrow") for p in plans] == [1]
    met = defaultdict(list)
    for r in rows:
        met[r.length].append(r.nth)
    assert len(rows) == 300 and all(sorted(n) == list(range(len(n))) for n in met.values())


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.pieces_of(PIECES)


def best_sum(text, v, scores):
    """The best sum of scores over all segmentations, by trying every piece at every place."""
    word = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [0.0] + [-np.inf] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + 48) + 1):
            s = scores.get(word[i:j], v.unknown if j == i + 1 else -np.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_unigram_is_best_and_reversible(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    coder = unigram.Unigram(vocabulary)
    draw = random.Random(6)
    letters = [*"abcdefghij the  \nñß漢🙂.\t", "the ", "ing "]
    texts = ["", " ", "a", " a", "a ", "\n", "\n\na", "the " * 30, "x" * 300, "naïve 漢字 🙂\n end"] + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(300)]
    got = list(coder.encode(pa.array(texts)))
    for text, raw in zip(texts, got):
        ids = np.frombuffer(raw, dtype="<u4").tolist()
        assert coder.decode(raw) == text == model.decode(ids)
        total, k = 0.0, 0
        while k < len(ids):
            piece = model.id_to_piece(ids[k])
            if model.is_byte(ids[k]):  # all bytes of one unknown character
                first = int(piece[3:5], 16)
                k += 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                total += vocabulary.unknown
            else:
                total, k = total + scores[piece], k + 1
        assert total == best_sum(text, vocabulary, scores)
    assert list(coder.encode(pa.array([None, "a▁b"], pa.string())))[0] == b""


def test_trie_holds_its_keys_alone(vocabulary):
    draw = random.Random(8)
    keys = sorted({bytes(draw.choices(range(97, 101), k=draw.randrange(1, 7))) for _ in range(500)})
    base, check, value = unigram.double_array([(k, i) for i, k in enumerate(keys)])

    def find(word):
        state = 0
        for b in word:
            if check[base[state] + b] != state:
                return -1
            state = base[state] + b
        return value[state]

    assert all(find(k) == i for i, k in enumerate(keys))
    absent = {bytes(draw.choices(range(97, 102), k=draw.randrange(1, 8))) for _ in range(500)} - set(keys)
    assert all(find(k) == -1 for k in absent)


def test_unigram_rows(docs):
    rows = docs([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (4, "w " * 20_000)])
    out = {r.id: r.text for r in unigram.decode(unigram.encode(rows, PIECES), PIECES).collect()}
    assert out == {1: "", 2: "", 3: "the cat", 4: "w " * 20_000}
    assert unigram.decode(unigram.encode(docs([]), PIECES), PIECES).count() == 0
