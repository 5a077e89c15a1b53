"""Alignment of two vocabularies against a plain version on the libraries' own ids."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revgrain.llm import align
from revgrain.llm.queries import TOKENIZERS

FIRST, SECOND = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def brute_force(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    chars = align.byte_table()
    texts = {n: (" " + t) for n, (_, t) in enumerate(rows) if t}
    found = {}
    for n, text in texts.items():
        ids_a = a.encode(text, add_special_tokens=False).ids
        ids_b = b.encode(text[1:])
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != text.encode() or b"".join(bytes_b) != text.encode():
            continue
        groups, i, j = [], 0, 0
        while i < len(ids_a):
            s, t, x, y = i, j, len(bytes_a[i]), len(bytes_b[j])
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    x, i = x + len(bytes_a[i]), i + 1
                else:
                    y, j = y + len(bytes_b[j]), j + 1
            groups.append((ids_a[s:i], ids_b[t:j]))
        found[n] = (len(ids_a), len(ids_b), groups)
    links = {n: Counter((x, y) for g, h in f[2] for x in g for y in h) for n, f in found.items()}
    count = Counter(p for c in links.values() for p in c)
    best = {}
    for (x, _), k in count.items():
        best[x] = max(best.get(x, 0), k)
    out = []
    for n, (i, _) in enumerate(rows):
        if n not in found:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        la, lb, groups = found[n]
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        c = links[n]
        out.append((
            i, la, lb, len(groups), sum(c.values()), sum(k for p, k in c.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in c.items()),
            hashlib.sha256(said.encode()).hexdigest(),
        ))
    return out


def rows():
    random.seed(11)
    words = ["the", "token", "naïve", "Straße", "don't", "\U0001f642", "<|endoftext|>", "<s>", "</s>", "<unk>", "1234", "x\r", "a\xa0b", "▁", "日本語", "é", "\t", "\x00", "　", "​", "()", ";\r"]
    made = [(n, random.choice([" ", "\n", "  ", " "]).join(random.choices(words, k=random.randint(1, 12)))) for n in range(150)]
    made += [(n, " ".join(random.choices(["more", "than", "one", "ordinary", "Sentence,", "l'été"], k=30))) for n in range(200, 240)]
    hard = ["", None, " ", "\n", "  x  ", "a" * 3_000, "ab" * 1_000, "\n\n\n", "x\n\ny", "é" * 500, "﻿x", "<|endoftext|>", "▁▁", "=" * 700, "word " * 5_000]
    return made + list(enumerate(hard, 500)) + [(7, "the same"), (7, "the same"), (None, "the same")]


@pytest.mark.parametrize("hot, step", [(200_000, 2_000_000), (3, 2_000), (10**9, 50)])
def test_alignment(docs, monkeypatch, hot, step):
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    monkeypatch.setattr(align, "STEP_LINKS", step)
    got = align.alignment(docs(rows()), FIRST, SECOND, digest=True).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_force(rows()), key=repr)


def test_groups_as_text_and_no_rows(docs):
    got = align.alignment(docs([(1, "ab  c")]), FIRST, SECOND).first()
    assert got.groups.count(";") == got.n_groups - 1 and all("|" in g for g in got.groups.split(";"))
    assert align.alignment(docs([]), FIRST, SECOND).count() == 0


ends = st.lists(st.integers(1, 9), max_size=60).map(lambda steps: [sum(steps[:k + 1]) for k in range(len(steps))])


@settings(max_examples=300, deadline=None)
@given(ends, ends)
def test_gallop(x, y):
    ranks, found = align.gallop(x, y)
    common = sorted(set(x) & set(y))
    assert [x[k] for k in ranks] == common and [y[k] for k in found] == common


def test_gallop_leaps():
    assert align.gallop([900, 901, 5_000], list(range(0, 6_000, 3))) == ([0], [300])
