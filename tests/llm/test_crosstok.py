"""Alignment of tokenizers against whole texts encoded by the libraries and plain counting."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from corpusforge.llm import crosstok
from corpusforge.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CODER = Tokenizer.from_file(A)
CODER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)


def tables():
    # the byte of each printable character, learned from texts of one byte
    byte = {}
    for k in range(128):
        (piece,) = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))
        byte[piece[0]] = k
    for k in range(0x80, 0x800):
        (piece,) = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))
        byte.update(zip(piece[0], chr(k).encode(), strict=True))
    for k in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)):
        (piece,) = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))
        byte.update(zip(piece[0], chr(k).encode(), strict=True))
    a = {i: bytes(byte.get(c, 63) for c in p) for p, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    b = {i: bytes([int(p[3:-1], 16)]) if PIECES.is_byte(i) else p.replace("\u2581", " ").encode() for i in range(len(PIECES)) for p in [PIECES.id_to_piece(i)]}
    return a, b


BYTES_A, BYTES_B = tables()


def plain(docs):
    every, rows = [], []
    for i, text in docs:
        a = CODER.encode(" " + text, add_special_tokens=False).ids if text else []
        b = PIECES.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(BYTES_A[x] for x in a) != whole or b"".join(BYTES_B[x] for x in b) != whole:
            every.append((i, [], [], [], []))
            continue
        spans = []
        for ids, size in ((a, BYTES_A), (b, BYTES_B)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(size[x])))
                at += len(size[x])
            spans.append(own)
        links, j = [], 0
        for (s, e), x in zip(spans[0], a, strict=True):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, own, strict=True) if low <= s and e <= end) for ids, own in zip((a, b), spans, strict=True)))
            low = end
        every.append((i, a, b, links, groups))
    count = Counter(p for _, _, _, links, _ in every for p in set(links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for i, a, b, links, groups in every:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(rows, key=str)


def aligned(spark, docs, parts=3):
    return sorted((tuple(r) for r in crosstok.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), A, B).collect()), key=str)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \n", "\n", "\t", "\u2581a", "x\u2581", "<s> </s> <|endoftext|> <0x41>", "\ufb01n \u00bd", "caf\u00e9 e\u0301", "\u3000wide\u3000 space", "a\u00a0b \u00a0 c",
    "\x00 \x1c x\x1c y\x85 z", "\U0001f600 \U0001f468\u200d\U0001f469 \u4f60\u597d", "it's we'll  don't'", "1234567890 12,345.67", "end   ", "the the the", "a" * 3000, "\r\n\r\n  x", "\u200b\ufeff",
]


def test_texts(spark):
    docs = [*enumerate(TEXTS), (4, "a"), (None, "the end"), (None, None)]
    assert aligned(spark, docs) == plain(docs)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, monkeypatch, seed):
    """Small slices, tasks and memory; characters of many kinds, white space above all."""
    for name, value in (("SLICE", 300), ("REMEMBERED", 40), ("AT_ONCE", 50), ("TASK", 200)):
        monkeypatch.setattr(crosstok, name, value)
    rng = random.Random(seed)
    signs = list("  \n\t ab.,'1\u00e9\u2581\u4f60\u00a0<>") + ["the ", " of", "ing ", "\U0001f600"]
    docs = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(80)))) for i in range(120)]
    assert aligned(spark, docs) == plain(docs)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_crosstok"](spark, sf_dir).collect()), key=str) == plain(docs)
