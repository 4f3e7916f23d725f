import os
import random

import pytest

from siftwood.llm import tokenization as K

PATH = K.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")

TEXTS = [
    None, "", " ", "\n\n  a", "plain words, don't we'll", "x" * 5000, "été Größe ñ œ ſ", "日本語のテキスト", "🧭🧩 emoji", "a​b­c﻿", "<|endoftext|> not special",
    "tabs\t\tand\r\nlines\r\n\r\n", "1234567 ½ ² ٣", "a  b", "\x00\x1c\x1d\x85 ", "Ⅷ ‼ — “quoted” …", "code(x) { return y_1; } // done", "á combining", "한국어 и русский",
]


def library(text):
    return K.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    letters = [chr(x) for x in (*range(0x250), *range(0x2000, 0x2070))] + ["a", " ", "\n", "'s", "the ", "12"] * 60
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    letters = [chr(x) for x in range(0x3100) if not 0xD800 <= x < 0xE000] + ["語", "한", "🧩", "x"] * 50
    made += ["".join(rng.choice([*rng.sample(letters, 6), " ", "\n", "a", "!", "\u3000"]) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    for text in TEXTS + made:
        assert K.encode_text(text, PATH).tolist() == library(text), repr(text)


def test_round_trip_and_spans():
    for text in TEXTS:
        ids = library(text)
        assert K.decode_ids(ids, PATH) == (text or "")
        b0, b1, c0, c1 = K.spans(text or "", ids, PATH)
        raw = (text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(b0, b1, strict=True)) == raw
        for a, b, x, y in zip(b0, b1, c0, c1, strict=True):
            assert len((text or "")[:x].encode()) <= a and b <= len((text or "")[:y].encode())


def test_every_character_beside_white_space():
    texts = [f"a{c} b{c}{c}  {c} !{c}! \n{c}x {c}\n1" for c in map(chr, range(1, 0xD800))]
    want = K.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)
    assert all(got.tolist() == w.ids for got, w in zip(K.encode_texts(texts, PATH), want, strict=True))


def test_character_spans_are_the_offsets_of_the_library():
    for text in TEXTS:
        if text:
            made = K.tokenizer(PATH).encode(text, add_special_tokens=False)
            _, _, c0, c1 = K.spans(text, made.ids, PATH)
            # the library may leave a leading blank out of an offset
            assert all(a <= x and y == b for a, b, (x, y) in zip(c0, c1, made.offsets, strict=True)), text


def test_split_characters_overlap():
    ids = library("🧩")
    assert len(ids) > 1
    _, _, c0, c1 = K.spans("🧩", ids, PATH)
    assert set(zip(c0, c1, strict=True)) == {(0, 1)}
    assert "�" in K.decode_ids(ids[:1], PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, ids string")


def test_operators(spark):
    rows = list(enumerate(TEXTS)) + [(0, None), (None, "null key")]
    got = {(r.doc_id, tuple(r.ids)) for r in K.encode(frame(spark, rows), "doc_id").collect()}
    assert got == {(i, tuple(library(t))) for i, t in rows}
    counts = sorted((r.doc_id or -1, r.n_tokens) for r in K.count_tokens(frame(spark, rows), ["doc_id"]).collect())
    assert counts == sorted((i or -1, len(library(t))) for i, t in rows)
    with_spans = K.encode(frame(spark, rows), "doc_id", with_spans=True)
    assert with_spans.columns == ["doc_id", "ids", "byte_start", "byte_end", "char_start", "char_end"]
    assert with_spans.count() == len(rows)
    back = {r.doc_id: r.text for r in K.decode(K.encode(frame(spark, rows[:-2]), "doc_id"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in rows[:-2]}
    assert K.encode(frame(spark, []), "doc_id").count() == 0
