"""Encoding of texts with a public tokenizer, and back.

Texts are encoded by the tokenizers library over Arrow batches; each executor
process loads the vocabulary once. No word of a byte-level vocabulary reaches from
a character into the white space behind it, and merges stay within words, so a
text falls apart there into segments that are encoded alike wherever they stand.
The library gets every segment that is new to the process in one call a batch,
whatever its script or length, and cuts words and merges bytes itself; segments
met before take their ids from a bounded memory.

Token ids come back as list<int>, on request with the span of every token in bytes
and in characters.

Defined results: a null text and an empty text both give an empty list of ids;
strings that look like special tokens are ordinary text; extra columns, also
such that are named like a result, are dropped unless named in `keep`.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every operator.
TOKENIZERS = os.environ.get("SIFTWOOD_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: A batch is worked on in parts of about so many characters.
PART_CHARS = 1 << 22


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, one thread, specials as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def vocabulary_path(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte.

    Printable characters of Latin-1 stand for themselves; the remaining bytes
    take the code points from 256 upwards in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id."""
    alphabet = byte_alphabet()
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        out[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ids: bytes are joined before they are read as UTF-8.

    A character may be split over several tokens, so tokens can't be decoded one
    by one; bytes that form no character become U+FFFD.
    """
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


#: Segments whose ids a process remembers; at so many the memory starts anew.
MEMORY_SEGMENTS = 400_000
#: Longer segments are encoded anew in every batch, so that the memory stays small.
MEMORY_CHARS = 64
#: What byte-level patterns call white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No word of a byte-level pattern goes on from a character into white space behind it, so a text falls apart there.
_SEGMENT = re.compile(rf"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


@lru_cache(maxsize=4)
def _separable(path: str) -> bool:
    """Whether a vocabulary's words never reach over a segment: byte-level words, no normalizer, no added tokens but special ones."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return plain and not made.get("normalizer") and all(t.get("special") for t in made.get("added_tokens") or [])


@lru_cache(maxsize=4)
def _memory(path: str) -> dict[str, tuple[int, ...]]:
    """The ids of segments that this process has met in a vocabulary."""
    return {}


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text; none for a null or empty one. The library gets all segments that are new in one call."""
    if not _separable(path):
        known = [(i, t) for i, t in enumerate(texts) if t]
        out = [np.zeros(0, np.int32) for _ in texts]
        for (i, _), made in zip(known, tokenizer(path).encode_batch_fast([t for _, t in known], add_special_tokens=False), strict=True):
            out[i] = np.array(made.ids, np.int32)
        return out
    memory = _memory(path)
    if len(memory) >= MEMORY_SEGMENTS:
        memory.clear()
    cut = [_SEGMENT.findall(t) if t else [] for t in texts]
    fresh = list(set(chain.from_iterable(cut)).difference(memory))
    for segment, made in zip(fresh, tokenizer(path).encode_batch_fast(fresh, add_special_tokens=False), strict=True):
        memory[segment] = tuple(made.ids)
    out = [np.fromiter(chain.from_iterable(map(memory.__getitem__, c)), np.int32) for c in cut]
    for segment in fresh:
        if len(segment) > MEMORY_CHARS:
            del memory[segment]
    return out


def encode_text(text: str | None, path: str) -> np.ndarray:
    """The ids of one text."""
    return encode_texts([text], path)[0]


def spans(text: str, ids: list[int], path: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """First and end byte, first and end character of each token.

    A token that holds part of a character covers that whole character, so the
    spans of the tokens that share it overlap.
    """
    table = token_bytes(path)
    ends = np.cumsum([len(table[i]) for i in ids]) if ids else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    raw = np.frombuffer(text.encode("utf-8", errors="surrogatepass"), np.uint8)
    leading = (raw & 0xC0) != 0x80
    char_of = np.cumsum(leading) - 1
    if not len(ends):
        return [], [], [], []
    return starts.tolist(), ends.tolist(), char_of[starts].tolist(), (char_of[ends - 1] + 1).tolist()


_IDS = T.ArrayType(T.IntegerType(), False)
_SPANS = ("byte_start", "byte_end", "char_start", "char_end")


def _list_array(rows: list) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _parts(texts: list[str | None], path: str) -> Iterator[list[np.ndarray]]:
    """The ids of the texts, in parts of about PART_CHARS characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= PART_CHARS:
            yield encode_texts(some, path)
            some, size = [], 0
    if some:
        yield encode_texts(some, path)


def encode(
    df: DataFrame,
    key: str,
    text: str = "text",
    *,
    path: str | None = None,
    keep: tuple[str, ...] = (),
    with_spans: bool = False,
) -> DataFrame:
    """One row per row of df: key, the columns in keep, ids, and the spans if asked for."""
    path = path or vocabulary_path()
    kept = [key, *keep]
    fields = [df.schema[c] for c in kept] + [T.StructField("ids", _IDS)]
    if with_spans:
        fields += [T.StructField(c, _IDS) for c in _SPANS]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(n).to_pylist(), 0
            for rows in _parts(texts, path):
                columns = [batch.column(i).slice(at, len(rows)) for i in range(n)] + [_list_array(rows)]
                if with_spans:
                    found = [spans(texts[at + i] or "", ids.tolist(), path) for i, ids in enumerate(rows)]
                    columns += [_list_array([f[j] for f in found]) for j in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                at += len(rows)

    picked = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return picked.mapInArrow(run, T.StructType(fields))


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", *, path: str | None = None) -> DataFrame:
    """keys and n_tokens of each row: the sizes that packing needs, without the ids."""
    path = path or vocabulary_path()
    fields = [df.schema[c] for c in keys] + [T.StructField("n_tokens", T.LongType())]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(ids) for part in _parts(batch.column(n).to_pylist(), path) for ids in part]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(sizes, pa.int64())], names=[f.name for f in fields]
            )

    picked = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    return picked.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, key: str, ids: str = "ids", *, path: str | None = None) -> DataFrame:
    """One row per row of df: key and text; a null list gives a null text."""
    path = path or vocabulary_path()
    fields = [df.schema[key], T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{ids}`").cast(_IDS).alias("__ids")).mapInArrow(run, T.StructType(fields))
