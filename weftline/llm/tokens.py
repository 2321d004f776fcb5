"""Token ids of a whole corpus by a public tokenizer, and back.

The tokenizer file is read once per Python worker and its own library encodes Arrow batches of whole texts. Texts of
common characters are split into words first, as the tokenizer itself does, so that the library encodes each word
only once per worker (:class:`_Words`); the ids are the same.
Byte-level vocabularies write every byte as one printable character; :func:`byte_table` maps them back, so that
:func:`decode` can reverse ids whose tokens split a character: bytes are joined before they are read as UTF-8.
:func:`encode_with_offsets` adds the character span of every token; tokens that share one character have the
same span.

Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary
text; no special tokens are added; ids outside the vocabulary raise an error in :func:`decode`; incomplete
UTF-8 gives the replacement character; a null list decodes to null. Other columns are not touched.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the files of public tokenizers lie, and the default vocabulary.
TOKENIZERS, VOCABULARY, RANKS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters handed to the library at once; bounds the memory of offsets, not the length of a text.
CHUNK = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_padding()
    found.no_truncation()
    return found


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """Character of a byte-level vocabulary → byte: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level vocabulary."""
    data = json.loads(Path(path).read_text())
    vocab, special = dict(data["model"]["vocab"]), {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    table = byte_table()
    out = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for token, i in special.items():
        out[i] = token.encode()
    return tuple(out)


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        chunk.append(t or "")
        n += len(chunk[-1])
        if n >= CHUNK:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


#: Characters that the two splitters are sure to class alike; a text with any other goes to the library as a whole.
_COMMON = re.compile("[\t\n\r -~\u00a1-\u024f\u0400-\u04ff\u2010-\u2027\u3001-\u303f\u4e00-\u9faf\uff01-\uff5e]*")
#: Words kept per worker, and characters from which on a text goes to the library as a whole (its list of words would take
#: more memory than its ids). Ids are the same either way.
KEPT_WORDS, WHOLE = 400_000, 1_000_000


class _Words:
    """The library's ids of words met before. Byte-level merges never cross the borders at which the tokenizer
    splits a text, so a text's ids are those of its words; the split is the one stated with the vocabularies."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.library = tokenizer(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        words = self.split(text)
        known = self.known
        if new := list(set(words).difference(known)):
            if len(known) > KEPT_WORDS:
                known.clear()
                new = list(set(words))
            known.update(zip(new, (e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False))))
        return list(chain.from_iterable(map(known.__getitem__, words)))


@lru_cache(maxsize=4)
def _words(path: str) -> _Words | None:
    """For byte-level vocabularies whose split is stated beside them; None for others, which go to the library as a
    whole."""
    model = json.loads(Path(path).read_text())
    pre = model.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("normalizer") is None
    return _Words(path) if plain and find_spec("public_tokenizers") else None


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each text."""
    words, common = _words(path), _COMMON.fullmatch
    rows: list[list[int] | None] = [[] if not t else words.ids(t) if words and len(t) < WHOLE and common(t) else None for t in texts]
    rest = [i for i, r in enumerate(rows) if r is None]
    at = iter(rest)
    for chunk in _chunks([texts[i] for i in rest]):
        for e in tokenizer(path).encode_batch_fast(chunk, add_special_tokens=False):
            rows[next(at)] = e.ids
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes


def _path(vocabulary: str, folder: str) -> str:
    return str(Path(folder, vocabulary))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids array<int>``, one row per row of ``df``."""
    path, kind = _path(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = encode_texts(batch.column(1).to_pylist(), path)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The tokenizer of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = RANKS, folder: str = TOKENIZERS) -> DataFrame:
    """``key, n_tokens``: the length of :func:`encode`'s list. With a file of ranks (``.tiktoken``) the library of such
    files counts, which is three times as fast; the numbers are the same."""
    path, kind = _path(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if path.endswith(".tiktoken"):
                encode_one = _ranked(path).encode_ordinary
                sizes = [len(encode_one(t)) if t else 0 for t in texts]
            else:
                sizes = encode_texts(texts, path)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def encode_with_offsets(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids, starts, ends``: the half-open span of code points of each token."""
    path, kind = _path(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for chunk in _chunks(batch.column(1).to_pylist()) for e in tokenizer(path).encode_batch(chunk, add_special_tokens=False)]
            lists = pa.list_(pa.int32())
            spans = [e.offsets for e in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e.ids for e in found], lists), pa.array([[a for a, _ in s] for s in spans], lists), pa.array([[b for _, b in s] for s in spans], lists)], [key, "ids", "starts", "ends"]
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``key, text``: the text of token ids."""
    path, kind = _path(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            out = [None if row is None else b"".join([known[i] for i in row]).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return df.select(key, F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
