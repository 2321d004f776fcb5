import base64
import os

import pytest

from weftline.llm import tokens as T

FOLDER = T.TOKENIZERS
TEXTS = ["", None, " ", "Hello world", "naïve 🇪🇺 ​ 👩‍🔬 ẹ́", "<|endoftext|> <s>", "\x00\x1b[0m﻿", "日本語のテキスト", "a" * 50_000, "tabs\t\tand\n\nlines  "]
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.json"), reason="no tokenizer files")


def frame(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_ids_equal_the_other_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in T.encode(frame(spark), "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in T.count_tokens(frame(spark), "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_round_trip_and_offsets(spark):
    ids = T.encode(frame(spark), "doc_id", "text")
    assert {r.doc_id: r.text for r in T.decode(ids, "doc_id").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in T.encode_with_offsets(frame(spark), "doc_id", "text").collect():
        text, spans = TEXTS[r.doc_id] or "", list(zip(r.starts, r.ends))
        assert all(a <= b for a, b in spans)
        covered = "".join(text[a:b] for k, (a, b) in enumerate(spans) if k == 0 or (a, b) != spans[k - 1] or b - a > 1)
        assert covered == text or len(set(spans)) < len(spans)
    assert T.encode(frame(spark).limit(0), "doc_id", "text").count() == 0


def test_split_characters_and_bad_ids(spark):
    one = T.encode(spark.createDataFrame([(1, "ẹ́")], "k long, text string"), "k", "text").first().ids
    halves = spark.createDataFrame([(1, one[:1]), (2, None)], "k long, ids array<int>")
    got = {r.k: r.text for r in T.decode(halves, "k").collect()}
    assert got[2] is None and "�" in got[1]
    with pytest.raises(Exception):
        T.decode(spark.createDataFrame([(1, [10**6])], "k long, ids array<int>"), "k").collect()


def test_long_texts_have_the_same_ids_by_words_and_as_a_whole():
    path = f"{FOLDER}/byte_bpe_50k.json"
    base = "The list of all products, sorted by price. " * 23_300
    for n in (T.WHOLE - 1, T.WHOLE, T.WHOLE + 1):
        text = base[:n]
        ids, sizes = T.encode_texts([text, "x"], path)
        whole = T.tokenizer(path).encode(text, add_special_tokens=False).ids
        assert ids[: sizes[0]].tolist() == whole and sizes[1] == 1
