"""The agenda against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tallystone.llm import pieces as p
from tallystone.llm.tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "e", "th", "the", "▁", "\n", "\t", "é", "日本", "\U0001f600", "\x00", "<s>", "</s>", "<0x41>", "​", "ing", "S", '"', "0", "﻿", "한국", "ي", "̈", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def got(df):
    return [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in df.collect()]


def test_any_characters(library):
    rng = random.Random(5)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    some += ["", " ", "   ", "▁", " a ", "a" * 5000, "ab " * 3000 + "x" * 3000, "日本語テキスト" * 200, " " * 1000, "▁" * 100]
    ids, at = p.Pieces(MODEL).encode(pa.array(some), check=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(some)


def test_odd_rows(rows, library):
    pairs = [(5, None), (4, ""), (3, " \t"), (None, "nobody's"), (7, "same"), (7, "same"), (8, "x" * 200_000), (9, "word and word " * 100_000), (10, "<s>a</s>")]
    one = p.encode(rows(pairs), MODEL)
    want = [(i, [1, *library.encode(t or ""), 2]) for i, t in pairs]
    assert got(one) == want
    back = {(r.doc_id, r.text) for r in p.decode(one, MODEL).collect()}
    assert back == {(i, library.decode(w)) for i, w in want} == {(i, t or "") for i, t in pairs}
    assert got(p.encode(rows(pairs[:3]), MODEL, begin=False, end=False)) == [(5, []), (4, []), (3, library.encode(" \t"))]
    assert p.encode(rows([]), MODEL).count() == 0 and p.decode(one.limit(0), MODEL).count() == 0


def test_a_difference_fails(library):
    own = p.Pieces(MODEL)
    own.score[:] = -own.score
    with pytest.raises(ValueError, match="differ"):
        own.encode(pa.array(["the thing in other theatres"]))


def test_table(spark, sf_dir, read, library):
    want = set()
    for r in read("documents").collect():
        ids = [1, *library.encode(r.text or ""), 2]
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in p.query(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
