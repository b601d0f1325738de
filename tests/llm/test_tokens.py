"""Encoding, packing and token files against plain calls of the tokenizer."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallystone.llm import packing, tokenfile
from tallystone.llm.tokens import Encoder, vocabulary

ODD = ["", "a", " ", "\n", " a", "a ", "a\n", "a  b", "<|endoftext|> x", "~ ~", "a\n\nb", "it's I'm 'll", " \n", "tail"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name):
    rng = random.Random(3)
    signs = " \n\t\x1c\x85\xa0 abDEé'sİß12.,;~́א日\x00"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    enc = Encoder(vocabulary(name))
    ids, at = enc.encode(texts)
    for i, e in enumerate(enc.tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_token_files_round_trip(rows):
    pairs = [(5, "b c"), (2, None), (None, "x y"), (9, "long words " * 3000), (2, "a"), (5, "b c"), (7, "")]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = tokenfile.read_tokens(tokenfile.write_tokens(rows(pairs), vocabulary("word_bpe_49k.json"), 2, file_ids=10)).collect()
    want, at = [], 0
    for d, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1]) == want


def test_token_files_of_no_rows(rows):
    assert tokenfile.read_tokens(tokenfile.write_tokens(rows([]), vocabulary("word_bpe_49k.json"), 2)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 1000])
def test_blocks_with_outliers(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.integers(1000, 1100, n)).astype(np.uint32)
    assert tokenfile.decode_blocks(n, *tokenfile.encode_blocks(ids)).tolist() == ids.tolist()


def check_pieces(pairs, pieces, width):
    """Every id in one piece, sequences gapless, short ones powers of two."""
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1].tolist()]
        assert ends[-1] == width or ends[-1] & (ends[-1] - 1) == 0
    want = sorted((str(d), *tok.encode(t or "", add_special_tokens=False).ids, 0) for d, t in pairs)
    got, by_doc = [], {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d, own in by_doc.items():
        own.sort(key=lambda p: (p.start, p.sequence_id))
        if len({t for x, t in pairs if x == d}) == 1 and sum(x == d for x, _ in pairs) == 1:
            ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist()
            assert len(ids) == own[0].doc_tokens and [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
            got.append((str(d), *ids))
    assert set(got) <= set(want)
    assert sum(p.length for p in pieces) == sum(len(w) - 1 for w in want)


def test_packing_of_odd_rows(rows):
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "n"), (51, "very long " * 4000), (52, "same words"), (53, "same words"), (53, "same words")]
    check_pieces(pairs, packing.pack(rows(pairs), vocabulary("byte_bpe_50k.json"), width=16, shard_docs=7).collect(), 16)
    assert packing.pack(rows([]), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_of_the_table(spark, sf_dir, read):
    pairs = [(r.doc_id, r.text) for r in read("documents").collect()]
    check_pieces(pairs, packing.pack(read("documents"), vocabulary("byte_bpe_50k.json")).collect(), 1024)


def test_neighbours_by_score():
    tails = [np.array(x, np.uint32) for x in ([1, 2, 3, 4, 5, 6], [70, 71, 72, 73], [1, 2, 3, 9], [80, 81, 82])]
    first = packing.fill(tails, 10)[0]
    assert [i for i, _, _ in first] == [0, 2]


def test_a_full_memory_keeps_the_ids_right(monkeypatch):
    from tallystone.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 50)
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    for turn in range(6):
        texts = [f"often used words {turn} and {turn * 7 + i} once\nnext" for i in range(40)]
        ids, at = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [enc.tok.encode(t).ids for t in texts]
