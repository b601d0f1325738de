"""Groups, links and counts against plain Python on the libraries' own tokens."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tallystone.llm import alignment as al
from tallystone.llm.tokens import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def byte_alphabet():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute(pairs):
    tok, lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet, names = byte_alphabet(), {i: w for w, i in json.load(open(A))["model"]["vocab"].items()}

    def piece(i):
        return bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode()

    rows, held = [], Counter()
    for d, text in pairs:
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else [], lib.encode(text or "")
        x, y = [bytes(alphabet[c] for c in names[i]) for i in a], [piece(i) for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x) != want or b"".join(y) != want:
            rows.append((d, [], [], []))
            continue
        ends = sorted(set(np.cumsum([len(p) for p in x]).tolist()) & set(np.cumsum([len(p) for p in y]).tolist()))
        groups, i, j, at, bt = [], 0, 0, 0, 0
        for e in ends:
            g = ([], [])
            while at < e:
                at += len(x[i])
                g[0].append(a[i])
                i += 1
            while bt < e:
                bt += len(y[j])
                g[1].append(b[j])
                j += 1
            groups.append(g)
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        rows.append((d, a, b, groups, links))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for d, a, b, groups, *links in rows:
        links = links[0] if links else []
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), text))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(rows):
    rng = random.Random(3)
    parts = [" ", "  ", "naïve", "the", "ing", "日本語", "한", "\U0001f600", "\x00", "\n\n", "\t", "<s>", "<|endoftext|>", "1234", "''", "don't", "­"]
    pairs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    pairs += [(200, None), (201, ""), (202, " "), (None, "nobody"), (204, "has▁mark"), (205, "same text"), (205, "same text"), (206, "word after word " * 30_000), (207, "\U0001f600" * 3000)]
    assert got(al.align(rows(pairs), A, B)) == brute(pairs)
    assert al.align(rows([]), A, B).count() == 0
    empty = al.align(rows([(1, None), (2, "")]), A, B)
    assert got(empty) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_wide_groups():
    rng = np.random.default_rng(2)
    n_a, n_b = np.array([200, 1, 3, 150]), np.array([150, 2, 1, 90])
    a, b = rng.integers(0, 40, n_a.sum()), rng.integers(0, 40, n_b.sum())
    doc, key, times = al.links(a, b, n_a, n_b, np.array([0, 0, 1, 1]))
    want = Counter()
    for g, d in enumerate([0, 0, 1, 1]):
        for x in a[n_a[:g].sum() : n_a[: g + 1].sum()]:
            for y in b[n_b[:g].sum() : n_b[: g + 1].sum()]:
                want[d, int(x) << al.BITS | int(y)] += 1
    assert dict(zip(zip(doc.tolist(), key.tolist(), strict=True), times.tolist(), strict=True)) == dict(want)


def test_groups_end_where_both_sides_end():
    rng = np.random.default_rng(7)
    for n in (1, 2, 50, 3000):
        a = np.unique(np.append(rng.integers(1, 4 * n + 1, n), 4 * n + 1))
        b = np.unique(np.append(rng.integers(1, 4 * n + 1, n // 2 + 1), 4 * n + 1))
        ga, gb = al.groups(a, b)
        shared = np.intersect1d(a, b)
        assert np.array_equal(ga, np.searchsorted(shared, a)) and np.array_equal(gb, np.searchsorted(shared, b))


def test_table(spark, sf_dir, read):
    want = brute([(r.doc_id, r.text) for r in read("documents").collect()])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert got(al.query(spark, sf_dir)) == sorted(((*r[:-1], digest(r[-1])) for r in want), key=str)
