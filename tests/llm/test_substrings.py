"""Removed bytes against counting every string in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallystone.llm import substrings


def brute(pairs, length):
    raw = [(t or "").encode() for _, t in pairs]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(pairs, raw, strict=True):
        keep = [True] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                keep[i : i + length] = [False] * length
        spans = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        out.append((str(d), len(r), len(r) - sum(keep), spans, bytes(b for b, k in zip(r, keep, strict=True) if k)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def mosaic(n, seed, alphabet="abcé"):
    """Texts glued from shared stretches, with edits, repeats in one text and copies."""
    rng = random.Random(seed)
    stretch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 90))) for _ in range(15)]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(stretch) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 8)))
        out.append(text)
        if rng.random() < 0.15:
            out.append(text)
        elif text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            out.append(text[:at] + "#" + text[at + 1 :])
    return list(enumerate(out))


@pytest.mark.parametrize("length,v,passes", [(20, 7, 1), (40, 31, 3), (33, 31, 2), (60, 57, 1)])
def test_mosaics(rows, length, v, passes):
    pairs = mosaic(60, length)
    want = brute(pairs, length)
    assert got(substrings.remove_repeats(rows(pairs), length, v, passes)) == want
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_odd_rows(rows):
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(30_000))
    pairs = [(1, None), (2, ""), (3, "short"), (3, "short"), (4, "a" * 500), (5, long + "x" + long), (None, long[:450]), (6, "b" * 400), (6, "b" * 400), (7, "c" * 401), (8, "d" * 400), (None, None)]
    assert got(substrings.remove_repeats(rows(pairs))) == brute(pairs, 400)


def test_no_rows(rows):
    assert substrings.remove_repeats(rows([])).count() == 0


def test_table(spark, sf_dir, read):
    pairs = [(r.doc_id, r.text) for r in read("documents").collect()]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.query(spark, sf_dir).collect()}
    assert found == {int(d): (a, b, c, hashlib.sha256(k).hexdigest()) for d, a, b, c, k in brute(pairs, 400)}


@pytest.mark.parametrize("v", substrings.COVERS)
def test_covers(v):
    c = substrings.COVERS[v]
    assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_key_clash_is_told_apart_by_the_check():
    from tallystone.llm.ties import _ties

    keys, checks = np.array([5, 5, 5, 5, 1], np.uint64), np.array([1, 2, 1, 3, 1], np.uint32)
    order, group = _ties(keys, checks)
    same = {}
    for o, g in zip(order, group, strict=True):
        same.setdefault(g, []).append((int(keys[o]), int(checks[o])))
    assert sorted(map(len, same.values())) == [1, 1, 1, 2] and all(len(set(x)) == 1 for x in same.values())
