"""Components against all pairs of sets in plain Python."""

import random
import re

import pytest

from tallystone.llm import jaccard
from tallystone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sets_of(pairs, k):
    out = []
    for _, t in pairs:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(pairs, k, percent):
    sets = sets_of(pairs, k)
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        best = least.get(find(i))
        least[find(i)] = d if best is None else best if d is None else min(best, d)
    return sorted((str(d), len(s), str(least[find(i)])) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def near_copies(n, seed=1):
    """Chains and stars of edited copies around the threshold, with shared boilerplate."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(12)]
    out = []
    for i in range(n):
        if not out or rng.random() < 0.3:
            words = [word() for _ in range(rng.randint(3, 60))]
        else:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words = words + common
        out.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in words))
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent,pivots", [(4, 85, 6), (5, 80, 6), (4, 85, 0), (2, 50, 1)])
def test_near_copies(rows, k, percent, pivots):
    pairs = near_copies(220)
    assert got(jaccard.linked(rows(pairs), k, percent, pivots=pivots)) == brute(pairs, k, percent)


def test_odd_rows(rows):
    pairs = [(5, None), (4, ""), (3, " \t"), (9, "one"), (8, "ONE"), (7, "a b c"), (6, "a\nb\x0bc"), (None, "a b c"), (2, "É b c d e f"), (1, "é b c d e f"),
             (11, "w " * 50_000), (10, "w w w w"), (12, "x y z q r s t u v w a b c d"), (12, "x y z q r s t u v w a b c d")]
    assert got(jaccard.linked(rows(pairs), 4, 85)) == brute(pairs, 4, 85)
    firsts = [r for r in jaccard.linked(rows(pairs), 4, 85).collect() if r["first"]]
    assert len(firsts) == len({(str(r.component_id), r.n_shingles if r.n_shingles else r.rid) for r in firsts})


def test_no_rows(rows):
    assert jaccard.linked(rows([]), 4, 85).count() == 0


def test_table(spark, sf_dir, read):
    pairs = [(r.doc_id, r.text) for r in read("documents").collect()]
    assert got(jaccard.query(spark, sf_dir)) == brute(pairs, 4, 85)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r.node: r.root for r in components(df).collect()}
    assert out == {n: r for n, r in root.items() if n in out} and set(root) - set(out) <= {a for a, b in edges if a == b}
