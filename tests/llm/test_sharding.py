"""Packing against plain searches, and shards against what they must hold."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tallystone.llm import sharding as s


def plain(sizes, capacity):
    """Best fit decreasing by looking at every bin."""
    left, out = [], []
    for size in sizes:
        fits = [(room, b) for b, room in enumerate(left) if room >= size]
        if fits:
            b = min(fits)[1]
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= size
        out.append(b)
    return out


def fewest(sizes, capacity):
    """Least number of bins at all, by trying every assignment."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_tree_equals_a_plain_search():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        sizes = sorted((rng.choice([1, 5, 5, rng.randint(1, 100)]) for _ in range(n)), reverse=True)
        for capacity in (100, 137, 1000):
            assert s.best_fit_decreasing(sizes, capacity) == plain(sizes, capacity)


def test_few_bins_on_small_cases():
    rng = random.Random(2)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 60) for _ in range(8)), reverse=True)
        bins = max(s.best_fit_decreasing(sizes, 100)) + 1
        assert bins <= 11 * fewest(sizes, 100) / 9 + 1
        found = s.tightest_packing(sizes, 3)
        load = Counter()
        for b, size in zip(found, sizes, strict=True):
            load[b] += size
        assert max(load) <= 2 and max(load.values()) <= 1.5 * max(sum(sizes) / 3, max(sizes))


def checked(rows, pairs, shards):
    out = s.assign(rows(pairs), shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, size(t), crc(t)) for d, t in pairs)
    held, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= x < shards for x in held)
    return held, where


def test_odd_rows(rows):
    rng = random.Random(3)
    pairs = [(i, "w" * rng.randint(0, 300) + str(rng.randint(0, 40))) for i in range(400)]
    pairs += [(500, None), (501, ""), (None, "nobody"), (7, "again"), (7, "again"), (502, "é" * 2000)]
    held, where = checked(rows, pairs, 4)
    total = sum(held.values())
    assert max(held.values()) <= 1.05 * total / 4 and all(len(v) == 1 for v in where.values())
    assert s.assign(rows([]), 4).count() == 0
    checked(rows, [(1, "alone")], 16)


def test_a_group_that_outweighs_a_shard(rows):
    pairs = [(i, "the same long text " * 20) for i in range(200)] + [(1000 + i, f"other {i} " * 15) for i in range(150)]
    held, where = checked(rows, pairs, 4)
    assert max(held.values()) <= 1.15 * sum(held.values()) / 4
    assert sum(len(v) > 1 for v in where.values()) == 1


@pytest.mark.parametrize("capacity", [400, 1000])
def test_fewest_shards_of_a_capacity(rows, capacity):
    rng = random.Random(4)
    pairs = [(i, "w" * rng.randint(0, 350)) for i in range(300)] + [(400, None), (None, "x")]
    out = s.assign(rows(pairs), capacity=capacity).collect()
    held, groups = Counter(), Counter()
    for r in out:
        held[r.shard] += r.size
        groups[r.text_crc32, r.size] += 1
    assert max(held.values()) <= capacity and sorted(held) == list(range(len(held)))
    assert len(out) == len(pairs) and len({(r.shard, r.slot) for r in out}) == len(pairs)
    units = []
    for (_, size), n in groups.items():
        most = capacity // size if n * size > capacity else n
        units += [size * min(most, n - at) for at in range(0, n, most)]
    assert len(held) == max(plain(sorted(units, reverse=True), capacity)) + 1


def test_a_row_above_the_capacity(rows):
    out = s.assign(rows([(1, "x" * 500), (2, "y"), (3, None)]), capacity=100).collect()
    assert len({r.shard for r in out}) == 2 and {r.shard for r in out if r.doc_id == 1} != {r.shard for r in out if r.doc_id == 2}


def test_table(spark, sf_dir, read):
    pairs = [(r.doc_id, r.text) for r in read("documents").collect()]
    out = s.query(spark, sf_dir).collect()
    assert {(r.doc_id, r.size) for r in out} == {(d, len((t or "").encode()) + 1) for d, t in pairs}
    held = Counter()
    for r in out:
        held[r.shard] += r.size
    assert len(held) == 16 and max(held.values()) <= 1.02 * sum(held.values()) / 16
