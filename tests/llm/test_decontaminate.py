"""Leaks against laying every item over every document in plain Python."""

import itertools
import random

import corpus_pipeline as cp

from tallystone.llm import decontaminate as d


def seeds(item):
    """Masked words of an item and where they start."""
    out = {}
    for m, mask in enumerate(d.MASKS):
        for j in range(len(item) - d.SPAN + 1):
            out.setdefault((m, *(item[j + o] for o in mask)), []).append(j)
    return out


def brute(docs, items, percent=80, window=32, run=None):
    split = lambda t: [w for w in (t or "").lower().split(" ") if w]
    items = [(y, split(passage)) for y, passage in items]
    index = {}
    for n, (_, item) in enumerate(items):
        for key, places in seeds(item).items():
            index.setdefault(key, []).extend((n, j) for j in places)
    out = {}
    for x, text in docs:
        doc = split(text)
        for y, item in items:
            if 0 < len(item) < d.SPAN and any(doc[i : i + len(item)] == item for i in range(len(doc))):
                out[(x, y)] = len(item)
        laid = set()
        for i in range(len(doc) - d.SPAN + 1):
            for m, mask in enumerate(d.MASKS):
                laid |= {(n, i - j) for n, j in index.get((m, *(doc[i + o] for o in mask)), ())}
        for n, start in laid:
            y, item = items[n]
            same = [0 <= start + j < len(doc) and doc[start + j] == item[j] for j in range(len(item))]
            width = min(window, len(item))
            enough = any(100 * sum(same[s : s + width]) >= percent * width for s in range(len(item) - width + 1))
            if enough or run and any(all(same[s : s + run]) for s in range(len(item) - run + 1)):
                out[(x, y)] = max(out.get((x, y), 0), sum(same))
    return out


def test_planted_passages(spark, rows):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 8, 15, 40, 70])))) for i in range(12)] + [(20, None), (21, ""), (22, "one"), (22, "one")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.8:
            part = rng.choice(items[:12])[1].split()
            for _ in range(int(len(part) * rng.choice([0, 0.1, 0.2, 0.4]))):
                part[rng.randrange(len(part))] = word()
            if rng.random() < 0.3:
                part = part[: rng.randint(1, len(part))]
            words[5:5] = part
        docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(90, None), (91, ""), (92, "One"), (None, items[4][1]), (93, "x " * 40_000 + items[3][1]), (0, docs[0][1])]
    bench = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, doc_id int, seed string")
    got = {(r.doc_id, r.item_id): r.matched for r in d.leaks(rows(docs), bench).collect()}
    assert got == brute(docs, items)
    assert len(got) > 20


def test_every_fifth_word_substituted(spark, rows):
    item = [f"w{i}" for i in range(40)]
    docs = [(r, "a b " + " ".join("zz" if i % 5 == r else w for i, w in enumerate(item)) + " c") for r in range(5)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in d.leaks(rows(docs), bench).collect()} == set(range(5))


def test_empty_tables_and_no_python(spark, rows):
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert d.leaks(rows([]), bench).count() == 0
    out = d.leaks(rows([(1, "a b c d e f g h i")]), bench.limit(0))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_benchmark_is_not_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(d, "SMALL", 0)
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    docs = rows([(1, "x a b c d e f g h i"), (1, "x a b c d e f g h i"), (2, "y " * 200_000 + "a b c d e f g h z"), (None, "a b c d e f g h i"), (3, None)])
    found = d.leaks(docs, bench, run=d.RUN)
    assert {(r.doc_id, r.matched) for r in found.collect()} == {(1, 9), (2, 8), (None, 9)}
    # positions cross the shuffle without the text's words
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = [x for x in lines if "Join LeftSemi" in x]
    assert joined and not any("words" in x for x in joined)


def allowed(n, percent=80):
    """Every choice of as many of n places as may be substituted."""
    return itertools.combinations(range(n), n - -(-percent * n // 100))


def test_masks_hit_every_allowed_substitution():
    for n in range(d.SPAN, 26):
        masks = d.MASKS if n <= d.DENSE_UP_TO else d.WIDE
        bits = [sum(1 << o for o in m) << at for m in masks for at in range(n - d.SPAN + 1)]
        assert all(any(not gone & b for b in bits) for gone in (sum(1 << i for i in c) for c in allowed(n)))


def test_substitutions_in_short_items(spark, rows):
    """Items laid over the documents at every place, without masks."""
    sizes = (8, 9, 10, 11, 15, 16, 17)
    items = [(n, [f"w{n}x{i}" for i in range(n)]) for n in sizes]
    docs = []
    for n, item in items:
        chosen = list(allowed(n))
        for gone in chosen if n < 12 else [c for c in chosen if c[0] in (1, 2, 3)]:
            docs.append((len(docs), ["zz" if i in gone else w for i, w in enumerate(item)]))
        docs.append((len(docs), item[: n - 1]))  # ends in the item
        docs.append((len(docs), ["zz" if i < n // 2 else w for i, w in enumerate(item)]))
    want = set()
    for x, doc in docs:
        for y, item in items:
            for start in range(-len(item), len(doc)):
                same = sum(0 <= start + j < len(doc) and doc[start + j] == w for j, w in enumerate(item))
                if 100 * same >= 80 * len(item):
                    want.add((x, y))
    bench = spark.createDataFrame([(y, " ".join(item)) for y, item in items], "item_id long, text string")
    got = d.leaks(rows([(x, " ".join(doc)) for x, doc in docs]), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(docs) - len(want) == len(sizes)


def test_parts_of_long_items(spark, rows, tmp_path):
    items = {59: [f"a{i}" for i in range(59)], 45: [f"b{i}" for i in range(45)], 34: [f"c{i}" for i in range(34)]}
    parts = {1: items[59][20:45], 2: items[45][:22], 3: items[34][-8:], 4: items[34][:7], 5: items[59][5:12] + ["zz"] + items[59][13:20]}
    docs = rows([(x, " ".join(["x", "y", *part, "z"])) for x, part in parts.items()])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(y, " ".join(item)) for y, item in items.items()], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = d.query(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == {(1, 59): 25, (2, 45): 22, (3, 34): 8}
    kept = cp.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {4, 5}


def test_sql_of_short_items(spark, rows):
    import duckdb

    docs = [(1, "x a b c d e y"), (2, "a b c d f"), (3, "one"), (4, None), (5, "p q r s t u v w x")]
    items = [(1, "a b c d e"), (2, "One"), (3, ""), (4, "p q r s t u v w x"), (5, "p q r s t u v")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)").executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)").executemany("insert into benchmark values (?, ?)", items)
    got = d.leaks(rows(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(con.execute(d.SQL).fetchall()) == sorted(map(tuple, got)) == [(1, 1, 5, 5), (3, 2, 1, 1), (5, 4, 9, 9), (5, 5, 7, 7)]
