"""Counts by plain Python, and the label model against held-out labels."""

import re

import numpy as np

from tallystone.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_counts_of_odd_texts(rows):
    texts = [None, "", " \n\t", "a", "a b c d e f a b c d e f", "x\ny\nx\n\nx", "é ß\x0bü 日本 #", "a\n a\na ", "w " * 300, "one two three four five", "a<b>&c|d$%*", "same same same same same same same"]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "a"), (3, "a")]
    got = quality.judge(rows(pairs)).collect()
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == sorted((str(d), *counts(t)) for d, t in pairs)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_counts_of_the_table(read):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in quality.judge(read("documents")).collect()}
    for r in read("documents").filter("n_chars < 3000").collect():
        assert got[r.doc_id] == counts(r.text)[:4]


def test_no_rows(rows):
    assert quality.judge(rows([])).count() == 0


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), 4))
    for j, hit in enumerate([0.3, 0.5, 0.2, 0.6]):
        bad_vote = np.where(good, rng.random(len(good)) < 0.004, rng.random(len(good)) < hit)
        votes[:, j] = np.where(bad_vote, -1, np.where(rng.random(len(good)) < 0.9, 1, 0))
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, accuracy, posterior = quality.label_model(patterns, n.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(accuracy[0, :, 0] - [0.3, 0.5, 0.2, 0.6]).max() < 0.06
    kept = posterior[where.ravel()] >= 0.5
    assert kept[good].mean() > 0.98  # 1.6 % of the good ones get a false alarm


def test_against_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    verdicts = quality.judge(spark.read.parquet(f"{base}/documents.parquet")).select("doc_id", "base_failed", "kept")
    seen = verdicts.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in seen if r.quality], [r.kept for r in seen if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.06, (np.mean(good), np.mean(bad))
