"""Weak supervision: rules vote good, bad or abstain; a label model weighs them.

Votes of all documents are counted by pattern (at most three to the power of the
number of rules, so the counts are a bounded table). Expectation-maximisation on
these counts estimates each rule's accuracy and the share of good documents,
without any label. The posterior of a document's pattern decides, in place of
passing every rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, give_back, sliced, string_parts, texts
from tallystone.llm.words import Words, owned, stretches
from tallystone.session import materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_upper", "n_short_words", "n_distinct_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"'")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(offsets: np.ndarray, raw: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each of the concatenated texts."""
    w, n = Words(offsets, raw), len(offsets) - 1
    chars = w.solid & ((raw & 0xC0) != 0x80)
    # lines with a word: cut at \n and at the ends of texts
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
    lo, hi = cuts[:-1], cuts[1:]
    solid = np.concatenate([[0], np.cumsum(w.solid, dtype=np.int64)])
    lo, hi = lo[solid[hi] > solid[lo]], hi[solid[hi] > solid[lo]]
    hi = hi - (raw[hi - 1] == 10) if len(hi) else hi
    owner = np.searchsorted(offsets, lo, "right") - 1
    lines = np.bincount(owner, minlength=n)
    _, first = np.unique(owned(stretches(w.sums, lo, hi), owner), return_index=True)
    ended = np.bincount(owner, _END[raw[hi - 1]], n) if len(hi) else np.zeros(n)
    # words in windows that occur twice
    keys, shingle_owner, at = w.shingles(window)
    _, inverse, times = np.unique(owned(keys, shingle_owner), return_inverse=True, return_counts=True)
    mark = np.zeros(len(w.hash) + 1, np.int64)
    twice = at[times[inverse] > 1] if len(at) else at
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    word_owner = np.repeat(np.arange(n), w.count)
    _, distinct = np.unique(owned(w.hash, word_owner), return_index=True)
    return {
        "n_words": w.count,
        "word_chars": _per_text(chars, offsets),
        "n_symbols": _per_text(_SYMBOL[raw], offsets),
        "n_dup_lines": lines - np.bincount(owner[first], minlength=n),
        "n_repeat_words": _per_text(np.cumsum(mark[:-1]) > 0, w.at),
        "n_lines": lines,
        "n_ended_lines": ended.astype(np.int64),
        "n_letters": _per_text(_LETTER[raw], offsets),
        "n_upper": _per_text((raw >= 65) & (raw <= 90), offsets),
        "n_short_words": _per_text((w.end - w.begin <= 3) & _LETTER[raw[w.begin]], w.at),
        "n_distinct_words": np.bincount(word_owner[distinct], minlength=n),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a digest of the text and the counts above, map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            found = features(*string_parts(batch.column("text")))
            give_back()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["doc_id", "digest", *COUNTS]
            )

    rows = texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """Each rule's vote on a document's counts: 1 good, -1 bad, 0 abstains."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "length": _vote(n >= 50, n < 10),
        "word_length": _vote(mean.between(2.5, 9), ~mean.between(2, 12)),
        "symbols": _vote(F.col("n_symbols") <= 0.02 * n, F.col("n_symbols") > 0.1 * n),
        "repeated_lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * lines),
        "repeated_words": _vote(F.col("n_repeat_words") <= 0.05 * n, F.col("n_repeat_words") > 0.2 * n),
        "letters": _vote(F.col("n_letters") >= 0.75 * F.col("word_chars"), F.col("n_letters") < 0.6 * F.col("word_chars")),
        "case": _vote(F.col("n_upper") <= 0.15 * F.col("n_letters"), F.col("n_upper") > 0.4 * F.col("n_letters")),
        "line_ends": _vote(F.col("n_ended_lines") >= 0.6 * lines, F.col("n_ended_lines") < 0.1 * lines),
        "short_words": _vote(F.col("n_short_words") >= 0.12 * n, F.col("n_short_words") < 0.05 * n),
        "variety": _vote(F.col("n_distinct_words") >= F.sqrt(n), F.col("n_distinct_words") < 0.5 * F.sqrt(n)),
    }


def label_model(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300, alarm: float = 0.01, hit: float = 0.1) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, accuracies, posterior of good per pattern) by EM.

    Accuracies are (2, rules, 3): how often each rule votes bad, abstains and votes good
    on bad and on good documents. Rules see different faults, so a rule's accuracy
    differs by class: on good documents it votes bad with at most ``alarm``, on bad ones
    with at least ``hit``. That also fixes which class is the good one. EM starts from
    documents with and without a bad vote and stops when nothing moves.
    """
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)  # pattern, rule, vote
    good = np.where((patterns == -1).any(axis=1), 0.2, 0.95)
    share = 0.8
    for _ in range(rounds):
        rates = []
        for part, bad_class in ((weights * (1 - good), True), (weights * good, False)):
            rate = np.tensordot(part, cast, 1) + 0.5
            rate /= rate.sum(axis=1, keepdims=True)
            held = np.maximum(rate[:, 0], hit) if bad_class else np.minimum(rate[:, 0], alarm)
            rest = rate[:, 1:] / rate[:, 1:].sum(axis=1, keepdims=True) * (1 - held)[:, None]
            rates.append(np.concatenate([held[:, None], rest], axis=1))
        share = float(np.clip((weights @ good + 0.5) / (weights.sum() + 1), 0.05, 0.95))
        log = [(cast * np.log(r)).sum(axis=(1, 2)) for r in rates]
        odds = np.log(share / (1 - share)) + log[1] - log[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    return share, np.array(rates), good


def judge(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, ``p_good``, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated
    windows; such rows are never kept. Others are kept if their posterior is at least
    ``least``. Null and empty texts have no words and fail. Repeated rows are judged
    alike, so are ties of votes; null ids stay, others are cast to long. A text of any
    length is counted whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    finish_steps(spark)
    rules = votes()
    found = materialise(measured(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rules.items()}), "quality-counts")
    names = [f"vote_{k}" for k in rules]
    counts = found.groupBy(*names).count().collect()  # at most 3 ** rules rows
    patterns = np.array([[r[c] for c in names] for r in counts], np.float64).reshape(len(counts), len(names))
    _, _, posterior = label_model(patterns, np.array([r["count"] for r in counts], np.float64))
    table = spark.createDataFrame([(*(int(x) for x in p), float(g)) for p, g in zip(patterns, posterior, strict=True)], ", ".join(f"{c} int" for c in names) + ", p_good double")
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    out = found.join(F.broadcast(table), names).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the rules."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
