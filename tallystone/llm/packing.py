"""Sequences of fixed length, filled with lexically related documents.

Documents are encoded in shards. A shard is a bounded run of documents of one
scan task with its own inverted index, so packing needs no shuffle and no
state outside a task. Whole windows are cut from a long document itself. What is
left of each document is indexed by its token ids; a seed takes its unused
neighbours in the order of their BM25 scores until its window is full. The
last neighbour is cut where the window ends and its rest returns as a seed. What
remains of a shard is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, give_back, texts
from tallystone.llm.tokens import encoder, vocabulary

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.float64)
        owner = np.repeat(np.arange(n), [len(d) for d in docs])
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + owner, return_counts=True)
        term, self.doc = pairs // n, pairs % n
        self.terms, first = np.unique(term, return_index=True)
        self.starts = np.append(first, len(term))
        df = np.diff(self.starts)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes[self.doc] / max(sizes.mean(), 1))
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm)
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every document for the distinct ids of a query."""
        at = np.searchsorted(self.terms, np.unique(query))
        lo, hi = self.starts[at], self.starts[at + 1]
        sizes = hi - lo
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)
        return np.bincount(self.doc[rows], self.weight[rows], self.n)


def fill(tails: list[np.ndarray], width: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, to) that use every token of every tail exactly once.

    All sequences are ``width`` long, but for the powers of two of the last remainder.
    Seeds are taken by length, longest first; equal scores go to the earlier tail.
    """
    todo = [i for i, t in enumerate(tails) if len(t)]
    if not todo:
        return []
    index = Index(tails)
    used = np.array([len(t) for t in tails])  # tokens not yet placed are the last used[i] of tail i
    order = sorted(todo, key=lambda i: (-len(tails[i]), i))
    out: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room = width

    def take(i):
        nonlocal window, room
        while used[i] and room:
            n = min(int(used[i]), room)
            at = len(tails[i]) - int(used[i])
            window.append((i, at, at + n))
            used[i] -= n
            room -= n
            if not room:
                out.append(window)
                window, room = [], width
                return

    for seed in order:
        if not used[seed]:
            continue
        take(seed)
        if room == width:
            continue
        scores = index.scores(tails[seed])
        scores[used == 0] = -1
        for i in np.argsort(-scores, kind="stable"):
            if scores[i] < 0:
                break
            take(i)
            if room == width:
                break
    if window:  # the remainder in powers of two
        left = width - room
        parts, piece = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1], list(window)
        for size in parts:
            one = []
            while size:
                i, a, b = piece.pop(0)
                n = min(size, b - a)
                one.append((i, a, a + n))
                size -= n
                if a + n < b:
                    piece.insert(0, (i, a + n, b))
            out.append(one)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, width: int = 1024, shard_docs: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence, and its ids.

    A null or empty text has the end id alone. Every row of the table is a document of
    its own, so repeated rows and null ids are packed too; equal texts score highest for
    each other and tend to share a window. ``padded_length`` is the sequence's length,
    which its pieces fill. An empty table gives no rows.
    """

    finish_steps(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 40

        def packed(doc_ids, words):
            nonlocal sequence
            ids, offsets = enc.encode(words)
            ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            rows, tails, heads = [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                whole = int(hi - lo) // width * width
                for at in range(0, whole, width):
                    rows.append((i, at, width, sequence, 0, width))
                    sequence += 1
                heads.append(whole)
                tails.append(ids[lo + whole : hi])
            for pieces in fill(tails, width):
                at, full = 0, sum(b - a for _, a, b in pieces)
                for i, a, b in pieces:
                    rows.append((i, heads[i] + a, b - a, sequence, at, full))
                    at += b - a
                sequence += 1
            i, start, length, seq, at, full = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            raw, base = ids.tobytes(), offsets[i] + start
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[k] for k in i], pa.int64()), pa.array(start), pa.array(length), pa.array(offsets[i + 1] - offsets[i]),
                    pa.array(seq), pa.array(at), pa.array(full), pa.array([raw[4 * b : 4 * (b + n)] for b, n in zip(base, length, strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"],
            )

        doc_ids, words, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc_ids.append(d)
                words.append(t)
                size += len(t)
                if len(words) >= shard_docs or size >= 8 << 20:
                    yield packed(doc_ids, words)
                    doc_ids, words, size = [], [], 0
                    give_back()
        if words:
            yield packed(doc_ids, words)

    return texts(docs, id_col, text_col).mapInArrow(run, PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 ids of the byte-level vocabulary."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
