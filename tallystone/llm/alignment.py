"""Alignment of two tokenizers by pointer jumping over overlapping tokens.

The tokens of both tokenizers lie on the bytes of one text. Every token points to the
token that reaches farthest right among those it overlaps, itself included. Doubling the
successors (s = s[s]) for all tokens of a batch at once ends when nothing moves: then every
token points to the last token of its component, which labels its group. A group ends where
tokens of both sides end.

How many documents hold an id pair linked is counted in three steps that never bring a
document's links together with another's: a batch of texts gives its distinct pairs once
with a count; the counts are added over all batches; and every batch gets back the counts of
its own pairs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, give_back, process_cache, sliced, string_parts, texts
from tallystone.llm.pieces import Pieces, _ranges
from tallystone.llm.tokens import Encoder, vocabulary
from tallystone.session import materialise

BITS = 20  # of an id within a pair
WIDE = 1 << 12  # links of a group; wider groups are multiplied out by distinct ids
STORED = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs long, held binary, pairs binary, docs binary"
COUNTED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class ByteLevel(Encoder):
    """A byte-level vocabulary whose ids are its merges in order, by tiktoken; special tokens in texts are text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__(path)
        # an entry shows a printable byte as its Latin-1 character, the others in order from U+0100
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in printable]
        alphabet = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        single = [w for w in model["vocab"] if len(w) == 1]
        if any(model["vocab"][w] != len(single) + k for k, w in enumerate(merged)) or len(single) != 256:
            raise ValueError("ids do not follow the merges")
        self.raw = {i: bytes(alphabet[c] for c in w) for w, i in model["vocab"].items() if i < 256 + len(merged)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={r: i for i, r in self.raw.items()}, special_tokens={})

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.fast.encode_ordinary(t), np.uint32) for t in texts]


class Aligner:
    """Both vocabularies of a worker and what is needed to lay their tokens on bytes."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteLevel(byte_path), Pieces(piece_path)
        self.a_start, self.a_size, self.a_bytes = _laid([self.a.raw[i] for i in range(len(self.a.raw))])
        names = [self.b.library.id_to_piece(i) for i in range(self.b.n)]
        self.b_start, self.b_size, self.b_bytes = _laid([bytes([int(p[3:5], 16)]) if self.b.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def align(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(a ids, their offsets by text, b ids, theirs, a ids per group, b ids per group, groups' offsets by text).

        A text is laid out with a space in front; one whose tokens do not spell that has none.
        """
        given = [" " + t for t in column.to_pylist()]
        a, a_at = self.a.encode(given)
        b, b_at = self.b.encode(column, check=False)
        a_size, b_size = self.a_size[a], self.b_size[b]
        offsets, raw = string_parts(pa.array(given, pa.large_string()))
        size = np.diff(offsets)
        good = size > 1
        for ids, at, sizes, start, table in ((a, a_at, a_size, self.a_start, self.a_bytes), (b, b_at, b_size, self.b_start, self.b_bytes)):
            total = np.concatenate([[0], np.cumsum(sizes)])[at]
            good &= np.diff(total) == size
            rows = np.flatnonzero(good)
            mine = _ranges(at[:-1][rows], np.diff(at)[rows])
            spelt, want = table[_ranges(start[ids[mine]], sizes[mine])], raw[_ranges(offsets[:-1][rows], size[rows])]
            wrong = np.flatnonzero(spelt != want)
            good[rows[np.searchsorted(np.cumsum(size[rows]), wrong, "right")]] = False
        keep_a, keep_b = np.repeat(good, np.diff(a_at)), np.repeat(good, np.diff(b_at))
        a, a_size, b, b_size = a[keep_a], a_size[keep_a], b[keep_b], b_size[keep_b]
        a_at, b_at = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(at), 0))]) for at in (a_at, b_at))
        group_a, group_b = groups(np.cumsum(a_size), np.cumsum(b_size))
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        group_at = np.concatenate([[0], np.cumsum(n_a)])
        return a, a_at, b, b_at, n_a, n_b, np.searchsorted(group_at[:-1], a_at) if len(n_a) else np.zeros(len(a_at), np.int64)


def _laid(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in raw], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(raw), np.uint8)


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token of both sides, given where each ends; both sides cover the same bytes."""
    n = len(a_end)
    reach_a = np.searchsorted(b_end, a_end)  # the b token under an a token's last byte ends there or later
    reach_b = np.searchsorted(a_end, b_end)
    own = np.arange(len(b_end))
    beyond = a_end[reach_b] > b_end if n else np.zeros(0, bool)
    successor = np.concatenate([n + reach_a, np.where(beyond, reach_b, n + own)])
    while True:
        jumped = successor[successor]
        if np.array_equal(jumped, successor):
            break
        successor = jumped
    last = successor[n:] == n + own
    label = np.cumsum(last) - 1
    return label[successor[:n] - n], label[successor[n:] - n]


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the distinct linked pairs of every document; ``doc`` is a group's document."""
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    many = n_a * n_b
    plain = np.flatnonzero(many <= WIDE)
    # every a token of a group beside every b token of it
    mine = _ranges(a_first[plain], n_a[plain])
    of = np.repeat(plain, n_a[plain])
    left, right = np.repeat(a[mine], n_b[of]), b[_ranges(b_first[of], n_b[of])]
    key = doc[np.repeat(of, n_b[of])].astype(np.uint64) << np.uint64(2 * BITS) | left.astype(np.uint64) << np.uint64(BITS) | right.astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    keys, times = [key[first]], [np.diff(np.append(first, len(key)))]
    for g in np.flatnonzero(many > WIDE).tolist():
        x, nx = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
        y, ny = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
        head = np.uint64(doc[g]) << np.uint64(2 * BITS)
        keys.append((head | x.astype(np.uint64)[:, None] << np.uint64(BITS) | y.astype(np.uint64)).ravel())
        times.append((nx[:, None] * ny).ravel())
    if len(keys) > 1:
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(back, np.concatenate(times)).astype(np.int64)
    else:
        keys, times = keys[0], times[0]
    return (keys >> np.uint64(2 * BITS)).astype(np.int64), keys & np.uint64((1 << 2 * BITS) - 1), times


def _spelt(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, group_at: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    n = len(a) + len(b)
    if not n:
        return [""] * (len(group_at) - 1)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + (before_a + n_a)[of_b]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[before_a + n_a - 1]], mark[at_b[before_b + n_b - 1]] = ord("|"), ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - 1] = mark
    rest = ids
    for k in range(int(digits.max())):
        some = np.flatnonzero(digits > k) if k else slice(None)
        out[ends[some] - 2 - k] = 48 + rest[some] % 10
        rest = rest // 10
    edges = np.concatenate([[0], np.cumsum(n_a + n_b)])[group_at]
    edges = np.concatenate([[0], ends])[edges].tolist()
    raw = out.tobytes()
    return [raw[lo : hi - 1].decode("ascii") if hi > lo else "" for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    cache = process_cache("aligners")
    if (byte_path, piece_path) not in cache:
        cache[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return cache[byte_path, piece_path]


def _held(at: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and their times, small and compressed: differences, byte planes apart."""
    both = np.stack([np.diff(at, prepend=0), times]).astype("<u4")
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _let_go(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, n).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, keep: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """A written table of batches of documents.

    A batch has one row with its distinct ``pairs`` (``a << BITS | b``, ascending) and ``docs``,
    how many of its documents hold each, and one row per document: its counts, what ``keep``
    makes of its groups, and ``held``, its pairs as places in the batch's with their times.
    """
    names = [c.split()[0] for c in STORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, seq = _aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text", batch_bytes):
            n = batch.num_rows
            a, a_at, b, b_at, n_a, n_b, group_at = pair.align(batch.column("text"))
            doc, keys, times = links(a, b, n_a, n_b, np.repeat(np.arange(n), np.diff(group_at)))
            pairs, place, held_by = np.unique(keys, return_inverse=True, return_counts=True)
            edges = np.searchsorted(doc, np.arange(n + 1))
            many = np.concatenate([[0], np.cumsum(times)])[edges]
            held = [_held(place[lo:hi], times[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            per_doc = [*(np.diff(x) for x in (a_at, b_at, group_at, many)), _spelt(a, b, n_a, n_b, group_at), np.diff(edges), held]
            nothing = [pa.nulls(n, pa.binary())] * 2
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part << 32 | seq)), batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(per_doc, kinds, strict=True)), *nothing], names=names
            )
            one = [part << 32 | seq, *[None] * 8, pairs.tobytes(), held_by.astype(np.uint32).tobytes()]
            kinds = [*[pa.int64()] * 6, pa.string(), pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=names)
            seq += 1
        give_back()

    rows = texts(docs, id_col, text_col).mapInArrow(run, STORED)
    return materialise(rows.withColumn("groups", keep(F.col("groups"))), "aligned")


def _unpacked(stored: DataFrame) -> DataFrame:
    """batch, pair and docs of every batch's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, keys, docs in zip(*(batch.column(c).to_pylist() for c in ("batch", "pairs", "docs")), strict=True):
                keys, docs = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.uint32).astype(np.int64)
                for lo in range(0, len(keys), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), name)), pa.array(keys[part]), pa.array(docs[part])], names=["batch", "pair", "docs"])

    return stored.filter("pairs is not null").select("batch", "pairs", "docs").mapInArrow(run, "batch long, pair long, docs long")


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair, a, b, n (documents that hold it linked) and ``best``: no pair of its a has more."""
    counts = materialise(_unpacked(stored).groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.shiftright("pair", BITS)).withColumn("b", F.col("pair").bitwiseAND((1 << BITS) - 1))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document: its groups as text and the counts of its links."""
    replies = _unpacked(stored).select("batch", "pair").join(counts.select("pair", "n", "best"), "pair")

    def run(documents: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(replies["pair"].to_numpy().astype(np.uint64))  # the places that documents name
        n, best = replies["n"].to_numpy()[order], replies["best"].to_numpy().astype(bool)[order]
        sums = []
        for raw, size in zip(documents["held"], documents["n_pairs"], strict=True):
            at, times = _let_go(raw, size) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
        out = documents[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        out["n_best"], out["count_sum"], out["groups"] = [x for x, _ in sums], [x for _, x in sums], documents["groups"]
        give_back()
        return out

    # pandas would make floats of ids beside a null
    documents = stored.filter("pairs is null").drop("pairs", "docs").withColumn("doc_id", F.col("doc_id").cast("string"))
    out = documents.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(run, COUNTED)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def align(docs: DataFrame, byte_path: str, piece_path: str, keep: Callable[[Column], Column] = lambda groups: groups, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    ``groups`` holds the ids of both sides by group (``a1,a2|b1;a3|b2,b3``), or what ``keep``
    makes of that text before it is stored, such as a digest. A link is a pair
    of tokens, one of each side, in one group; its count is the number of documents that hold
    its id pair linked; it is best if no pair of its a id has a larger count, ties included.

    A null or empty text, and one whose tokens do not spell the text with a space in front, has
    no tokens: zeros and an empty ``groups``. Special tokens written in a text are text. A text
    of any length is aligned whole; a group wider than 4096 links is multiplied out by distinct
    ids. ``id_col`` is cast to long and may be null; repeated rows are documents of their own.
    Other columns are not read. An empty table gives no rows.
    """
    finish_steps(docs.sparkSession)
    stored = aligned(docs, byte_path, piece_path, keep, id_col, text_col)
    return counted(stored, materialise(pair_counts(stored), "best-pairs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the byte-level vocabulary (a) and the piece vocabulary (b)."""
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest)
    return out.withColumnRenamed("groups", "groups_sha256")
