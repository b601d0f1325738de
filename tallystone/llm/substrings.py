"""Removal of repeated substrings by fingerprints of suffixes that a difference cover selects.

No suffix order is built and no cover rank is kept: equal strings are all that matters.

A cover of residues modulo ``v`` has, for any two positions, a common shift below
``v`` that brings both into the cover.

1. Cover sample. Suffixes at cover positions are ranked by their first
   ``length - v + 1`` bytes, one bucket of the key range at a time. Two equal strings
   of ``length`` bytes have a pair of equally ranked cover suffixes, at the same shift.
   So a suffix without a tied cover suffix within ``v`` bytes is unique, and is never
   sorted: what is left to sort is what repeats, not the text.
2. Suffixes with a tied cover suffix are sorted by their first ``length`` bytes, again a
   bucket at a time, in ``passes`` over disjoint parts of the key range. Only equality
   matters here, so buckets are ordered by fingerprint: 96 bits, from byte values
   other than those of step 1, so a wrong tie needs two independent collisions.
3. The tied strings of each document are laid over it and the covered bytes removed.

Exact copies of a document repeat as a whole; one of them stands for all in step 2.
Tasks hold one batch of text or one bucket of keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import buckets_for, finish_steps, mixed, sliced, string_parts, texts
from tallystone.llm.ties import tied
from tallystone.llm.words import BASE, byte_values, powers
from tallystone.session import materialise

# Perfect difference sets, {v: residues}; every residue is a difference exactly once.
COVERS = {
    7: (0, 1, 3),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
KEY = ["doc_id", "h1", "h2"]


def window_keys(raw: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Fingerprint of the ``length`` bytes at each position."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(byte_values(seed)[raw] * powers(BASE, len(raw)), out=sums[1:])
    inverse = powers(pow(BASE, -1, 2**64), len(sums))
    return mixed((sums[at + length] - sums[at]) * inverse[at])


def cover_positions(sizes: np.ndarray, length: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in it) of every cover suffix that can lie in a repeated string."""
    short = length - v + 1
    sizes = np.where(sizes >= length, sizes, 0)
    turns = -(-sizes // v)
    doc = np.repeat(np.arange(len(sizes)), turns)
    first = np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
    at = (first[:, None] * v + np.array(COVERS[v])[None, :]).ravel()
    doc = np.repeat(doc, len(COVERS[v]))
    keep = at + short <= sizes[doc]
    return doc[keep], at[keep]


def ranges_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of half-open ranges sorted by start, as rows (start, end)."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return np.stack([lo[first], top[np.append(first[1:], len(lo)) - 1]], axis=1).astype(np.int64)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})


def _live(base: DataFrame, length: int, v: int, buckets: int, batch_bytes: int = 8 << 20) -> DataFrame:
    """Per document the starts, as ranges, of strings that may repeat."""

    def emit(batches: Iterable[pa.RecordBatch]):
        held, size = [], 0

        def packed():
            sizes = np.concatenate([h[1] for h in held])
            meta = np.concatenate([sizes, np.concatenate([h[0] for h in held], axis=1).ravel()]).astype(np.int64)
            keys = np.concatenate([h[2] for h in held])
            return keys, np.zeros(len(keys), np.uint32), meta.tobytes()

        for batch in sliced(batches, "text", 1 << 20):
            offsets, raw = string_parts(batch.column("text"))
            sizes = np.diff(offsets)
            doc, at = cover_positions(sizes, length, v)
            ids = batch.column("doc_id")
            names = np.array([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], np.int64)
            held.append((names, sizes, window_keys(raw, offsets[doc] + at, length - v + 1, 1)))
            size += len(raw)
            if size >= batch_bytes or sum(len(h[1]) for h in held) >= 100_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    def finish(meta: bytes, flags: np.ndarray) -> pd.DataFrame:
        sizes, ids, null, h1, h2 = np.frombuffer(meta, np.int64).reshape(5, -1)
        doc, at = cover_positions(sizes, length, v)
        doc, at = doc[flags], at[flags]
        edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
        out = []
        for i, size in enumerate(sizes):
            s = at[edges[i] : edges[i + 1]]
            lo, hi = np.maximum(s - v + 1, 0), np.minimum(s, size - length) + 1
            found = ranges_of(lo[hi > lo], hi[hi > lo])
            out.append(found.tobytes() if len(found) else None)
        ids = pd.array([None if x else d for d, x in zip(ids, null, strict=True)], "Int64")
        return pd.DataFrame({"doc_id": ids, "h1": h1, "h2": h2, "n_bytes": sizes, "live": out})

    return tied(base, emit, finish, "doc_id long, h1 long, h2 long, n_bytes long, live binary", buckets)


def _regions(base: DataFrame, live: DataFrame, length: int, piece: int = 256 << 10) -> DataFrame:
    """doc_id, h1, h2, start and bytes of every live stretch; long ones in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "start", "bytes"]
        schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            offsets, raw = string_parts(batch.column("text"))
            out = []
            for i, (d, a, b, ranges) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*KEY, "live"]), strict=True)):
                for lo, hi in np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist():
                    for at in range(lo, hi, piece):
                        end = min(at + piece, hi) - 1 + length
                        out.append((d, a, b, at, raw[offsets[i] + at : offsets[i] + end].tobytes()))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=names)

    same = base["doc_id"].eqNullSafe(live["doc_id"]) & (base["h1"] == live["h1"]) & (base["h2"] == live["h2"])
    rows = base.join(live, same).select(base["doc_id"], base["h1"], base["h2"], "text", "live")
    # repeated rows of one id are one document here
    rows = rows.dropDuplicates(KEY)
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, start long, bytes binary")


def _covered(regions: DataFrame, length: int, buckets: int, part: int, parts: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """The bytes, as ranges in the document, that tied strings of one part of the key range cover."""

    def emit(batches: Iterable[pa.RecordBatch]):
        for batch in sliced(batches, "bytes", batch_bytes):
            offsets, raw = string_parts(batch.column("bytes"))
            sizes = np.diff(offsets) - length + 1
            at = np.arange(sizes.sum()) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
            keys = window_keys(raw, at, length, 2)
            mine = np.flatnonzero(keys % np.uint64(parts) == part) if parts > 1 else np.arange(len(keys))
            checks = (window_keys(raw, at[mine], length, 3) >> np.uint64(32)).astype(np.uint32)
            ids = batch.column("doc_id")
            names = np.array([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("start").to_numpy(), sizes], np.int64)
            head = np.array([batch.num_rows, len(keys)], np.int64).tobytes()
            chosen = np.zeros(len(keys), bool)
            chosen[mine] = True
            yield keys[mine], checks, head + names.tobytes() + np.packbits(chosen).tobytes()

    def finish(meta: bytes, flags: np.ndarray) -> pd.DataFrame:
        n, m = np.frombuffer(meta, np.int64, 2)
        ids, null, h1, h2, start, sizes = np.frombuffer(meta, np.int64, 6 * n, 16).reshape(6, n)
        mine = np.flatnonzero(np.unpackbits(np.frombuffer(meta, np.uint8, -1, 16 + 48 * n), count=m))
        hit = mine[flags]
        ends = np.cumsum(sizes)
        edges = np.searchsorted(hit, np.concatenate([[0], ends]))
        out = []
        for i in np.flatnonzero(np.diff(edges)):
            lo = hit[edges[i] : edges[i + 1]] - (ends[i] - sizes[i]) + start[i]
            out.append((None if null[i] else int(ids[i]), int(h1[i]), int(h2[i]), ranges_of(lo, lo + length).tobytes()))
        return pd.DataFrame(out, columns=[*KEY, "covered"]).astype({"doc_id": "Int64"})

    return tied(regions, emit, finish, "doc_id long, h1 long, h2 long, covered binary", buckets)


def remove_repeats(docs: DataFrame, length: int = 400, v: int = 133, passes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) of every row.

    Removed is every byte that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same or another row; strings never cross rows and are judged
    on the input. A null or shorter text keeps everything. Repeated rows are copies of
    each other. An empty table gives no rows. ``v`` is a key of ``COVERS`` up to ``length``.
    """
    spark = docs.sparkSession
    finish_steps(spark)
    base = _documents(docs, id_col, text_col)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialise(_live(base, length, v, buckets_for(1.0 * total, spark, 12 << 20)), "live-starts")
    # equal texts repeat as a whole; the smallest id stands for them when the rest is sorted
    classes = found.filter(F.col("n_bytes") >= length).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    copies = materialise(classes.filter("copies > 1"), "copies")
    live = found.filter("live is not null").dropDuplicates(KEY).join(copies, ["h1", "h2"], "left")
    live = materialise(live.filter("copies is null or doc_id <=> least").select(*KEY, "live"), "live-documents")
    regions = materialise(_regions(base, live, length), "live-regions")
    size = regions.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = buckets_for(16.0 * size / passes, spark, 16 << 20)
    covered = [materialise(_covered(regions, length, buckets, p, passes), "covered") for p in range(passes)]
    for more in covered[1:]:
        covered[0] = covered[0].unionByName(more)
    covered = covered[0].groupBy(*KEY).agg(F.collect_list("covered").alias("covered"))
    plan = covered.join(copies.select("h1", "h2", F.lit(True).alias("whole")), ["h1", "h2"], "left").filter("whole is null").select(*KEY, "covered")
    plan = materialise(plan, "covered-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = string_parts(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, (whole, parts) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("covered").to_pylist(), strict=True)):
                text = raw[offsets[i] : offsets[i + 1]]
                n = len(text)
                if whole and n >= length:
                    found = np.array([[0, n]])
                elif parts:
                    found = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])
                    found = ranges_of(*found[np.argsort(found[:, 0], kind="stable")].T)
                else:
                    found = np.zeros((0, 2), np.int64)
                keep = np.ones(n, bool)
                for lo, hi in found.tolist():
                    keep[lo:hi] = False
                removed.append(int(n - keep.sum()))
                spans.append(len(found))
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    whole = copies.select("h1", "h2", F.lit(True).alias("whole"))
    state = plan.withColumn("whole", F.lit(None).cast("boolean"))
    state = state.unionByName(
        found.select(*KEY).dropDuplicates(KEY).join(whole, ["h1", "h2"]).select(*KEY, F.lit(None).cast("array<binary>").alias("covered"), "whole")
    )
    state = materialise(state, "removals")
    same = base["doc_id"].eqNullSafe(state["doc_id"]) & (base["h1"] == state["h1"]) & (base["h2"] == state["h2"])
    rows = base.join(state, same, "left").select(base["doc_id"], "text", "covered", "whole")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur twice."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
