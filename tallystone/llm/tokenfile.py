"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Every block of ``BLOCK`` ids
stores its minimum, the differences packed at the width that a percentile of
them needs, and the wider values as exceptions (place, value). The start of
every block is indexed, so any block can be read alone.

Layout, little endian: ``PFR1``, documents, ids, blocks (int64 each); document
ids and a null flag each; offsets of documents; minima, widths and exception
counts of blocks; byte starts of blocks; packed blocks; exception places and values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.common import filesystem, finish_steps, give_back, texts
from tallystone.llm.tokens import encoder, vocabulary
from tallystone.session import materialise, scratch_path

MAGIC = b"PFR1"
BLOCK = 256


def encode_blocks(ids: np.ndarray, percentile: float = 95) -> tuple[np.ndarray, ...]:
    """(minima, widths, exceptions per block, packed bytes, exception places, exception values)."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    cut = np.partition(diff, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(cut.astype(np.float64) + 1)).astype(np.uint8)
    wide = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    packed, starts = np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        for lo in range(0, len(mine), 512):
            some = mine[lo : lo + 512]
            bits = (diff[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            data = np.packbits(bits.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            packed[starts[some][:, None] + np.arange(data.shape[1])] = data
    places = np.nonzero(wide)[1].astype(np.uint8)
    return low, width, wide.sum(axis=1).astype(np.uint16), packed, places, diff[wide]


def decode_blocks(n, low, width, exceptions, packed, places, values) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    diff = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        for lo in range(0, len(mine), 512):
            some = mine[lo : lo + 512]
            data = packed[starts[some][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(some), BLOCK, int(w))
            diff[some] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    diff[np.repeat(np.arange(len(low)), exceptions), places] = values
    return (diff + low[:, None]).ravel()[:n]


def file_bytes(doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    low, width, exceptions, packed, places, values = encode_blocks(ids)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], np.int64)
    head = np.array([len(doc_ids), len(ids), len(low)], np.int64)
    parts = [head, named, null, offsets.astype(np.int64), low.astype(np.uint32), width, exceptions, starts, packed, places, values.astype(np.uint32)]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def read_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, offsets, ids) of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    docs, n, blocks = (int(x) for x in take(np.int64, 3))
    named, null, offsets = take(np.int64, docs), take(np.uint8, docs), take(np.int64, docs + 1)
    low, width, exceptions, starts = take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint16, blocks), take(np.int64, blocks + 1)
    packed = take(np.uint8, int(starts[-1]))
    places, values = take(np.uint8, int(exceptions.sum())), take(np.uint32, int(exceptions.sum()))
    ids = decode_blocks(n, low, width, exceptions, packed, places, values)
    return [None if x else int(d) for d, x in zip(named, null, strict=True)], offsets, ids


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 4_000_000) -> DataFrame:
    """Encode every whole text and write the ids in ascending id order; returns the manifest.

    Manifest: part, seq, path, n_docs, n_ids and first (ids in all files before).
    Files follow each other by (part, seq). A null text is empty and has the end id
    alone; a null document id comes first; rows with equal ids follow each other by
    text. A text of any length stays whole in one file. Ids are cast to long. An empty
    table gives an empty manifest.
    """
    spark = docs.sparkSession
    finish_steps(spark)
    rows = texts(docs, id_col, text_col)
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    folder = scratch_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal seq
            doc_ids = [d for h in held for d in h[0]]
            sizes = np.concatenate([np.diff(h[1]) for h in held])
            data = file_bytes(doc_ids, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([h[2] for h in held]))
            fs, base = filesystem(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.pfr"  # a repeated task writes new files; the manifest names those that count
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            seq += 1
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{name}", "n_docs": len(doc_ids), "n_ids": int(sizes.sum())}], schema)

        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            doc_ids, words = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo in range(0, len(words), 1000):
                ids, offsets = enc.encode(words[lo : lo + 1000])
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                held.append((doc_ids[lo : lo + 1000], offsets + np.arange(len(offsets)), ids))
                if sum(len(h[2]) for h in held) >= file_ids:
                    yield flush()
                    held = []
                    give_back()
        if held:
            yield flush()

    manifest = materialise(rows.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long"), "token-manifest")
    # one row per file of file_ids ids
    first = F.sum("n_ids").over(W.orderBy("part", "seq")) - F.col("n_ids")
    return manifest.withColumn("first", first)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_stream(path) as source:
                    doc_ids, offsets, ids = read_file(source.read())
                raw = ids.astype("<u4").tobytes()
                for lo in range(0, len(doc_ids), 1000):
                    hi = min(lo + 1000, len(doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[lo:hi], pa.int64()),
                            pa.array(offsets[lo:hi] + row["first"], pa.int64()),
                            pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()),
                            pa.array([raw[4 * a : 4 * b] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    files = manifest.select("path", "first").repartition(max(1, manifest.count()))  # one task per file
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written with the word vocabulary and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read_tokens(write_tokens(docs, vocabulary("word_bpe_49k.json"), 2))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
