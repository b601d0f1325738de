"""Hard negatives by exact scores of anchors against all rows, with Four-Russians tables.

1. Rows are packed into blocks: components are integers in two's complement, and a block
   keeps one byte per bit plane, row and group of eight dimensions.
2. For a block of anchors, every group of eight dimensions has a table of the sums of all
   256 subsets of an anchor's components. A row's byte is the index into it, so a plane's
   contribution is one lookup per group, and the planes are shifted and added from the top:
   the full exact inner product, without a multiplication.
3. Anchors are packed into shards. A task has one shard and reads part of the blocks, each as
   it comes, twice: rows of the anchor's own label give its positives, and then rows of other
   labels whose score lies in a positive's window give its negatives. A task answers with its
   own first few rows of each anchor, and a window over the answers keeps the first of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, give_back, named
from tallystone.session import materialise

ROWS = 4096  # rows of a block
ANCHORS, COMPONENTS = 4096, 1 << 18  # anchors of a shard, and their components if vectors are long
TOGETHER = 128  # anchors scored at once, so that their tables stay in a processor's cache
BLOCK = "block int, n long, ids binary, nulls binary, labels binary, planes binary, anchors binary, anchor_ids binary, anchor_labels binary, parts binary"
SHARD = "shard int, anchors binary, anchor_ids binary, anchor_labels binary, parts binary"
FOUND = "shard int, anchor long, partner_id long, score long"
MINED = "anchor long, anchor_id long, positive_id long, rank_of_positive int, positive_score long, partner_id long, score long"


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """values (rows x dimensions) as bytes [plane][group of eight dimensions][row], two's complement."""
    n, d = values.shape
    wide = np.zeros((n, -(-d // 8) * 8), np.int64)
    wide[:, :d] = values
    out = np.empty((planes, wide.shape[1] // 8, n), np.uint8)
    for p in range(planes):
        out[p] = np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """[group][subset][anchor]: sums of every subset of eight components of every anchor."""
    n, d = anchors.shape
    wide = np.zeros((n, -(-d // 8) * 8), kind)
    wide[:, :d] = anchors
    out = np.zeros((wide.shape[1] // 8, 256, n), kind)
    for g in range(len(out)):
        for k in range(8):
            out[g, 1 << k : 2 << k] = out[g, : 1 << k] + wide[:, 8 * g + k]
    return out


def scores(tables: np.ndarray, planes: np.ndarray, step: int = 1024) -> np.ndarray:
    """[row][anchor] inner products by lookups, one shift and add per plane."""
    n, kind = planes.shape[2], tables.dtype
    out = np.zeros((n, tables.shape[2]), kind)
    for lo in range(0, n, step):
        acc, part = out[lo : lo + step], np.empty((min(step, n - lo), tables.shape[2]), kind)
        for p in range(len(planes) - 1, -1, -1):
            np.left_shift(acc, 1, out=acc)
            for g in range(planes.shape[1]):
                np.take(tables[g], planes[p, g, lo : lo + step], axis=0, out=part, mode="clip")
                if p == len(planes) - 1:
                    acc -= part  # the sign's plane
                else:
                    acc += part
    return out


def _firsts(anchor: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's first k entries: higher scores first, then smaller ids, null ids last."""
    order = np.lexsort((ids, null, -score, anchor))
    sorted_anchor = anchor[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_anchor[1:] != sorted_anchor[:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class _First:
    """The first k entries of every key, of all that were added; floor is the least score that can still be one."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, np.iinfo(np.int64).min)
        self.key, self.score, self.ids, self.null = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)

    def add(self, key: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        live = score >= self.floor[key]
        if self.k < 1 or not live.any():
            return
        held = ((self.key, key), (self.score, score), (self.null, null), (self.ids, ids))
        key, score, null, ids = (np.concatenate([old, new[live]]) for old, new in held)
        some = _firsts(key, score, null, ids, self.k)
        self.key, self.score, self.null, self.ids = key[some], score[some], null[some], ids[some]
        edges = np.searchsorted(self.key, np.arange(len(self.floor) + 1))
        full = np.flatnonzero(np.diff(edges) == self.k)
        self.floor[full] = self.score[edges[full + 1] - 1]


def _batch(values: tuple, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(values, types, strict=True)], names=list(names))


def _packed(rows: DataFrame, planes: int, kind: type, blocks: int) -> DataFrame:
    """One row per block; anchors are its anchors' numbers (block and row), parts their components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one block
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = table.column("vector").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        values = np.zeros((len(sizes), max(1, int(sizes.max()))), np.int64)
        values[np.arange(values.shape[1]) < sizes[:, None]] = flat
        ids, labels = table.column("id").combine_chunks(), table.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")  # rows of a label follow each other
        null, names, labels = ids.is_null().to_numpy(zero_copy_only=False)[order], ids.fill_null(0).to_numpy()[order], labels[order]
        places = np.flatnonzero(table.column("is_anchor").to_numpy()[order])
        values, block = values[order], TaskContext.get().partitionId()
        of_anchors = ((np.int64(block) << 32) | places, names[places], labels[places], values[places].astype(kind))
        out = (block, len(order), *(x.tobytes() for x in (names, null, labels, bit_planes(values, planes), *of_anchors)))
        yield _batch(tuple([x] for x in out), BLOCK)

    return materialise(rows.repartition(blocks).mapInArrow(pack, BLOCK), "vector-blocks")


def _shards(blocks: DataFrame, kind: type, count: int) -> DataFrame:
    """The anchors of all blocks in about ``count`` rows; anchors of a label follow each other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]  # one shard
        if not held:
            return
        anchors, ids, labels = (np.concatenate([np.frombuffer(r[c], np.int64) for r in held]) for c in ("anchors", "anchor_ids", "anchor_labels"))
        parts = [np.frombuffer(r["parts"], kind).reshape(len(r["anchors"]) // 8, -1) for r in held]
        wide = max(p.shape[1] for p in parts)
        parts = np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])
        order = np.argsort(labels, kind="stable")
        yield _batch(([TaskContext.get().partitionId()], *([x[order].tobytes()] for x in (anchors, ids, labels, parts))), SHARD)

    some = blocks.filter(F.octet_length("anchors") > 0).select("anchors", "anchor_ids", "anchor_labels", "parts")
    return materialise(some.repartition(count).mapInArrow(pack, SHARD), "anchor-shards")


def _meetings(shards: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every block beside every shard, for as many tasks as a shuffle has: a task has one shard and reads its blocks from the table.

    Nothing is sent to the driver and no block is shuffled. A shard is no larger for more
    blocks, so the size of a table says nothing about a join of them: no side may be broadcast.
    """
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select("block", "n", "ids", "nulls", "labels", "planes").coalesce(-(-tasks // count))
    return rows.crossJoin(shards.repartitionByRange(count, "shard").hint("shuffle_replicate_nl"))


class _Block:
    """Rows of a block as arrays."""

    def __init__(self, row: dict, planes: int):
        self.block, self.labels = row["block"], np.frombuffer(row["labels"], np.int64)
        self.ids, self.null = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.planes = np.frombuffer(row["planes"], np.uint8).reshape(planes, -1, row["n"])


class _Shard:
    """Anchors of a shard as arrays, and what its task has found for them."""

    def __init__(self, row: dict, kind: type):
        self.shard = row["shard"]
        self.anchor, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("anchors", "anchor_ids", "anchor_labels"))
        self.parts = np.frombuffer(row["parts"], kind).reshape(len(self.anchor), -1)

    def scores(self, lo: int, hi: int, planes: np.ndarray) -> np.ndarray:
        """[row][anchor] of the anchors from lo to hi; what shorter vectors miss is zero and adds nothing."""
        groups = min(planes.shape[1], -(-self.parts.shape[1] // 8))
        return scores(subset_sums(self.parts[lo:hi, : 8 * groups], self.parts.dtype.type), planes[:, :groups])


class _Nearest(_Shard):
    """Positives of a shard's anchors."""

    def __init__(self, row: dict, kind: type, positives: int):
        super().__init__(row, kind)
        self.first = _First(len(self.anchor), positives)
        edges = np.flatnonzero(np.concatenate([[True], self.labels[1:] != self.labels[:-1], [True]]))
        self.chunks = [(at, min(hi, at + TOGETHER)) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for at in range(lo, hi, TOGETHER)]

    def meet(self, b: _Block) -> None:
        out = []
        for c, d in self.chunks:  # anchors of one label
            lo, hi = np.searchsorted(b.labels, self.labels[c]), np.searchsorted(b.labels, self.labels[c], "right")
            if hi == lo:
                continue
            s = self.scores(c, d, b.planes[:, :, lo:hi])
            floor = self.first.floor[c:d]
            if (floor == np.iinfo(np.int64).min).any():
                at = max(0, len(s) - self.first.k - 1)
                floor = np.maximum(floor, np.partition(s, at, axis=0)[at])
            i, a = np.nonzero(s >= floor.astype(s.dtype))
            other = ((np.int64(b.block) << 32) | (lo + i)) != self.anchor[c + a]  # an anchor is no partner of its own, whatever the score
            i, a = i[other], a[other]
            out.append((c + a, s[i, a].astype(np.int64), b.null[lo + i], b.ids[lo + i]))
        if out:
            self.first.add(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def answer(self) -> tuple:
        f = self.first
        return np.full(len(f.key), self.shard, np.int32), self.anchor[f.key], _nullable(f.ids, f.null), f.score


class _Windowed(_Shard):
    """Negatives of a shard's anchors in the windows of their positives."""

    def __init__(self, row: dict, kind: type, negatives: int, low: int, high: int):
        super().__init__(row, kind)
        order = np.argsort(self.anchor)
        owner = order[np.searchsorted(self.anchor, np.array([w["anchor"] for w in row["positives"]], np.int64), sorter=order)]
        by_owner = np.argsort(owner, kind="stable")
        self.owner, self.wanted = owner[by_owner], [row["positives"][i] for i in by_owner.tolist()]
        target = [w["score"] for w in self.wanted]
        self.least = np.array([-(-low * t // 100) for t in target], np.int64)
        self.greatest = np.array([high * t // 100 for t in target], np.int64)
        self.first = _First(len(target), negatives)

    def meet(self, b: _Block) -> None:
        out, least, k = [], np.maximum(self.least, self.first.floor), self.first.k
        for c in range(0, len(self.anchor), TOGETHER):
            d = min(len(self.anchor), c + TOGETHER)
            lo, hi = np.searchsorted(self.owner, [c, d])
            if hi == lo:
                continue
            owner, bottom, top = self.owner[lo:hi] - c, least[lo:hi], self.greatest[lo:hi]
            lows, highs = np.full(d - c, np.iinfo(np.int64).max), np.full(d - c, np.iinfo(np.int64).min)
            np.minimum.at(lows, owner, bottom)
            np.maximum.at(highs, owner, top)
            s = self.scores(c, d, b.planes)
            edge = np.iinfo(s.dtype)  # no score is that low or high
            i, a = np.nonzero((s >= lows.clip(edge.min, edge.max).astype(s.dtype)) & (s <= highs.clip(edge.min, edge.max).astype(s.dtype)) & (b.labels[:, None] != self.labels[c:d]))
            if not len(i):
                continue
            s = s[i, a].astype(np.int64)
            order = np.lexsort((b.ids[i], b.null[i], -s, a))
            i, a, s = i[order], a[order], s[order]
            edges = np.searchsorted(a, np.arange(d - c + 1))
            at = _first_at_most(s, edges[owner], edges[owner + 1], top)[:, None] + np.arange(k)
            inside = at < edges[owner + 1][:, None]
            inside &= s[np.where(inside, at, 0)] >= bottom[:, None]
            whose, at = lo + np.nonzero(inside)[0], at[inside]
            out.append((whose, s[at], b.null[i[at]], b.ids[i[at]]))
        if out:
            self.first.add(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def answer(self) -> tuple:
        f, own = self.first, self.owner[self.first.key]
        positive = pa.array([w["partner_id"] for w in self.wanted], pa.int64()).take(pa.array(f.key))
        rank, target = np.array([w["rank_of_positive"] for w in self.wanted], np.int32), np.array([w["score"] for w in self.wanted], np.int64)
        return self.anchor[own], self.ids[own], positive, rank[f.key], target[f.key], _nullable(f.ids, f.null), f.score


def _first_at_most(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For every run [lo, hi) of s, which falls in it, the first place with at most ``most``, or hi."""
    while (some := lo < hi).any():
        middle = (lo + hi) // 2
        over = some & (s[np.where(some, middle, 0)] > most)
        lo, hi = np.where(over, middle + 1, lo), np.where(some & ~over, middle, hi)
    return lo


def _by_task(frame: DataFrame, start, planes: int, schema: str) -> DataFrame:
    """Let ``start(row)`` of every shard meet the blocks one at a time; a batch holds few rows, as each is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard = row.column("shard")[0].as_py()
                if shard not in shards:
                    shards[shard] = start(row.to_pylist()[0])
                shards[shard].meet(_Block(row.select(["block", "n", "ids", "nulls", "labels", "planes"]).to_pylist()[0], planes))
        for shard in shards.values():
            yield _batch(shard.answer(), schema)
        give_back()

    return frame.mapInArrow(run, schema)


def _nullable(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` says which rows are anchors (null: not). Components become floor(256 * x);
    scores are integer inner products. An anchor's positives are its first ``positives``
    other rows of the same label, a positive's negatives the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score; higher
    scores come first, then smaller ids, null ids last.

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Ids and labels are cast to long. Repeated rows are rows of their own: an anchor leaves
    out only itself. Vectors of different length: missing components count as zero, and so
    does an empty vector. Scores that a long cannot hold raise ValueError. An empty table,
    or one without anchors, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    finish_steps(spark)
    number = lambda x: x.cast("double")
    finite = F.forall(named(vector_col), lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    rows = vectors.select(
        named(id_col).cast("long").alias("id"),
        named(label_col).cast("long").alias("label"),
        F.transform(named(vector_col), number).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.coalesce(finite, F.lit(False)).alias("finite"),
    )
    rows = rows.filter("label is not null and vector is not null and finite").drop("finite")
    largest = F.max(F.abs(F.array_max(F.transform("vector", F.abs))))
    n, owners, most, d = rows.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(largest, F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    reach = int(256 * most) + 1
    if reach * reach * max(d, 1) >= 1 << 63:
        raise ValueError(f"scores of components up to {most} do not fit a long")
    planes, kind = reach.bit_length() + 1, np.int32 if 2 * reach * reach * max(d, 1) < 1 << 31 else np.int64
    # rows of a block are bytes in many copies, so a batch for Python holds few blocks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block_rows))
    blocks = _packed(rows, planes, kind, max(1, -(-n // block_rows)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    count = max(1, -(-owners // max(1, min(ANCHORS, COMPONENTS // max(1, d)))))
    shards = _shards(blocks, kind, count)

    order = (F.desc("score"), F.asc_nulls_last("partner_id"))
    found = _by_task(_meetings(shards, blocks, count), lambda row: _Nearest(row, kind, positives), planes, FOUND)
    found = found.withColumn("rank_of_positive", F.row_number().over(W.partitionBy("anchor").orderBy(*order))).filter(F.col("rank_of_positive") <= positives)
    # at most ``positives`` of each anchor of a shard
    kept = found.groupBy("shard").agg(F.collect_list(F.struct("anchor", "rank_of_positive", "partner_id", "score")).alias("positives"))
    shards = materialise(shards.join(kept.hint("merge"), "shard"), "positives-of-shards")

    out = _by_task(_meetings(shards, blocks, count), lambda row: _Windowed(row, kind, negatives, low, high), planes, MINED)
    out = materialise(out, "hard-negatives")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rank = F.row_number().over(W.partitionBy("anchor", "rank_of_positive").orderBy(*order))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh has its label moved by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), r AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
