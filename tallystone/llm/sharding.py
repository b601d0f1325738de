"""Shards by best-fit-decreasing bin packing.

Equal texts form one group and stay together; only a group that no bin could hold is cut.
Groups of one size are interchangeable, so what is packed is the list of sizes with their
numbers: sizes in descending order, each into the bins with the least room that still
holds it. Bins with equal room are one node of a balanced tree, so the work follows the
number of different sizes and not that of the groups. The plan says which of a size's
groups go to which bins; groups are numbered within their size by Spark and look it up.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, texts
from tallystone.session import materialise

PLAN = "bytes long, first long, units long, each long, bin long"


class Capacities:
    """A treap of remaining capacities: the balanced tree that best fit searches."""

    def __init__(self):
        self.root, self.seed = None, 1

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key):
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % 2**64
        low, high = self.cut(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.seed >> 33, None, None]), high)

    def cut(self, node, key):
        """The nodes below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self.cut(node[3], key)
            node[3] = low
            return node, high
        low, high = self.cut(node[2], key)
        node[2] = high
        return low, node

    def tightest(self, size):
        """Smallest remaining capacity that still holds ``size``; taken out of the tree."""
        low, high = self.cut(self.root, size)
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self.cut(high, node[0] + 1)
        self.root = self._merge(low, rest)
        return node[0]


def pack_sizes(sizes: list[tuple[int, int]], capacity: int, limit: int | None = None) -> list[tuple] | None:
    """Best fit decreasing of (size, number) in descending order, as runs of ``PLAN``.

    A run: the units ``first`` .. ``first + units - 1`` of a size go to ``bin`` and the bins
    after it, ``each`` to a bin. None if more than ``limit`` bins would be opened. A size
    above the capacity gets bins of its own.
    """
    tree, alike, bins, runs = Capacities(), {}, 0, []  # alike: remaining capacity -> heap of bin ranges

    def give(room, lo, hi):
        if room not in alike:
            alike[room] = []
            tree.add(room)
        heapq.heappush(alike[room], (lo, hi))

    for size, number in sizes:
        first = 0
        while first < number:
            room = tree.tightest(size)
            if room is None:
                room = max(capacity, size)
                needed = -(-(number - first) // (room // size))
                if limit is not None and bins + needed > limit:
                    return None
                ranges, bins = [(bins, bins + needed)], bins + needed
            else:
                ranges = alike.pop(room)
            each = room // size
            while ranges and first < number:
                lo, hi = heapq.heappop(ranges)
                full = min(hi - lo, (number - first) // each)
                if full:
                    runs.append((size, first, full * each, each, lo))
                    give(room - each * size, lo, lo + full)
                    first, lo = first + full * each, lo + full
                if lo < hi and first < number:  # the last bin is not filled with this size
                    rest = number - first
                    runs.append((size, first, rest, rest, lo))
                    give(room - rest * size, lo, lo + 1)
                    first, lo = number, lo + 1
                if lo < hi:
                    heapq.heappush(ranges, (lo, hi))
            for lo, hi in ranges:
                give(room, lo, hi)
    return runs


def counted(sizes: list[int]) -> list[tuple[int, int]]:
    """(size, number) of sizes in descending order."""
    out: list[list[int]] = []
    for size in sizes:
        if out and out[-1][0] == size:
            out[-1][1] += 1
        else:
            out.append([size, 1])
    return [(a, b) for a, b in out]


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """Bin of each size (given in descending order); None if more than ``limit`` bins would be opened."""
    runs = pack_sizes(counted(sizes), capacity, limit)
    if runs is None:
        return None
    return [bin_ + k // each for _, _, units, each, bin_ in runs for k in range(units)]


def tightest_plan(sizes: list[tuple[int, int]], shards: int) -> list[tuple]:
    """The plan under the smallest capacity, to a 4096th, that needs no more than ``shards`` bins."""
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // shards), max((s for s, _ in sizes), default=1))
    high, step = low, max(1, low // 4096)
    while (best := pack_sizes(sizes, high, shards)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while high - low > low // 4096:
        mid = (low + high) // 2
        found = pack_sizes(sizes, mid, shards)
        low, high, best = (low, mid, found) if found is not None else (mid + 1, high, best)
    return best


def tightest_packing(sizes: list[int], shards: int) -> list[int]:
    """Bins of sizes in descending order under :func:`tightest_plan`."""
    return [bin_ + k // each for _, _, units, each, bin_ in tightest_plan(counted(sizes), shards) for k in range(units)]


def _numbered(rows: DataFrame, key: str, spread: list[str], parts: int) -> DataFrame:
    """``no``: place of each row among those of its ``key``, from 0; a frequent key is numbered in ``parts`` tasks."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    counts = rows.groupBy(key, "part").count()
    before = F.sum("count").over(W.partitionBy(key).orderBy("part")) - F.col("count")
    starts = counts.select(key, "part", before.alias("before"))
    place = F.row_number().over(W.partitionBy(key, "part").orderBy(*spread))
    out = rows.withColumn("place", place).join(starts, [key, "part"])
    return out.withColumn("no", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def assign(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, grp, shard and slot of every row.

    With ``capacity``, as few shards of at most so many bytes as best fit decreasing needs;
    otherwise ``shards`` shards of nearly equal bytes, those of the smallest capacity (to a
    4096th) for which it needs no more.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1). Rows with equal texts, empty and
    null ones included, share a shard. A group larger than a shard is cut, as no bin could
    hold it: into pieces of a whole shard with ``capacity``, else of an eighth. A row that is
    larger than the capacity by itself, such as a very long text, has a shard to itself and is
    the only case above it. Ids are cast to long. Slots number a shard's rows from 0 by a hash of the id, then
    the id; repeated rows get slots of their own, a null id is an id like any other. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    finish_steps(spark)
    base = materialise(
        texts(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.sha2("text", 256).alias("grp"),
        ),
        "shard-rows",
    )
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most = capacity or max(1, -(-total // shards))  # what a group may have at most
    piece = capacity or max(1, most // 8)
    parts = 8 * (int(rows // 1_600_000) + 1)
    groups = base.groupBy("grp").agg(F.sum("size").alias("bytes"))
    # groups above a shard are few by their size; only their rows are numbered and cut
    large = materialise(groups.filter(F.col("bytes") > most).select("grp"), "shard-groups")
    cut = _numbered(base.join(large, "grp"), "grp", ["doc_id", "text_crc32"], parts)
    cut = cut.withColumn("piece", F.floor(F.col("no") / F.greatest(F.floor(F.lit(piece) / F.col("size")), F.lit(1)))).drop("no")
    rest = base.join(large, "grp", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    base = materialise(cut.unionByName(rest), "shard-pieces")
    units = base.groupBy("grp", "piece").agg(F.sum("size").alias("bytes"))
    units = materialise(_numbered(units, "bytes", ["grp", "piece"], parts), "shard-units")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bytes", ascending=False)
        sizes = list(zip(frame["bytes"].tolist(), frame["count"].tolist(), strict=True))
        runs = pack_sizes(sizes, capacity) if capacity else tightest_plan(sizes, shards)
        return pd.DataFrame(runs, columns=[c.split()[0] for c in PLAN.split(", ")])

    # one row per different size, which no number of groups makes more
    sizes = units.groupBy("bytes").count()
    plan = materialise(sizes.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(pack, PLAN), "shard-plan")
    inside = (F.col("no") >= F.col("first")) & (F.col("no") < F.col("first") + F.col("units"))
    placed = units.join(plan.withColumnRenamed("bytes", "run_bytes"), (F.col("bytes") == F.col("run_bytes")) & inside)
    shard = (F.col("bin") + F.floor((F.col("no") - F.col("first")) / F.col("each"))).cast("int")
    base = base.join(placed.select("grp", "piece", shard.alias("shard")), ["grp", "piece"])
    out = _numbered(base, "shard", ["doc_id", "text_crc32"], parts)
    return out.select("doc_id", "size", "text_crc32", "grp", "shard", F.col("no").cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
