"""URL rules held as a sorted array of 64-bit digests.

A list is a folder of shards. A shard is one file of four arrays: ascending
xxhash64 keys, the offsets of the full strings, their actions and the strings.
Workers memory-map the shards, probe all keys of a batch with one vectorised
binary search, and compare the stored string before a hit counts, so equal
digests of different strings cannot give a wrong verdict.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import filesystem, named, process_cache
from tallystone.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIONS = ("block", "allow")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*+([^?#]*)", 1)


def _shard_bytes(entries: list[tuple[bytes, int]]) -> bytes:
    """One shard: counts, path lengths in use, keys, offsets, actions, strings."""
    keys = np.array([xxhash.xxh64_intdigest(e) for e, _ in entries], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [entries[i][0] for i in order]
    actions = np.array([entries[i][1] for i in order], np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)]).astype(np.int64)
    lengths = np.array(sorted({len(e.decode()) - e.decode().index("/") for e, _ in entries}), np.int64)
    head = np.array([len(entries), len(lengths)], np.int64)
    return b"".join([head.tobytes(), lengths.tobytes(), keys[order].tobytes(), offsets.tobytes(), actions.tobytes(), *strings])


def write_list(entries: DataFrame, per_shard: int = 4_000_000) -> dict:
    """Write ``entries`` (rule, action) as digest shards; returns the leading bits used and the shards' files.

    A rule is host and path prefix, such as ``example.net/en/``. Null or slashless
    rules and unknown actions are refused. Of one rule listed several times, ``block``
    holds. Shards are cut by the leading bits of the key, so a shard stays near
    ``per_shard`` rules whatever the list's size.
    """
    spark = entries.sparkSession
    rows = entries.groupBy("rule").agg(F.max("action").alias("action"))
    bad = rows.filter("rule is null or action is null or action not in ('block', 'allow') or instr(rule, '/') = 0")
    if bad.take(1):
        raise ValueError("a rule needs host, path from its slash on, and block or allow")
    bits = max(0, (rows.count() // per_shard)).bit_length()
    folder = scratch_path(spark, "url-list")

    def shard_of(rules: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh64_intdigest(r.encode()) >> (64 - bits) if bits else 0 for r in rules], dtype="int64")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(_shard_bytes([(r.encode(), ACTIONS.index(a)) for r, a in zip(frame["rule"], frame["action"], strict=True)]))
        return pd.DataFrame({"shard": [shard], "file": [f"{folder}/{name}"]})

    shard = F.pandas_udf(shard_of, "long")
    done = rows.withColumn("shard", shard("rule")).groupBy("shard").applyInPandas(write, "shard long, file string")
    return {"bits": bits, "files": {r.shard: r.file for r in done.collect()}}  # one row per shard


class Mapped:
    """A memory-mapped shard."""

    def __init__(self, uri: str):
        from pyarrow import fs as pafs

        fs, path = filesystem(uri)
        if not isinstance(fs, pafs.LocalFileSystem):  # a map needs a file of this machine: one copy per worker
            local = os.path.join(tempfile.mkdtemp(), "shard.bin")
            pafs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
            path = local
        raw = np.memmap(path, np.uint8, "r")
        n, m = raw[:16].view(np.int64)
        at = 16

        def take(count, kind):
            nonlocal at
            out = raw[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += out.nbytes
            return out

        self.lengths, self.keys, self.offsets, self.actions = take(m, np.int64), take(n, np.uint64), take(n + 1, np.int64), take(n, np.uint8)
        self.strings = raw[at:]

    def find(self, keys: np.ndarray, wanted: list[bytes]) -> np.ndarray:
        """Row of each wanted string, -1 where it is not listed."""
        found = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        live = np.flatnonzero(at < len(self.keys))
        while len(live):
            live = live[self.keys[at[live]] == keys[live]]
            for i in live:  # confirm the full string; step on over rows with the same digest
                lo, hi = self.offsets[at[i]], self.offsets[at[i] + 1]
                if self.strings[lo:hi].tobytes() == wanted[i]:
                    found[i] = at[i]
            live = live[found[live] < 0]
            at[live] += 1
            live = live[at[live] < len(self.keys)]
        return found


def _mapped(files: dict[int, str]) -> dict[int, Mapped]:
    cache = process_cache("url_shards")
    return {shard: cache.get(uri) or cache.setdefault(uri, Mapped(uri)) for shard, uri in files.items()}


def judge(pages: DataFrame, rules: dict, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, the first in byte order among equally long ones.
    Without a rule the verdict is ``default``. Null and broken URLs have an empty
    host, fit no rule and get the default. Rows are judged one by one: repeated
    rows and null ids stay. The work is map-only.
    """
    bits, files = rules["bits"], rules["files"]
    host, path = host_and_path(named(url_col))
    rows = pages.select(named(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _mapped(files)
        lengths = sorted({int(n) for m in maps.values() for n in m.lengths})
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            owner, wanted = [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                tails = [p[:n].encode() for n in lengths if n <= len(p)]
                if not h or not tails:
                    continue
                suffix = h
                while True:
                    start = suffix.encode()
                    for t in tails:
                        owner.append(i)
                        wanted.append(start + t)
                    dot = suffix.find(".")
                    if dot < 0:
                        break
                    suffix = suffix[dot + 1 :]
            keys = np.array([xxhash.xxh64_intdigest(w) for w in wanted], np.uint64)
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            won, verdicts = [None] * len(hosts), [default] * len(hosts)
            for s in np.unique(shard):
                if s not in maps:
                    continue
                mine = np.flatnonzero(shard == s)
                hits = maps[s].find(keys[mine], [wanted[k] for k in mine])
                for k, row in zip(mine[hits >= 0], hits[hits >= 0], strict=True):
                    i, rule = owner[k], wanted[k].decode()
                    if won[i] is None or (-len(rule), rule) < (-len(won[i]), won[i]):
                        won[i], verdicts[i] = rule, ACTIONS[maps[s].actions[row]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(won, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL against the fixed rules."""
    rules = write_list(spark.createDataFrame(RULES, "rule string, action string"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict
  FROM split s LEFT JOIN rules r
    ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
