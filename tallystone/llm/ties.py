"""Which of very many keys occur more than once, answered to where they came from.

Keys travel in packed arrays, one row per batch and bucket of the hash range, so the
cost per key is its bytes. A key that a batch holds several times is settled there
and sent once, with a weight, whatever its number: a key that a third of all rows
share costs one entry per batch. Buckets answer with the ordinals of the tied keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallystone.llm.common import give_back

PACKED = "kind int, batch long, bucket long, keys binary, checks binary, places binary, many_keys binary, many_checks binary"
ANSWER = "kind int, batch long, keys binary, places binary"


def _ties(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal (key, check) pairs together, group number along it)."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    clash = np.flatnonzero(~new[1:] & (c[1:] != c[:-1])) + 1
    if len(clash):  # one key, two checks: order those runs by check too
        group = np.cumsum(new)
        odd = np.isin(group, group[clash])
        at = np.flatnonzero(odd)
        order[at] = order[at][np.lexsort((c[at], k[at]))]
        k, c = keys[order], checks[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    return order, np.cumsum(new) - 1


def tied(
    rows: DataFrame,
    emit: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, bytes]]],
    finish: Callable[[bytes, np.ndarray], pd.DataFrame],
    schema: str,
    buckets: int,
) -> DataFrame:
    """``emit`` gives (keys, checks, what the batch needs later) for each batch of a task;
    ``finish`` gets that back with a flag per key: is an equal key anywhere else?"""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        cut = np.array([int(b * 2**64 // buckets) for b in range(1, buckets)], np.uint64)
        names = ["kind", "batch", "bucket", "keys", "checks", "places", "many_keys", "many_checks"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        for seq, (keys, checks, meta) in enumerate(emit(batches)):
            batch = (part << 20) | seq
            order, group = _ties(keys, checks)
            size = np.bincount(group) if len(keys) else np.zeros(0, np.int64)
            many = size[group] > 1 if len(keys) else np.zeros(0, bool)
            flags = np.zeros(len(keys), bool)
            flags[order[many]] = True
            one = order[~many]
            lead = order[many & np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]]
            ones = np.concatenate([[0], np.searchsorted(keys[one], cut), [len(one)]])
            leads = np.concatenate([[0], np.searchsorted(keys[lead], cut), [len(lead)]])
            out = [(1, batch, batch % buckets, meta, b"", np.packbits(flags).tobytes(), np.int64(len(keys)).tobytes(), b"")]
            for b in range(buckets):
                x, y = one[ones[b] : ones[b + 1]], lead[leads[b] : leads[b + 1]]
                if len(x) or len(y):
                    out.append((0, batch, b, keys[x].tobytes(), checks[x].tobytes(), x.astype(np.uint32).tobytes(), keys[y].tobytes(), checks[y].tobytes()))
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        meta, frame = frame[frame["kind"] == 1], frame[frame["kind"] == 0]
        out = [(1, m.batch, m.keys, m.places + m.many_keys) for m in meta.itertuples()]
        if len(frame):
            read = lambda c, kind: [np.frombuffer(x, kind) for x in frame[c]]
            ones, leads = read("keys", np.uint64), read("many_keys", np.uint64)
            keys = np.concatenate(ones + leads)
            checks = np.concatenate(read("checks", np.uint32) + read("many_checks", np.uint32))
            order, group = _ties(keys, checks)
            n = sum(map(len, ones))
            size = np.bincount(group, np.where(order < n, 1, 2))
            hit = np.zeros(len(keys), bool)
            hit[order] = size[group] > 1
            edges = np.cumsum([0, *map(len, ones)])
            for i, (batch, places) in enumerate(zip(frame["batch"], read("places", np.uint32), strict=True)):
                found = places[hit[edges[i] : edges[i + 1]]]
                if len(found):
                    out.append((0, batch, b"", found.tobytes()))
        return pd.DataFrame(out, columns=["kind", "batch", "keys", "places"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        meta = frame[frame["kind"] == 1].iloc[0]
        n = int(np.frombuffer(meta["places"][-8:], np.int64)[0])
        flags = np.unpackbits(np.frombuffer(meta["places"][:-8], np.uint8), count=n).astype(bool)
        for places in frame.loc[frame["kind"] == 0, "places"]:
            flags[np.frombuffer(places, np.uint32)] = True
        return finish(meta["keys"], flags)

    answers = rows.mapInArrow(send, PACKED).groupBy("bucket").applyInPandas(settle, ANSWER)
    return answers.groupBy("batch").applyInPandas(gather, schema)
