"""N-gram Jaccard join: rare-first prefixes, filters, one verification per pair.

1. Every document's distinct shingles are hashed where its text is scanned and
   counted over all documents in hash buckets. Shingles that several documents of
   a scan batch share travel once per batch with a count. A shingle that no other
   document has cannot match, so only the others come back to the document.
2. A document whose shared shingles cannot reach the threshold is done. The others
   order their shingles rare first (document frequency, then hash); the first
   n - ceil(t n) + 1 of all n are its prefix. Linked documents share a prefix shingle.
3. Documents with the same set collapse to one representative.
4. Representatives meet on prefix shingles. Length, positional and suffix filters are part
   of the meeting: the suffix filter is a parity sketch of the whole set, whose Hamming
   distance never exceeds the sets' difference. A pair that is left is verified once a round
   on its whole sets.
5. In a pivot round every shingle has one pivot, and a row is verified with the best pivot
   that passes the filters, so a round verifies no more pairs than there are rows. After
   that, pairs whose rows are known to be one component are left out, and the complete
   round verifies every other pair that passes: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import buckets_for, finish_steps, give_back, sliced, string_parts, texts
from tallystone.llm.components import components
from tallystone.llm.words import Words, owned
from tallystone.session import materialise

SKETCH = 4  # longs of a parity sketch
PACKED = "kind int, batch long, bucket long, keys binary, docs binary, heavy_keys binary, heavy_counts binary, heavy_first long"
REPLY = "batch long, kind int, keys binary, docs binary, heavy_keys binary, heavy_counts binary, heavy_first long"
SETS = "rid long, doc_id long, digest long, n long, sig1 long, sig2 long, shared long, tokens binary, sketch binary"


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document of each, set sizes): distinct shingles; a text of fewer words is one shingle, none without words."""
    w = Words(offsets, raw, lower=True)
    keys, owner, _ = w.shingles(k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    keys, owner = np.concatenate([keys, w.whole()[short]]), np.concatenate([owner, short])
    _, first = np.unique(owned(keys, owner), return_index=True)
    return keys[first], owner[first], np.bincount(owner[first], minlength=len(w.count))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that a set of ``n`` needs at least, whatever its partner."""
    return -(-n * percent // 100)


def shared_sets(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 6 << 20) -> DataFrame:
    """One row per document: rid, doc_id, set size, set digest, and for those that may have
    a partner their shingles of document frequency 2 or more, rare first."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(2.0 * total, spark, 8 << 20)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal seq
            ids = [d for h in held for d in h[0]]
            sizes, digests = (np.concatenate([h[c] for h in held]) for c in (3, 4))
            starts = np.cumsum([0, *[len(h[0]) for h in held]])
            keys = np.concatenate([h[1] for h in held])
            owner = np.concatenate([h[2] + s for h, s in zip(held, starts, strict=False)]).astype(np.uint32)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(keys)))
            light, heavy = first[count == 1], first[count > 1]
            at = np.repeat(count > 1, count)
            batch = (part << 20) | seq
            edges = [int(b * 2**64 // buckets) for b in range(1, buckets)]
            cut = np.array(edges, np.uint64)
            light_keys, light_docs = keys[light], owner[light]
            heavy_keys, heavy_counts = keys[heavy], count[count > 1].astype(np.uint32)
            lcut = [0, *np.searchsorted(light_keys, cut).tolist(), len(light_keys)]
            hcut = [0, *np.searchsorted(heavy_keys, cut).tolist(), len(heavy_keys)]
            out = []
            for b in range(buckets):
                l0, l1, h0, h1 = lcut[b], lcut[b + 1], hcut[b], hcut[b + 1]
                if l1 > l0 or h1 > h0:
                    out.append((0, batch, b, light_keys[l0:l1].tobytes(), light_docs[l0:l1].tobytes(), heavy_keys[h0:h1].tobytes(), heavy_counts[h0:h1].tobytes(), h0))
            # what the batch needs when the answers come: ids, set sizes, members of its heavy shingles, digests of its sets
            total1 = np.bincount(owner, minlength=len(ids)) * 0
            sig1, sig2 = total1.astype(np.uint64), total1.astype(np.uint64)
            np.add.at(sig1, owner, owned(keys, np.zeros(len(keys), np.int64)))
            np.add.at(sig2, owner, owned(keys, np.ones(len(keys), np.int64)))
            names = np.array([0 if d is None else d for d in ids], np.int64)
            null = np.array([d is None for d in ids], np.int64)
            meta = np.concatenate([names, null, digests, sizes.astype(np.int64), sig1.view(np.int64), sig2.view(np.int64)])
            out.append((1, batch, batch % buckets, meta.tobytes(), owner[at].tobytes(), heavy_keys.tobytes(), heavy_counts.tobytes(), len(ids)))
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=labels)

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        labels = ["kind", "batch", "bucket", "keys", "docs", "heavy_keys", "heavy_counts", "heavy_first"]
        for batch in sliced(batches, "text", 1 << 20):
            offsets, raw = string_parts(batch.column("text"))
            keys, owner, sizes = shingle_sets(offsets, raw, k)
            held.append((batch.column("doc_id").to_pylist(), keys, owner, sizes, batch.column("digest").to_numpy()))
            size += len(raw)
            if size >= batch_bytes or sum(len(h[0]) for h in held) >= 1 << 18:
                yield flush()
                held, size = [], 0
                give_back()
        if held:
            yield flush()
        give_back()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        meta, frame = frame[frame["kind"] == 1], frame[frame["kind"] == 0]
        out = [(m.batch, 1, m.keys, m.docs, m.heavy_keys, m.heavy_counts, m.heavy_first) for m in meta.itertuples()]
        lk = [np.frombuffer(x, np.uint64) for x in frame["keys"]]
        hk = [np.frombuffer(x, np.uint64) for x in frame["heavy_keys"]]
        hc = [np.frombuffer(x, np.uint32) for x in frame["heavy_counts"]]
        if lk:
            keys = np.concatenate(lk + hk)
            weight = np.concatenate([np.ones(sum(map(len, lk)), np.int64), *hc])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            df = np.add.reduceat(weight[order], np.flatnonzero(first))[np.cumsum(first) - 1]
            back = np.empty(len(keys), np.int64)
            back[order] = df
            lcut = np.cumsum([0, *map(len, lk)])
            hcut = lcut[-1] + np.cumsum([0, *map(len, hk)])
            for i, row in enumerate(frame.itertuples()):
                own = back[lcut[i] : lcut[i + 1]]
                met = np.flatnonzero(own > 1)
                docs = np.frombuffer(row.docs, np.uint32)[met]
                heavy = back[hcut[i] : hcut[i + 1]].astype(np.uint32)
                if len(met) or len(heavy):
                    out.append((row.batch, 0, lk[i][met].tobytes(), np.concatenate([docs, own[met].astype(np.uint32)]).tobytes(), b"", heavy.tobytes(), row.heavy_first))
        return pd.DataFrame(out, columns=["batch", "kind", "keys", "docs", "heavy_keys", "heavy_counts", "heavy_first"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        meta = frame[frame["kind"] == 1].iloc[0]
        frame = frame[frame["kind"] == 0]
        batch, n_docs = int(meta["batch"]), int(meta["heavy_first"])
        names, null, digests, sizes, sig1, sig2 = np.frombuffer(meta["keys"], np.int64).reshape(6, n_docs)
        heavy_keys = np.frombuffer(meta["heavy_keys"], np.uint64)
        heavy_df = np.zeros(len(heavy_keys), np.uint32)
        keys, docs, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for row in frame.itertuples():
            keys.append(np.frombuffer(row.keys, np.uint64))
            both = np.frombuffer(row.docs, np.uint32)
            docs.append(both[: len(keys[-1])])
            df.append(both[len(keys[-1]) :])
            some = np.frombuffer(row.heavy_counts, np.uint32)
            heavy_df[row.heavy_first : row.heavy_first + len(some)] = some
        times = np.frombuffer(meta["heavy_counts"], np.uint32)
        keys.append(np.repeat(heavy_keys, times))
        df.append(np.repeat(heavy_df, times))
        docs.append(np.frombuffer(meta["docs"], np.uint32))
        keys, docs, df = np.concatenate(keys), np.concatenate(docs), np.concatenate(df)
        shared = np.bincount(docs, minlength=n_docs)
        hopeful = (sizes > 0) & (shared >= _needed(sizes, percent))
        keep = hopeful[docs]
        keys, docs, df = keys[keep], docs[keep], df[keep]
        order = np.lexsort((keys, df, docs))
        keys, docs = keys[order], docs[order]
        starts = np.searchsorted(docs, np.arange(n_docs + 1))
        bits = 64 * SKETCH
        odd = np.bincount(docs.astype(np.int64) * bits + (keys % np.uint64(bits)).astype(np.int64), minlength=n_docs * bits) & 1
        sketch = np.packbits(odd.astype(np.uint8).reshape(n_docs, bits), axis=1)
        return pd.DataFrame(
            {
                "rid": (np.int64(batch) << 20) + np.arange(n_docs),
                "doc_id": pd.array([None if x else d for d, x in zip(names, null, strict=True)], "Int64"),
                "digest": digests,
                "n": sizes,
                "sig1": sig1,
                "sig2": sig2,
                "shared": shared,
                "tokens": [keys[starts[i] : starts[i + 1]].tobytes() if hopeful[i] else None for i in range(n_docs)],
                "sketch": [sketch[i].tobytes() if hopeful[i] else None for i in range(n_docs)],
            }
        )

    replies = rows.mapInArrow(emit, PACKED).groupBy("bucket").applyInPandas(count, REPLY)
    return materialise(replies.groupBy("batch").applyInPandas(gather, SETS), "shingle-sets")


POSTING = ", ".join(("token long", "rid long", "n long", "place long", "alone long", *(f"s{i} long" for i in range(SKETCH))))


def _prefix_rows(reps: DataFrame, percent: int) -> DataFrame:
    """Every prefix shingle that others have: rid, n, place in the whole rare-first order, how
    many shingles no other document has, and the sketch of the others."""
    names = [c.split()[0] for c in POSTING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rid, n, shared, raw, sketch in zip(*(batch.column(c).to_pylist() for c in ("rid", "n", "shared", "tokens", "sketch")), strict=True):
                alone = n - shared
                take = n - int(_needed(np.int64(n), percent)) + 1 - alone
                tokens = np.frombuffer(raw, np.int64)[:take]
                head = np.array([rid, n, 0, alone, *np.frombuffer(sketch, np.int64)], np.int64)
                rows = np.repeat(head[None], len(tokens), axis=0)
                rows[:, 2] = alone + np.arange(len(tokens))
                parts.append(np.column_stack([tokens, rows]))
            if parts:
                rows = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)

    return reps.select("rid", "n", "shared", "tokens", "sketch").mapInArrow(run, POSTING)


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose whole sets link."""
    sets = reps.select("rid", "n", "tokens")
    two = pairs.join(sets.toDF("a", "na", "tokens_a"), "a").join(sets.toDF("b", "nb", "tokens_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "tokens_a", "tokens_b")), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.select("a", "b", "na", "nb", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _may_link(percent: int):
    """Length, positional and suffix filters on two postings (x, y) of one shingle."""
    nx, ny = F.col("x.n"), F.col("y.n")
    length = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
    rest = 1 + F.least(nx - F.col("x.place") - 1, ny - F.col("y.place") - 1)
    apart = F.col("x.alone") + F.col("y.alone")
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}")))
    return length & ((100 + percent) * rest >= percent * (nx + ny)) & ((100 + percent) * (nx + ny - apart) >= 2 * percent * (nx + ny))


def _classes(hopeful: DataFrame) -> DataFrame:
    """rid and rep: the first of the documents with the same set; a frequent set is spread over ``salts`` tasks."""
    same, salts = ["n", "sig1", "sig2"], 16
    found = hopeful.groupBy(*same).agg(F.min("rid").alias("rep"), F.count("*").alias("times")).filter("times > 1")
    found = found.select(*same, "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = hopeful.select("rid", *same, F.pmod("rid", F.lit(salts)).alias("salt"))
    return rows.join(found, [*same, "salt"], "left").select("rid", F.coalesce("rep", "rid").alias("rep"))


def _settled(reps: DataFrame, links: DataFrame) -> DataFrame:
    """rid and comp of every representative: the component that ``links`` make."""
    roots = components(links).withColumnRenamed("node", "rid")
    return reps.select("rid").join(roots, "rid", "left").select("rid", F.coalesce("root", "rid").alias("comp"))


def linked(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pivots: int = 3) -> DataFrame:
    """rid, doc_id, digest, n_shingles, component_id and ``first`` of every row.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lowered. Two rows link
    if 100 * shared shingles >= percent * shingles of both. ``component_id`` is the
    smallest doc_id reachable over links (null ids only if there is no other), ``first``
    marks one row per component, that with the smallest doc_id. A null text or one
    without words has no shingles and links with nothing; repeated rows have equal sets
    and link; a text of any length is one set of all its shingles. Ids are cast to long.
    ``rid`` numbers the rows, ``digest`` is xxhash64 of the text. An empty table gives no
    rows. ``pivots`` is the number of pivot rounds; it changes the work, not the result.
    """
    spark = docs.sparkSession
    finish_steps(spark)
    sets = shared_sets(docs, k, percent, id_col, text_col)
    members = materialise(_classes(sets.filter("tokens is not null")), "set-members")
    reps = materialise(sets.join(members.filter("rid = rep").select("rid"), "rid"), "set-representatives")
    postings = _prefix_rows(reps, percent)
    busy = postings.groupBy("token").count().filter("count > 1").select("token")
    postings = materialise(postings.join(busy, "token"), "prefix-postings")
    here, links = postings.withColumn("comp", F.col("rid")), None
    for turn in range(pivots):
        # rows near the start of a round's order are the pivots of all their shingles
        mix = F.xxhash64("comp", "rid", F.lit(turn)) if turn else F.col("rid")
        dealt = here.withColumn("mix", mix)
        entry = F.struct("mix", *[c for c in dealt.columns if c not in ("mix", "token")])
        pivot = dealt.groupBy("token").agg(F.min(entry).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("token", "p.*")
        met = dealt.alias("x").join(pivot.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _may_link(percent))
        best = met.groupBy(F.col("x.rid").alias("a")).agg(F.min(F.struct("y.mix", "y.rid"))["rid"].alias("b"))
        found = materialise(_verified(best, reps, percent), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        # one hop: a row takes the smallest component it has a link to
        comp = here.select("rid", "comp").distinct()
        named = lambda end, other: found.select(F.col(end).alias("rid"), F.col(other).alias("other"))  # noqa: B023, E731
        hops = named("a", "b").unionByName(named("b", "a")).join(comp.toDF("other", "to"), "other").groupBy("rid").agg(F.min("to").alias("to"))
        here = materialise(here.join(hops, "rid", "left").withColumn("comp", F.least("comp", F.coalesce("to", "comp"))).drop("to"), "prefix-labels")
    if links is not None:
        here = materialise(postings.join(_settled(reps, links), "rid"), "prefix-labels")
    # every pair across components, met from the side outside the shingle's largest one
    parts = here.groupBy("token", "comp").agg(F.count("*").alias("m"))
    tops = parts.groupBy("token").agg(F.max(F.struct("m", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).filter("comps > 1").select("token", "major")
    here = materialise(here.join(tops, "token"), "prefix-tops")
    x, y = here.filter("comp <> major").alias("x"), here.alias("y")
    once = (F.col("y.comp") == F.col("y.major")) | (F.col("x.rid") < F.col("y.rid"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & once & _may_link(percent))
    pairs = materialise(met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct(), "candidate-pairs")
    found = _verified(pairs, reps, percent)
    labels = _settled(reps, found if links is None else links.unionByName(found))
    comps = members.join(labels.withColumnRenamed("rid", "rep"), "rep").select("rid", "comp")
    out = sets.select("rid", "doc_id", "digest", F.col("n").alias("n_shingles")).join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    out = materialise(out, "component-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid"))
    firsts = out.groupBy("comp").agg(least.alias("least")).select("comp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("least"))
    return out.join(firsts, "comp").select("rid", "doc_id", "digest", "n_shingles", "component_id", (F.col("rid") == F.col("least")).alias("first"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under four-word shingles and 85 percent."""
    out = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
    return out.select("doc_id", "n_shingles", "component_id")
