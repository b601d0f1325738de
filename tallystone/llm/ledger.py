"""Secret scans with a ledger of blobs.

A text is a blob, named by its SHA-256. The ledger is a folder of Parquet files with
one row per scanned blob and set of rule versions: the rules tried and the spans
found, each with the version of its rule. A scan takes the distinct blobs, drops every (blob, rule version) pair that
the ledger already has, scans the rest, appends it, and joins the findings back to
all rows that hold the blob. Changing a rule changes its version, so only that rule
runs again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, named, process_cache, texts
from tallystone.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) needs ``least`` characters; ``fold`` ignores ASCII case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least, self.fold)).encode()).hexdigest()[:16]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
SPAN = "array<struct<kind:string,start:int,end:int>>"
LEDGER = "blob string, versions array<string>, secrets array<struct<kind:string,start:int,end:int,version:string>>"


def _spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Start, place of the rule in ``rules`` and end of each span."""
    cache = process_cache("patterns")
    out = []
    for order, rule in enumerate(rules):
        key = (rule.kind, rule.pattern, rule.least, rule.fold)
        if key not in cache:
            # long runs of one character class: asking for the least length at once skips the short ones
            quick = re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.kind == "hex" else rule.pattern
            cache[key] = re.compile(quick, re.ASCII | (re.IGNORECASE if rule.fold else 0))
        for m in cache[key].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Spans in code points, leftmost and non-overlapping per rule, by start and rule."""
    return [(rules[order].kind, start, end) for start, order, end in _spans(text, rules)]


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger does not have yet of the texts and rules, and append it."""
    spark = docs.sparkSession
    finish_steps(spark)
    text = F.coalesce(named(text_col), F.lit(""))
    # reduced before the shuffle: a text that a third of all rows hold is sent once per task
    blobs = docs.select(text.alias("text"), F.sha2(text, 256).alias("blob")).groupBy("blob").agg(F.first("text").alias("text"))
    versions = F.array(*[F.lit(r.version) for r in rules])
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        missing = F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(seen, "blob", "left").withColumn("missing", missing).filter(F.size("missing") > 0).drop("seen")
    else:
        blobs = blobs.withColumn("missing", versions)
    by_version = {r.version: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("version", pa.string())]))
        for batch in batches:
            found = []
            for text, missing in zip(batch.column("text").to_pylist(), batch.column("missing").to_pylist(), strict=True):
                wanted = tuple((r, v) for v, r in by_version.items() if v in missing)
                spans = _spans(text, tuple(r for r, _ in wanted))
                found.append([{"kind": wanted[k][0].kind, "start": a, "end": b, "version": wanted[k][1]} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("missing"), pa.array(found, kind)], names=["blob", "versions", "secrets"])

    blobs.select("blob", "text", "missing").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and ``secrets`` (kind, start, end; by start, then rule) of the blobs with any, by these versions of the rules only.

    A span of a ledger that has no versions of spans is taken to be by the rule of its
    kind among those its row tried.
    """
    own = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    tried = F.filter(own, lambda r: (r["kind"] == F.col("one.kind")) & F.array_contains("versions", r["version"]))
    version = F.coalesce("one.version", F.get(tried, F.lit(0))["version"])
    rank = F.array_position(F.array(*[F.lit(r.version) for r in rules]), version)
    found = spark.read.schema(LEDGER).parquet(ledger).withColumn("one", F.explode("secrets")).withColumn("rank", rank).filter("rank > 0")
    found = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("one.start", "rank", "one.kind", "one.end"))).alias("all"))
    return found.select("blob", F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("secrets"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and ``secrets`` of every row; fills ``ledger``.

    A null or empty text is a blob without findings. Every row keeps its id, null ids
    and repeated rows too; equal texts are scanned once. An empty table gives no rows.
    """
    record(docs, ledger, rules, text_col)
    rows = texts(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("blob"))
    out = rows.join(findings(docs.sparkSession, ledger, rules), "blob", "left")
    return out.select("doc_id", "blob", F.coalesce("secrets", F.array().cast(SPAN)).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret of ``text_col`` replaced by ``mark``; fills ``ledger``.

    Overlapping spans give one mark. Texts without secrets, null and empty ones stay as they are.
    """
    record(docs, ledger, rules, text_col)
    name, spans = "secrets of the blob", "array<struct<kind:string,start:int,end:int>>"
    found = findings(docs.sparkSession, ledger, rules).withColumnRenamed("secrets", name).withColumnRenamed("blob", "blob of the text")
    rows = docs.join(found, F.sha2(F.coalesce(named(text_col), F.lit("")), 256) == F.col("`blob of the text`"), "left").drop("blob of the text")

    def cut(words: pd.Series, secrets: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(words, secrets, strict=True):
            parts, done = [], 0
            for s in own if own is not None else ():
                if s["start"] >= done:
                    parts += [text[done : s["start"]], mark]
                done = max(done, s["end"])
            out.append("".join(parts) + text[done:] if parts else text)
        return pd.Series(out, dtype=object)

    clean = F.pandas_udf(cut, "string")(named(text_col), F.col(f"`{name}`").cast(spans))
    return rows.withColumn(text_col, F.when(F.col(f"`{name}`").isNull(), named(text_col)).otherwise(clean)).select(*[named(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an empty ledger."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "ledger"))
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
