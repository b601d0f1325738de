"""Benchmark passages in training text, by spaced-seed hashing; SQL functions only.

A mask fixes which of ``SPAN`` words in a row must agree; the others may differ. The
masked words of every benchmark position and of every training position are hashed
and joined. Around a hit the item is laid over the document, and the overlap counts
if enough words agree, wherever words were substituted.

``WIDE`` masks hit every pattern of substitutions that 80 % allows in a window of 18 to 32
words; shorter items need ``DENSE`` besides, as the tests enumerate. ``DENSE`` is only
laid over them, so common word runs of long items are not joined.

All masks begin with two adjacent words, so a position is dropped by one probe of the
benchmark's word pairs before any mask is hashed. The benchmark's tables are broadcast
only after a count of their rows; beyond ``SMALL`` rows the joins are left to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, named
from tallystone.session import materialise

SPAN = 8
WIDE = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 4, 5, 7))
DENSE, DENSE_UP_TO = (0, 1, 2, 3), 17  # words of the longest item that needs it
MASKS = (*WIDE, *[tuple(o + at for o in DENSE) for at in range(SPAN - len(DENSE) + 1)])
RUN = 8  # words in a row that are no chance; chance runs of the sample tables have 6 at most
SMALL = 2_000_000  # rows of hashes and numbers: under 100 MB


def words(text: Column) -> Column:
    """Lower-cased words between white space; a border may give one empty word, which equals no other."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _masked(array: str, i: Column) -> list[Column]:
    return [F.xxhash64(F.lit(m), *[_at(array, i + o) for o in offsets]) for m, offsets in enumerate((*WIDE, DENSE))]


def _pair(array: str, i: Column) -> Column:
    return F.xxhash64(_at(array, i), _at(array, i + 1))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, window: int = 32, run: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, item_words and matched of every document and item that overlap.

    An item overlaps if, laid over the document at a seed hit, some ``window`` words of
    the item in a row (all, if it has fewer) agree in at least ``percent`` of their
    places. With ``run`` (``SPAN`` at least) as many words of it in a row that all agree
    are enough too, whatever the item's length. Items of fewer than ``SPAN`` words must occur whole and unchanged. Items
    without words match nothing. A text of any length is searched at every word. ``matched`` is the most words that agree in one
    place. Equal rows give one result row; documents are told apart by id only. Null
    texts are empty, null ids stay; empty tables give no rows.
    """
    if run is not None and run < SPAN:
        raise ValueError(f"run is under {SPAN}: shorter runs may have no seed")
    spark = docs.sparkSession
    finish_steps(spark)
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), F.array_remove(words(named(item_text)), "").alias("item"))
    items = materialise(items.filter("size(item) > 0").distinct(), "benchmark-items")
    long_items = items.filter(F.size("item") >= SPAN)
    reach = len(DENSE)
    spots = long_items.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - F.when(F.size("item") <= DENSE_UP_TO, reach).otherwise(SPAN))).alias("at"))
    *wide, dense = _masked("item", F.col("at"))
    wide = F.when(F.col("at") <= F.size("item") - SPAN, F.array(*wide)).otherwise(F.array().cast("array<bigint>"))
    dense = F.when(F.size("item") <= DENSE_UP_TO, F.array(dense)).otherwise(F.array().cast("array<bigint>"))
    seeds = spots.select("item_id", "at", _pair("item", F.col("at")).alias("pair"), F.concat(wide, dense).alias("hashes"))
    seeds = materialise(seeds.select("item_id", "at", "pair", F.explode("hashes").alias("seed")), "benchmark-seeds")
    small = seeds.count() <= SMALL
    sized = F.broadcast if small else (lambda df: df)

    base = docs.select(named(id_col).cast("long").alias("doc_id"), words(named(text_col)).alias("words"))
    if not small:  # positions are shuffled, so they name their text instead of carrying its words
        base = base.withColumn("digest", F.xxhash64("words"))
    last = F.size("words") - reach  # a mask that runs over the end has nulls there and equals no seed
    # explode over positions stays in generated code, so a long document's words are not copied per position
    places = base.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    seeded = [F.array(*_masked("words", F.col("i"))).alias("hashes"), _pair("words", F.col("i")).alias("pair")]
    if small:
        places = places.select("doc_id", "words", "i", *seeded[1:]).join(sized(seeds.select("pair").distinct()), "pair", "left_semi")
        hits = places.select("doc_id", "words", "i", F.explode(seeded[0]).alias("seed"))
        hits = hits.join(sized(seeds.select("seed", "item_id", "at")), "seed")
    else:
        places = places.select("doc_id", "digest", "i", *seeded).join(seeds.select("pair").distinct(), "pair", "left_semi")
        hits = places.select("doc_id", "digest", "i", F.explode("hashes").alias("seed")).join(seeds.select("seed", "item_id", "at"), "seed")
        hits = hits.drop("seed", "pair", "hashes").distinct().alias("h")
        held = base.dropDuplicates(["doc_id", "digest"]).alias("b")
        hits = hits.join(held, F.col("h.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("h.digest") == F.col("b.digest"))).select("h.doc_id", "words", "i", "item_id", "at")
    # the stretch of the document that the item covers, and where the item's first word would stand in it
    start = F.col("i") - F.col("at")
    hits = hits.join(sized(items.select("item_id", F.size("item").alias("n"))), "item_id").withColumn("start", start)
    low = F.greatest(F.col("start"), F.lit(0))
    stretch = F.slice("words", low + 1, F.least(F.col("start") + F.col("n"), F.size("words")) - low)
    hits = hits.select("doc_id", "item_id", F.least(F.col("start"), F.lit(0)).alias("lead"), stretch.alias("stretch")).distinct()
    laid = hits.join(sized(items), "item_id")
    # item word j stands at stretch word j + lead
    agree = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.coalesce(F.get("item", j) == F.get("stretch", j + F.col("lead")), F.lit(False)))
    laid = laid.withColumn("agree", agree)
    width = F.least(F.size("item"), F.lit(window))
    enough = F.exists(
        F.sequence(F.lit(0), F.size("item") - width),
        lambda s: 100 * F.size(F.filter("agree", lambda j: (j >= s) & (j < s + width))) >= percent * width,
    )
    enough &= 100 * F.size("agree") >= percent * width
    if run is not None:
        together = F.exists(F.sequence(F.lit(0), F.size("agree") - run), lambda s: F.get("agree", s + run - 1) - F.get("agree", s) == run - 1)
        enough |= F.when(F.size("agree") >= run, together).otherwise(F.lit(False))
    found = laid.filter(enough).select("doc_id", "item_id", F.size("item").alias("item_words"), F.size("agree").alias("matched"))

    short = items.filter(F.size("item") < SPAN).select("item_id", F.size("item").alias("n"), F.xxhash64(*[_at("item", F.lit(o)) for o in range(SPAN)]).alias("seed"), "item")
    short = materialise(short, "benchmark-short")
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # at most SPAN - 1 lengths
        last = F.size("words") - n
        runs = base.select("doc_id", "words", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
        seed = F.xxhash64(*[_at("words", F.col("i") + o) if o < n else F.lit(None).cast("string") for o in range(SPAN)])
        runs = runs.withColumn("seed", seed).join(sized(short.filter(F.col("n") == n)), "seed").filter(F.slice("words", F.col("i") + 1, n) == F.col("item"))
        found = found.unionByName(runs.select("doc_id", "item_id", F.lit(n).alias("item_words"), F.lit(n).alias("matched")))
    return found.groupBy("doc_id", "item_id").agg(F.max("item_words").cast("long").alias("item_words"), F.max("matched").cast("long").alias("matched"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the benchmark, runs of its items too."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), run=RUN)


_EQUAL = " OR ".join("(" + " AND ".join(f"p.w[p.i + {o + 1}] = s.w[s.i + {o + 1}]" for o in mask[2:]) + ")" for mask in WIDE)
_DENSE = " AND ".join(f"p.w[p.i + {o + 1}] = s.w[s.i + {o + 1}]" for o in DENSE[2:])
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT doc_id, w, unnest(range(len(w) - {len(DENSE) - 1})) AS i FROM d),
s AS (SELECT item_id, w, unnest(range(len(w) - {len(DENSE) - 1})) AS i FROM b WHERE len(w) >= {SPAN}),
hits AS (
  SELECT DISTINCT p.doc_id, s.item_id, p.w AS dw, s.w AS iw, p.i - s.i AS start
  FROM p JOIN s ON p.w[p.i + 1] = s.w[s.i + 1] AND p.w[p.i + 2] = s.w[s.i + 2]
  WHERE s.i <= len(s.w) - {SPAN} AND ({_EQUAL}) OR len(s.w) <= {DENSE_UP_TO} AND {_DENSE}),
laid AS (
  SELECT doc_id, item_id, len(iw) AS n, least(len(iw), 32) AS width,
         list_filter(range(len(iw)), lambda j: start + j >= 0 AND coalesce(dw[start + j + 1] = iw[j + 1], false)) AS agree FROM hits)
SELECT doc_id, item_id, max(n) AS item_words, max(matched) AS matched FROM (
  SELECT doc_id, item_id, n, len(agree) AS matched FROM laid
  WHERE len(list_filter(range(n - width + 1), lambda s: 100 * len(list_filter(agree, lambda j: j >= s AND j < s + width)) >= 80 * width)) > 0
     OR len(list_filter(range(len(agree) - {RUN - 1}), lambda s: agree[s + {RUN}] - agree[s + 1] = {RUN - 1})) > 0
  UNION ALL
  SELECT d.doc_id, b.item_id, len(b.w) AS n, len(b.w) AS matched FROM d JOIN b ON len(b.w) BETWEEN 1 AND {SPAN - 1} AND len(d.w) >= len(b.w)
  WHERE len(list_filter(range(len(d.w) - len(b.w) + 1), lambda i: d.w[i + 1 : i + len(b.w)] = b.w)) > 0)
GROUP BY doc_id, item_id
"""
