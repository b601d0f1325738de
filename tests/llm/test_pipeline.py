"""The stages one by one against plain Python, and the whole run."""

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups
from tokenizers import Tokenizer

from tallystone.llm import decontaminate, ledger, quality
from tallystone.llm.tokens import vocabulary


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def redacted(text):
    parts, done = [], 0
    for _, a, b in ledger.find(text or "", ledger.RULES):
        if a >= done:
            parts += [text[done:a], "[secret]"]
        done = max(done, b)
    return "".join(parts) + text[done:] if parts else text


def test_stages(spark, sf_dir, read):
    docs = read("documents")
    names = docs.columns
    stages = dict(cp.STAGES)
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    one = cp.materialise(stages["quality_rules"](spark, docs, sf_dir), "t")
    assert sorted(pairs(one)) == sorted(p for p in pairs(docs) if p[0] in good) and one.columns == names

    two = cp.materialise(stages["near_duplicates"](spark, one, sf_dir), "t")
    first = {c for _, _, c in groups(pairs(one), 5, 80)}
    assert sorted(pairs(two)) == sorted(p for p in pairs(one) if str(p[0]) in first) and two.columns == names
    assert two.count() < one.count()

    three = cp.materialise(stages["benchmark_decontamination"](spark, two, sf_dir), "t")
    split = lambda t: " ".join((t or "").split())
    bad = {d for d, _ in leaks([(d, split(t)) for d, t in pairs(two)], [(r.item_id, split(r.text)) for r in read("benchmark").collect()], run=decontaminate.RUN)}
    assert bad and sorted(pairs(three)) == sorted(p for p in pairs(two) if p[0] not in bad) and three.columns == names

    four = cp.materialise(stages["secret_scans"](spark, three, sf_dir), "t")
    assert sorted(pairs(four)) == sorted((d, redacted(t)) for d, t in pairs(three)) and four.columns == names
    assert four.filter("n_chars <> length(text)").count() == 0

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {d: [*tok.encode(t).ids, 0] for d, t in pairs(four)}
    got = {}
    for r in sorted(cp.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_repeated_and_null_rows(spark, sf_dir, read):
    docs = read("documents").limit(20)
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    rows = cp.materialise(docs.unionByName(docs).unionByName(odd), "t")
    for _, stage in cp.STAGES[:-1]:
        rows = cp.materialise(stage(spark, rows, sf_dir), "t")
    assert rows.count() == rows.select("doc_id", "text").distinct().count() > 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = cp.materialise(stage(spark, empty, sf_dir), "t")
    assert empty.count() == 0
