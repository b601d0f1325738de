"""Sources, sinks, generators, comparisons and streaming twins."""

import base64
import glob
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallystone.functions import dates, secrets, topics
from tallystone.operators import compare, ranking, versions
from tallystone.plans import bindings as b
from tallystone.plans import io
from tallystone.session import scratch_root
from tallystone.sources import generate, kafka, readers, sinks, tables
from tallystone.streaming import ingest


def test_corrupt_archive_fails_the_job(spark, folder):
    lines = spark.range(100).select(F.lit("2024-01-01").cast("date").alias("day"), F.lit("d").alias("database"), F.lit("c").alias("collection"), F.col("id").cast("string").alias("value"))
    sinks.write_jsonl_partitioned(lines, folder + "/x")
    assert readers.scan_jsonl_partitioned(spark, folder + "/x").count() == 100
    with open(folder + "/x/y=2024/m=01/d=01/db=d/coll=c/bad.txt.gz", "wb") as f:
        f.write(gzip.compress(b"line\n" * 1000)[:40])
    with pytest.raises(Exception):
        readers.scan_jsonl_partitioned(spark, folder + "/x").count()


def test_days_outside_the_range_are_not_read(spark, folder):
    lines = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("d").alias("database"), F.lit("c").alias("collection"), F.col("id").cast("string").alias("value"))
    sinks.write_jsonl_partitioned(lines, folder + "/x")
    pruned = readers.prune_ymd(readers.scan_jsonl_partitioned(spark, folder + "/x"), "2024-01-03", "2024-01-05")
    assert sorted(r.value for r in pruned.collect()) == ["2", "3", "4"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    everything = readers.prune_ymd(readers.scan_jsonl_partitioned(spark, folder + "/x"), readers.NOT_SET, None)
    assert everything.count() == 10


def test_json_array_file_is_one_row_per_element(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"journal_entry_id": str(i), "response": i} for i in range(6)], indent=2))
    got = readers.scan_json_array(spark, str(tmp_path), "journal_entry_id string, response int")
    assert got.count() == 6


def test_dated_folder_layout(spark, tmp_path):
    d = tmp_path / "2024/01/05/db/coll"
    d.mkdir(parents=True)
    (d / "a.jsonl.gz").write_bytes(gzip.compress(b'{"a":1}\n{"a":2}\n'))
    assert readers.scan_json_lines_layout(spark, str(tmp_path), "2024/01/05", "db").count() == 2


def test_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y\n")
    (tmp_path / "b.dat").write_text("12345")
    assert readers.file_listing(spark, str(tmp_path), r".*/a\.txt").count() == 1
    total = readers.prefix_size_and_count(readers.file_listing(spark, str(tmp_path))).first()
    assert (total.total_bytes, total.files, total.exists) == (9, 2, True)
    assert readers.files_with_content(spark, str(tmp_path), r".*\.txt").first().content == "xy"


def test_one_dead_letter_file_per_message(spark, folder):
    df = spark.createDataFrame([(str(i), "r", "k") for i in range(3)], "body string, reason string, key string").coalesce(1)
    sinks.write_dlq(df, folder + "/d", one_file_each=True)
    assert readers.file_listing(spark, folder + "/d", r".*\.parquet").count() == 3


def test_external_table(spark, folder):
    counts = spark.createDataFrame([], tables.COUNTS_DDL)
    name = tables.qualified_table_name("default", "counts_t", "Historic", "FULL")
    assert name == "default.counts_t_historic_full"
    tables.write_table(counts, name, "counts", folder + "/c")
    assert len(spark.table(name).columns) == 15
    tables.write_table(counts, name, "counts", folder + "/c")
    spark.sql(f"DROP TABLE {name}")


def test_key_methods_and_blocks(spark):
    requests = spark.createDataFrame([("t1", 2, 3), ("t2", 1, 3)], "topic string, files int, records int")
    base = F.lit("2018-11-01 03:02:01.001").cast("timestamp")
    n = lambda method: generate.generate_records(requests, '{"i":"||newid||","t":"||timestamp||"}', method, base).select("key").distinct().count()
    assert {m: n(m) for m in generate.KEY_METHODS} == {"single": 1, "static": 1, "topic": 2, "file": 3, "record": 6, "different": 9, "message": 9}
    big = spark.createDataFrame([("t", 1, generate.BLOCK * 2 + 5)], "topic string, files int, records int")
    made = generate.generate_records(big, "||newid||", "different", base)
    assert made.count() == made.select("key").distinct().count() == generate.BLOCK * 2 + 5
    with pytest.raises(ValueError):
        n("other")


def test_hash_and_amount(spark):
    df = spark.createDataFrame([("AB123456C",)], "n string")
    want = base64.urlsafe_b64encode(hashlib.sha512(b"AB123456Csalt").digest()).decode()
    assert df.select(secrets.hash_identifier(F.col("n"), "salt")).first()[0] == want
    sealed = df.select(secrets.encrypt_amount(F.lit("123.45"), F.lit("0123456789abcdef")).alias("s"))
    assert "\n" not in sealed.first().s
    assert sealed.select(secrets.decrypt_amount(F.col("s"), F.lit("0123456789abcdef"))).first()[0] == "123.45"


def test_topics_and_dates(spark):
    df = spark.createDataFrame([("db.a.b",), ("a.b|x",), ("data.equality",), ("plain",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(topics.topic_database(t), topics.topic_collection(t), topics.qualify_topic(t), topics.topic_to_table_name(t)).collect()]
    assert got == [("a", "b", "db.a.b", "a:b"), ("a", "b|x", "db.a.b", None), ("data", "equality", "data.equality", "data:equality"), (None, "plain", "db.plain", None)]
    iso = lambda s, m=0: spark.range(1).select(dates.iso_to_millis(F.lit(s), m)).first()[0]
    assert iso("2019-11-15T09:09:55.000") == 1573808995000 and iso("2019-11-15T09:09:55.000", 2) == 1573809115000
    day = lambda s, d, m: str(spark.range(1).select(dates.offset_date(F.lit(s).cast("date"), d, m)).first()[0])
    assert day("2024-03-31", -3, -1) == "2024-02-28" and day("2024-03-31", None, -1) == "2024-02-29"


def test_set_checks_with_duplicates_and_nulls(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    v = compare.result_set_verify(left, right).first()
    assert (v.golden_rows, v.actual_rows, v.missing_rows, v.unexpected_rows, v.matches) == (3, 3, 1, 1, False)
    assert compare.set_contains(left, right).count() == 0
    assert [tuple(r) for r in compare.set_contains(right, left).collect()] == [(3, "y")]
    e = compare.set_equal(left, right).first()
    assert (e.only_left, e.only_right, e.equal) == (0, 1, False)
    one = spark.createDataFrame([('{"a":1,"b":{"d":1,"c":[2]}}',)], "value string")
    two = spark.createDataFrame([('{"b":{"c":[2],"d":1}, "a":1}',), ("{}",)], "value string")
    assert compare.snapshot_containment(one, two).count() == 0
    assert compare.snapshot_containment(two, one).count() == 1
    broken = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    assert {r.value for r in compare.snapshot_containment(broken("{a", "{b", "{c"), broken("{c", "{d")).collect()} == {"{a", "{b"}


def test_dead_letters_without_a_key(spark):
    dlq = spark.createDataFrame([("t", None, 1), ("t", None, 2), ("t", "k", 3), ("t", "k", 4)], "topic string, key string, sequence int")
    store = spark.createDataFrame([("t", None, 1)], "topic string, id string, sequence int")
    noted = spark.createDataFrame([("t", "k", 4)], "topic_name string, hbase_id string, sequence int")
    assert {r.sequence for r in compare.dlq_not_in_store(dlq, store, noted).collect()} == {2, 3}


def test_joins_of_records_are_not_broadcast(spark, folder):
    """The keys of the store grow with the input, so they do not go through the driver."""

    def kept(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    dlq = kept("dlq", [("t", "k", 1, "x"), ("t", "k", 1, "y"), ("t", "k", 2, "x"), ("t", None, 3, "x")], "topic string, key string, sequence int, reason string")
    store = kept("store", [("t", "k", 2), ("t", "k", 2)], "topic string, id string, sequence int")
    noted = kept("noted", [("t", None, 3)], "topic_name string, hbase_id string, sequence int")
    meta = kept("meta", [("k", 2, "t", 0, None)], "hbase_id string, hbase_timestamp int, topic_name string, reconciled_result int, reconciled_timestamp timestamp")
    text = kept("text", [("t", "k", "{}")], "topic string, id string, value string")
    absent = compare.dlq_not_in_store(dlq, store, noted)
    known = compare.metadata_reconcile(meta, store.withColumnRenamed("sequence", "version"), F.lit("2024-01-01").cast("timestamp"))
    looked = compare.store_lookup_compare(text, text)
    for df in (absent, known, looked):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in absent.collect()) == [("t", "k", 1, "x"), ("t", "k", 1, "y")]
    assert known.first().reconciled_result == 1 and looked.first().passed


def test_reconcile_only_touches_open_rows(spark):
    schema = "hbase_id string, hbase_timestamp bigint, topic_name string, reconciled_result int, reconciled_timestamp timestamp"
    meta = spark.createDataFrame([("a", 1, "t", 0, None), ("b", 1, "t", 0, None)], schema)
    store = spark.createDataFrame([("a", 1, "t"), ("a", 1, "t")], "id string, version bigint, topic string")
    at = lambda s: F.lit(s).cast("timestamp")
    first = compare.metadata_reconcile(meta, store, at("2024-01-01"))
    again = compare.metadata_reconcile(first, store, at("2025-01-01"))
    assert sorted((r.hbase_id, r.reconciled_result, str(r.reconciled_timestamp)) for r in again.collect()) == [
        ("a", 1, "2024-01-01 00:00:00"), ("b", 0, "None"),
    ]


def test_row_numbers_with_a_dominant_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), ((F.col("id") * 7919) % 2003).alias("v"))
    got = sorted((r.g, r.v, r.row_no) for r in ranking.numbered(df, "g", ["v"]).collect())
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    want = sorted((g, v, i) for g, vs in groups.items() for i, v in enumerate(sorted(vs), 1))
    assert got == want


def test_rows_without_a_group_are_numbered(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    got = {(r.g, r.v): r.row_no for r in ranking.numbered(df, "g", ["v"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 5): 1}


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = ranking.top_n_per_group(df, ["g"], [F.desc("v")], 4)
    assert top.count() == 12
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_counting_uses_one_shuffle_for_the_match(spark, sf_dir):
    from tallystone.plans.recon import counts_table

    plan = counts_table(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan and "Join" not in plan


def test_messages_are_parsed_once(spark, sf_dir):
    from tallystone.plans import cdc

    plan = cdc.store(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def _stream(spark, sf_dir, path):
    rows = b.envelopes(spark, sf_dir).select("topic", F.col("event_id").cast("string").alias("key"), "value")
    # newest first: arrival order must not matter
    for part in (2, 1, 0):
        kafka.file_topic_write(rows.where(F.col("key").cast("int") % 3 == part), path)
    return kafka.file_topic_stream(spark, path, 6).select(F.col("key").cast("bigint").alias("sequence"), "topic", "value")


def test_stream_equals_batch_and_survives_a_replay(spark, sf_dir, folder):
    from tallystone.plans import cdc

    layout = ingest.Layout(folder + "/job")
    ingest.ingest_stream(_stream(spark, sf_dir, folder + "/topic"), layout).awaitTermination()
    key = lambda df: sorted((r.topic, r.id, r.version) for r in df.select("topic", "id", "version").collect())
    batch = key(cdc.store(spark, sf_dir))
    assert key(ingest.current_state(spark, layout)) == batch
    folders = spark.read.parquet(layout.store).select("batch_id").distinct().count()
    assert folders >= 3
    # the same batch written again leaves one copy
    before = ingest.store_versions(spark, layout).count()
    whole = b.envelopes(spark, sf_dir).select(F.col("event_id").alias("sequence"), "topic", "value")
    ingest.write_batch(layout)(whole, 0)
    ingest.write_batch(layout)(whole, 0)
    assert key(ingest.current_state(spark, layout)) == batch
    assert ingest.store_versions(spark, layout).count() >= before
    through = ingest.compact(spark, layout)
    assert through == folders - 1 and ingest.compact(spark, layout) == through
    assert key(ingest.current_state(spark, layout)) == batch
    # a late, newer version arrives after the compaction and is folded into the next one
    late = whole.where("sequence % 50 = 11").limit(1).select(
        (F.col("sequence") + 10**9).alias("sequence"), "topic", F.regexp_replace("value", r'"_lastModifiedDateTime":"\d{4}', '"_lastModifiedDateTime":"2099').alias("value")
    )
    ingest.write_batch(layout)(late, through + 1)
    newer = key(ingest.current_state(spark, layout))
    assert newer != batch and len(newer) == len(batch)
    assert ingest.compact(spark, layout) == through + 1 and key(ingest.current_state(spark, layout)) == newer
    done = ingest.reconcile(spark, layout, F.lit("2024-01-01").cast("timestamp"))
    assert done.where("reconciled_result = 0").count() == 0
    # a rerun keeps the first time and adds nothing
    again = ingest.reconcile(spark, layout, F.lit("2025-01-01").cast("timestamp"))
    assert again.where("year(reconciled_timestamp) <> 2024").count() == 0
    assert spark.read.parquet(layout.reconciled + "/run=1").count() == 0


def test_dlq_archive_stream(spark, folder):
    rows = spark.createDataFrame([("dlq", str(i), f"m{i}") for i in range(3)], kafka.MESSAGE_SCHEMA)
    kafka.file_topic_write(rows.coalesce(1), folder + "/t")
    ingest.dlq_archive(kafka.file_topic_stream(spark, folder + "/t"), folder + "/out", folder + "/cp", per_file=1).awaitTermination()
    assert spark.read.parquet(folder + "/out").count() == 3


def test_offsets_give_message_counts(spark):
    rows = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in range(5, 9)], "topic string, partition int, offset bigint")
    assert kafka.messages_by_offset(rows).first().messages == 8


def test_bookmarks(spark):
    files = spark.createDataFrame([("f-2024-01-01.csv",), ("f-2024-02-01.csv",)], "file string")
    assert versions.bookmark_next_files(files, "f-2024-01-01.csv").count() == 1
    assert versions.next_bookmark(files, "f-2024-01-01.csv").first().bookmark == "f-2024-02-01.csv"
    assert versions.next_bookmark(files.limit(0), "f-2024-01-01.csv").first().bookmark == "f-2024-01-01.csv"


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == scratch_root(spark)


def test_the_tasks_that_write_the_topic_follow_its_size(spark, folder, monkeypatch):
    monkeypatch.setattr(io, "TOPIC_TASK_BYTES", 20_000, raising=False)
    monkeypatch.setattr(io, "scratch_path", lambda spark, name: f"{folder}/{name}")
    e = spark.range(900).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    e.coalesce(1).write.parquet(folder + "/events.parquet")
    stream = io._message_stream(spark, folder)
    rows = spark.read.parquet(folder + "/topic").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 900 and max(r["count"] for r in rows) < 150  # 270 with one task a part
    job = stream.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    job.awaitTermination()
    assert len(glob.glob(folder + "/cp/commits/[0-9]*")) <= 3  # the batches stay a few
    back = spark.read.schema("sequence bigint, topic string, value string").parquet(folder + "/out")
    assert [tuple(r) for r in back.groupBy("topic").agg(F.count("*"), F.countDistinct("sequence")).orderBy("topic").collect()] == [("db.events.a", 810, 810), ("db.events.b", 90, 90)]
