"""What is kept between runs: bucketed state, open rows, kept manifests, bookmarks."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallystone.operators import manifest as m
from tallystone.operators import reports
from tallystone.plans import bindings as b
from tallystone.plans import recon
from tallystone.sources import readers, sinks
from tallystone.streaming import incremental, ingest
from tallystone.streaming import state as st

ROWS = "k string, version bigint, sequence bigint, body string"


@pytest.fixture
def state(folder):
    return st.State(folder + "/state", ROWS, ("k",), ("version", "sequence"), 8)


def files(state):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(state.rows + "/bucket=*/batch_id=*/*.parquet")}


def got(spark, state):
    return sorted(tuple(r) for r in st.current(spark, state).collect())


def records_read(spark):
    """Rows that all tasks so far have read from files."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def test_a_batch_rewrites_its_buckets_only(spark, state):
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    assert got(spark, state) == []
    first = [(f"k{i}", 1, i, "one") for i in range(100)] + [("k5", 3, 1, "newest"), ("k5", 2, 900, "older")]
    assert len(st.merge(spark, state, make(first), 0)) == 8
    before = files(state)
    touched = st.merge(spark, state, make([("k5", 2, 1, "late"), ("k7", 2, 7, "two")]), 1)
    assert 1 <= len(touched) <= 2
    after = files(state)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing old is rewritten
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after if f not in before} == set(touched)
    want = {f"k{i}": (f"k{i}", 1, i, "one") for i in range(100)} | {"k5": ("k5", 3, 1, "newest"), "k7": ("k7", 2, 7, "two")}
    assert got(spark, state) == sorted(want.values())
    # the same batch again, as after a lost driver: same state, also when the first run noted nothing
    st.merge(spark, state, make([("k5", 2, 1, "late"), ("k7", 2, 7, "two")]), 1)
    assert got(spark, state) == sorted(want.values())
    assert st.merge(spark, state, make([]), 2) == [] and got(spark, state) == sorted(want.values())
    st.merge(spark, state, make([(None, 1, 1, None), (None, 2, 1, "null key")]), 3)
    assert got_nulls(spark, state) == {"null key"} and st.current(spark, state).count() == 101
    gone = st.expire(spark, state, keep=1)
    assert gone >= 1 and st.current(spark, state).count() == 101 and st.expire(spark, state, keep=1) == 0


def got_nulls(spark, state):
    return {r.body for r in st.current(spark, state).where("k is null").collect()}


def test_an_unfinished_batch_is_not_seen(spark, state):
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    st.merge(spark, state, make([("a", 1, 1, "one")]), 0)
    st.merge(spark, state, make([("a", 2, 1, "two")]), 1)
    os.remove(state.written + "/batch_id=1/_SUCCESS")  # as if the driver was lost before the list was written
    assert got(spark, state) == [("a", 1, 1, "one")]
    st.merge(spark, state, make([("a", 2, 1, "two")]), 1)
    assert got(spark, state) == [("a", 2, 1, "two")]


def test_stream_of_several_batches(spark, sf_dir, folder):
    from test_io_and_streams import _stream

    from tallystone.plans import cdc

    state = ingest.newest_state(folder + "/state", 4)
    st.upsert_stream(_stream(spark, sf_dir, folder + "/topic"), state, folder + "/cp", ingest.accepted_records).awaitTermination()
    assert len(glob.glob(state.written + "/batch_id=*")) >= 3
    key = lambda df: sorted((r.topic, r.id, r.version) for r in df.select("topic", "id", "version").collect())
    assert key(st.current(spark, state)) == key(cdc.store(spark, sf_dir))


def test_reconcile_reads_open_rows_and_their_buckets(spark, sf_dir, folder):
    layout = ingest.Layout(folder + "/job")
    whole = b.envelopes(spark, sf_dir).select(F.col("event_id").alias("sequence"), "topic", "value")
    part = lambda *rest: whole.where((F.col("sequence") % 10).isin(*rest))
    at = lambda day: F.lit(day).cast("timestamp")
    result = lambda df: sorted((r.hbase_id, r.hbase_timestamp, r.topic_name, r.reconciled_result, str(r.reconciled_timestamp)[:10]) for r in df.collect())
    ingest.write_batch(layout)(part(0, 1, 2, 3, 4, 5, 6, 7), 0)
    # metadata whose version never reaches the store, and a row that the store gets later
    never = spark.createDataFrame([("nobody", 5, "db.none.such", 0, None), ("later", 7, "db.late.one", 0, None), ("old", 9, "db.old.one", 0, None)][:2], ingest.METADATA_SCHEMA)
    never.write.mode("append").parquet(layout.metadata + "/batch_id=0")
    before = records_read(spark)
    one = result(ingest.reconcile(spark, layout, at("2024-01-01")))
    first = records_read(spark) - before
    assert [r[:2] for r in one if r[3] == 0] == [("later", 7), ("nobody", 5)]
    before = records_read(spark)
    assert result(ingest.reconcile(spark, layout, at("2024-01-02"))) == one
    shown = len(one)  # the result itself is read by who asks for it
    assert records_read(spark) - before - shown < first / 10
    ingest.write_batch(layout)(part(8), 1)
    late = spark.read.schema(ingest.RECORD_SCHEMA + ", bucket int").parquet(layout.store + "/batch_id=0").limit(1).drop("bucket")
    late = late.withColumns({"topic": F.lit("db.late.one"), "id": F.lit("la ter"), "version": F.lit(7).cast("bigint")})
    bucket = ingest._store_bucket(F.col("topic"), ingest._store_id(F.col("id")))
    late.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(layout.store + "/batch_id=1")
    # new metadata of a version that an older batch holds
    held = spark.read.schema(ingest.METADATA_SCHEMA).parquet(layout.metadata + "/batch_id=0").where("hbase_id not in ('nobody', 'later')").limit(1)
    held.write.mode("append").parquet(layout.metadata + "/batch_id=1")
    before = records_read(spark)
    two = result(ingest.reconcile(spark, layout, at("2024-01-03")))
    assert records_read(spark) - before - len(two) < first
    assert [r[:2] for r in two if r[3] == 0] == [("nobody", 5)]
    assert {r[4] for r in two if r[:2] == ("later", 7)} == {"2024-01-03"}
    assert len([r for r in two if r[4] == "2024-01-01"]) == len([r for r in one if r[3] == 1])
    again = held.first()
    assert sorted(r[4] for r in two if r[:3] == tuple(again)[:3]) == ["2024-01-01", "2024-01-03"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_manifests_are_not_shuffled_again(spark, sf_dir, folder):
    imports, exports = recon.sides(spark, sf_dir)
    odd = spark.createDataFrame([(None, 5, None, None, "HDI"), ("x", 6, None, "c", None)], "id string, timestamp bigint, database string, collection string, component string")
    odd = odd.select(*[odd[c] if c in odd.columns else F.lit(None).cast("string").alias(c) for c in imports.columns])
    imports, exports = imports.unionByName(odd), exports.unionByName(odd)
    kept = [m.keep_manifest(df, name, f"{folder}/{name}", 4) for df, name in ((imports, "kept_i"), (exports, "kept_e"))]
    try:
        want = sorted(map(str, m.match_manifests(imports, exports).collect()))
        again = m.match_kept(*kept)
        assert sorted(map(str, again.collect())) == want and "Exchange" not in plan(again)
        fresh = m.match_kept(kept[0], m.newest_lines(exports, 4))
        assert plan(fresh).count("Exchange") == 1  # the fresh side's own
        assert sorted(map(str, fresh.collect())) == want
    finally:
        for name in ("kept_i", "kept_e"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_type_totals_leave_nothing_record_sized(spark, sf_dir):
    counts = recon.type_counts(spark, sf_dir)
    text = plan(reports.type_totals(counts))
    # the match's own shuffle, then one row per collection and task, then one row
    assert text.count("Exchange hashpartitioning(database") == 2 and text.count("Exchange SinglePartition") == 1
    tables = recon.reconciled_tables(spark, sf_dir)
    want = sorted(map(tuple, reports.individual_type_totals(tables.missing_imports, tables.missing_exports).collect()))
    assert sorted(map(tuple, reports.type_totals(counts).collect())) == want == sorted(map(tuple, reports.type_totals_union(counts).collect()))
    none = m.match_for_types(*(df.limit(0) for df in recon.sides(spark, sf_dir)))
    assert {r.id_count for r in reports.type_totals(reports.collection_type_counts(none)).collect()} == {0}


def test_a_second_start_reads_new_files_only(spark, folder):
    make = lambda lo, hi: spark.range(lo, hi).write.mode("append").json(folder + "/source")
    start = lambda n: incremental.load_new_files(spark, folder + "/source", "id bigint", folder + "/target", folder + "/cp", n, 1)
    make(0, 50)
    one = start(1)
    one.awaitTermination()
    make(50, 60)
    two = start(2)
    two.awaitTermination()
    assert sum(p["numInputRows"] for p in two.recentProgress) == 10
    rows = incremental.loaded(spark, folder + "/target")
    assert rows.where("load = 1").count() == 50 and sorted(r.id for r in rows.where("load = 2").collect()) == list(range(50, 60))
    three = start(3)
    three.awaitTermination()
    assert rows.count() == 60 and sum(p["numInputRows"] for p in three.recentProgress) == 0


def test_report_documents_are_single_files(spark, sf_dir, folder):
    pack = reports.report_pack(recon.reconciled_tables(spark, sf_dir))
    lines = reports.report_json_lines(pack, "me", "now").persist()
    for _ in range(2):  # written twice, there once
        sinks.write_report_documents(lines, folder + "/docs")
    held = {f.split("query_type=")[1].split("/")[0]: open(f).read() for f in glob.glob(folder + "/docs/query_type=*/*.txt")}
    assert set(held) == set(reports.QUERY_TYPES) and len(glob.glob(folder + "/docs/query_type=*/*.txt")) == len(held)
    want = {}
    for r in lines.orderBy("query_type", "query_order", "position").collect():
        want[r.query_type] = want.get(r.query_type, "") + r.line + "\n"
    assert held == want
    for kind, text in held.items():
        document = json.loads(text)
        assert document["executed_by"] == "me"
        assert [r["query_details"]["order"] for r in document["query_results"]] == [r.order for r in reports.REPORTS if r.query_type == kind]


def test_only_folders_of_chosen_topics_are_read(spark, sf_dir):
    from tallystone.operators import routing
    from tallystone.plans import io

    lines = readers.scan_jsonl_partitioned(spark, io._daily_folder(spark, sf_dir))
    topics = spark.createDataFrame([("db.events.click",), ("db.events.click",), ("other.events.view",), (None,)], "topic string")
    chosen = routing.lines_of_topics(lines, topics)
    assert "dynamicpruning" in plan(chosen)
    before = records_read(spark)
    rows = chosen.select("coll", "value").collect()
    read, all_lines = records_read(spark) - before, lines.count()
    assert {r.coll for r in rows} == {"click"} and len(rows) == b.table(spark, sf_dir, "events").where("event_type = 'click'").count()
    assert read <= len(rows) + 10 < all_lines
    assert routing.lines_of_topics(lines, topics.limit(0)).count() == 0


def test_scratch_is_released(spark, monkeypatch):
    from tallystone import session

    monkeypatch.setattr(session, "_given", [])  # tables of other tests stay
    table = session.materialise(spark.range(5), "kept")
    place = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    session.scratch_path(spark, "never-written")
    assert table.count() == 5 and os.path.isdir(place)
    assert session.release_scratch(spark) == 1 and not os.path.exists(place) and session.release_scratch(spark) == 0
