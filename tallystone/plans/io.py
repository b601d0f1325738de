"""Source, sink, generator and streaming queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import envelope, routing
from tallystone.operators import manifest as m
from tallystone.plans import bindings as b
from tallystone.plans import cdc
from tallystone.plans.recon import BASE_SQL, reconciled_tables, sides
from tallystone.plans.registry import query
from tallystone.session import materialise, scratch_path
from tallystone.sources import generate, kafka, readers, sinks, tables
from tallystone.streaming import ingest
from tallystone.streaming.state import current, upsert_stream



@query(
    "scan_manifest_csv",
    BASE_SQL
    + """select case when source = 'export' and k % 13 = 0 then '{""$oid"": ""' || id || '""}' else id end as id,
           timestamp, database, collection, source, component, original_id, type from (
           select k, id, ts as timestamp, database, collection, source, component, id as original_id, type from imp
           union all select k, id, ts, database, collection, source, component, id, type from exp)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "manifest-csv")
    imports, exports = sides(spark, sf_dir)
    sinks.write_manifest_csv(imports, f"{path}/import")
    sinks.write_manifest_csv(exports, f"{path}/export")
    return readers.scan_manifest_csv(spark, f"{path}/*")


_EXTERNAL = {
    "counts": "imported_count",
    "missing_imports": "export_timestamp",
    "missing_exports": "import_timestamp",
    "mismatched": "latest_timestamp",
}


@query(
    "external_table_parquet",
    BASE_SQL
    + " union all ".join(
        f"select '{kind}' as table_name, database, count(*) as rows, cast(sum({number}) as bigint) as total from {kind} group by database"
        for kind, number in _EXTERNAL.items()
    ),
)
def _(spark, sf_dir):
    t = reconciled_tables(spark, sf_dir)
    parts = []
    for kind, number in _EXTERNAL.items():
        location = scratch_path(spark, kind)
        name = tables.qualified_table_name("default", f"manifest_{kind}_" + location.rsplit("-", 1)[1], "historic", "full")
        held = tables.write_table(getattr(t, kind), name, kind, location)
        parts.append(
            held.groupBy("database").agg(F.count("*").alias("rows"), F.sum(number).alias("total"))
            .select(F.lit(kind).alias("table_name"), "database", "rows", "total")
        )
        spark.sql(f"DROP TABLE {name}")  # external: only the entry goes, the files stay for the read
    return functools.reduce(DataFrame.unionByName, parts)


def _daily_lines(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("date").alias("day"), F.lit("events").alias("database"),
        F.col("event_type").alias("collection"), F.to_json(F.struct("event_id", "user_id")).alias("value"),
    )


def _daily_folder(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl_partitioned(_daily_lines(spark, sf_dir), path)
    return path


DAILY_COLS = "event_id, user_id, 'events' as db, event_type as coll, cast(ts as date) as day"


def _daily_rows(lines):
    fields = F.from_json("value", "event_id bigint, user_id bigint").alias("r")
    return lines.select(fields, "db", "coll", "day").select("r.*", "db", "coll", "day")


@query("scan_jsonl_gz_partitioned", f"select {DAILY_COLS} from events")
def _(spark, sf_dir):
    return _daily_rows(readers.scan_jsonl_partitioned(spark, _daily_folder(spark, sf_dir)))


@query(
    "scan_date_range_pruned",
    f"select {DAILY_COLS} from events where cast(ts as date) between date '2024-01-10' and date '2024-01-19'",
)
def _(spark, sf_dir):
    lines = readers.scan_jsonl_partitioned(spark, _daily_folder(spark, sf_dir))
    return _daily_rows(readers.prune_ymd(lines, "2024-01-10", "2024-01-19"))


@query(
    "scan_chosen_topics",
    f"""select {DAILY_COLS} from events
        where event_type in (select event_type from events where event_id % 5 = 1 and event_type < 'l')""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").where("event_id % 5 = 1 and event_type < 'l'")
    wanted = F.array(F.lit(None).cast("string"), F.concat(F.lit("db.events."), "event_type"))
    requests = e.select(F.col("event_id").alias("request_id"), wanted.alias("overrides"), F.lit("full").alias("snapshot_type"), F.array(F.lit("none")).alias("fallback"))
    chosen = routing.topic_selection(requests, "f", "i", "d")
    return _daily_rows(routing.lines_of_topics(readers.scan_jsonl_partitioned(spark, _daily_folder(spark, sf_dir)), chosen))


@query(
    "scan_corrupt_gzip",
    "select event_type as coll, count(*) as lines, true as damage_fails from events group by 1",
)
def _(spark, sf_dir):
    # the same folder with one archive that breaks off: a strict read of it must raise, not lose lines
    path = _daily_folder(spark, sf_dir)
    broken = f"{path}/y=1999/m=01/d=01/db=events/coll=broken"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{broken}/part-0.txt.gz")
    lines = readers.scan_jsonl_partitioned(spark, path).groupBy("coll").agg(F.count("*").alias("lines"))
    good = materialise(lines, "lines")
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path)
    out.write(bytearray(b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03cut off"))
    out.close()
    try:
        readers.scan_jsonl_partitioned(spark, path).write.format("noop").mode("overwrite").save()
        fails = False
    except Exception as problem:  # noqa: BLE001
        fails = "EOF" in str(problem) or "gzip" in str(problem).lower() or "FAILED_READ_FILE" in str(problem)
    return good.select("coll", "lines", F.lit(fails).alias("damage_fails"))


@query(
    "scan_json_array",
    """select event_id, cast(i as integer) as response, 'j-' || i as journal_entry_id from events,
       (select unnest([1, 2, 3]) as i)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    e = b.table(spark, sf_dir, "events")
    entry = lambda i: F.struct("event_id", F.concat(F.lit("j-"), i.cast("string")).alias("journal_entry_id"), i.alias("response"))
    entries = e.select(F.floor(F.col("event_id") / 500).alias("file"), F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), entry)).alias("entry"))
    # one file per 500 events, each holding one array
    arrays = entries.groupBy("file").agg(F.to_json(F.collect_list("entry")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return readers.scan_json_array(spark, path, "event_id bigint, journal_entry_id string, response int").select("event_id", "response", "journal_entry_id")


@query(
    "explode_json_array",
    """select event_id, cast(i as integer) as response, 'j-' || i as journal_entry_id from events,
       (select unnest([1, 2, 3]) as i)""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    entry = lambda i: F.struct(F.concat(F.lit("j-"), i.cast("string")).alias("journal_entry_id"), i.alias("response"))
    arrays = e.select(
        "event_id", F.to_json(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), entry)).alias("doc")
    )
    out = readers.explode_json_array(arrays, "doc", "struct<journal_entry_id: string, response: int>")
    return out.select("event_id", "element.response", "element.journal_entry_id")


@query(
    "scan_orc_external",
    "select props as val, event_type as id_part, event_id from events",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "orc")
    schema = "val string, event_id bigint, id_part string"
    sinks.empty_orc(spark, "val string, event_id bigint", f"{path}/initial")
    e = b.table(spark, sf_dir, "events")
    rows = e.select(F.col("props").alias("val"), "event_id", F.col("event_type").alias("id_part"))
    sinks.write_orc(rows, f"{path}/table", "id_part")
    start = readers.scan_orc(spark, f"{path}/initial", "val string, event_id bigint")
    return readers.scan_orc(spark, f"{path}/table", schema).unionByName(
        start.withColumn("id_part", F.lit(None).cast("string"))
    )


@query(
    "scan_partition_day",
    "select event_id, user_id, '2024-01-15' as date_str from events where cast(ts as date) = date '2024-01-15'",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "audit")
    e = b.table(spark, sf_dir, "events")
    e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date_str")).write.partitionBy(
        "date_str"
    ).parquet(path)
    table = spark.read.schema("event_id bigint, user_id bigint, date_str string").parquet(path)
    return readers.scan_partition_day(table, "2024-01-15")


def _listing(spark, sf_dir, pattern=None):
    return readers.file_listing(spark, _daily_folder(spark, sf_dir), pattern)


@query(
    "list_files_matching",
    "select event_type as coll, count(distinct cast(ts as date)) as folders from events group by 1",
)
def _(spark, sf_dir):
    files = _listing(spark, sf_dir, r".*/coll=[a-z]+/part-.*\.txt\.gz")
    folder = F.substring_index(F.col("path"), "/part-", 1)
    coll = F.regexp_extract("path", "/coll=([a-z]+)/", 1)
    return files.groupBy(coll.alias("coll")).agg(F.count_distinct(folder).alias("folders"))


@query(
    "prefix_size_and_count",
    "select event_type as coll, cast(sum(strlen(props) + 1) as bigint) as total_bytes, true as exists from events group by 1",
)
def _(spark, sf_dir):
    # plain text lines, so the bytes under each prefix are those of the rows
    path = scratch_path(spark, "sizes")
    e = b.table(spark, sf_dir, "events")
    e.select("props", F.col("event_type").alias("coll")).write.partitionBy("coll").option("compression", "none").text(path)
    coll = F.regexp_extract("path", "/coll=([^/]+)/", 1)
    return readers.prefix_sizes(readers.file_listing(spark, path), coll).select(F.col("prefix").alias("coll"), "total_bytes", "exists")


@query(
    "sink_snapshot",
    "select '2024-02-01' as export_date, 'full' as snapshot_type, 'events' as database, event_type as collection, count(*) as records from events group by event_type",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    recs = _daily_lines(spark, sf_dir).drop("day")
    dated = recs.select(F.lit("2024-02-01").alias("export_date"), F.lit("full").alias("snapshot_type"), "*")
    sinks.write_snapshot(dated, path)
    schema = "value string, export_date string, snapshot_type string, database string, collection string"
    back = spark.read.schema(schema).text(path)
    return back.groupBy("export_date", "snapshot_type", "database", "collection").agg(F.count("*").alias("records"))


@query(
    "sink_dlq_parquet",
    cdc.MSG_SQL + "select reason, count(*) as messages from read where reason is not null group by reason",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "dlq")
    sinks.write_dlq(envelope.dead_letters(cdc.read(spark, sf_dir)), path)
    back = spark.read.schema("body string, reason string, key string").parquet(path)
    return back.groupBy("reason").agg(F.count("*").alias("messages"))


TEMPLATE = '{"message":{"_id":{"e2eId":"||newid||"},"_lastModifiedDateTime":"||timestamp||"}}'


@query(
    "generate_records",
    """with r as (select 'db.e2e.c' || c_custkey as topic, c_custkey % 3 + 1 as files, c_custkey % 5 + 1 as records from customer),
       n as (select topic, files, records, files * records as n from r),
       m as (select unnest(['single', 'different', 'file', 'record', 'topic']) as method)
       select topic, method, n as messages,
         case method when 'single' then 1 when 'topic' then 1 when 'different' then n when 'file' then files else records end as keys,
         '2018-11-01T03:02:01.' || lpad(cast(1 + records + files - 1 as varchar), 3, '0') || '+0000' as newest
       from n, m""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    requests = b.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("db.e2e.c"), k).alias("topic"),
        (k % 3 + 1).cast("int").alias("files"),
        (k % 5 + 1).cast("int").alias("records"),
    )
    base = F.lit("2018-11-01 03:02:01.001").cast("timestamp")
    parts = []
    for method in ("single", "different", "file", "record", "topic"):
        made = generate.generate_records(requests, TEMPLATE, method, base)
        made_id = F.get_json_object("value", "$.message._id.e2eId")
        made_at = F.get_json_object("value", "$.message._lastModifiedDateTime")
        parts.append(
            made.groupBy("topic").agg(
                F.count("*").alias("messages"), F.count_distinct(made_id).alias("keys"), F.max(made_at).alias("newest")
            ).withColumn("method", F.lit(method))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "generate_table_from_schema",
    "select count(*) as rows, true as ints_in_range, true as texts_well_formed, true as about_half_null from part",
)
def _(spark, sf_dir):
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"))
    made = generate.generate_table(rows, {"a": "string", "b": "int"}, seed=42)
    return made.agg(
        F.count("*").alias("rows"),
        F.bool_and(F.col("b").between(0, 100)).alias("ints_in_range"),
        F.bool_and(F.col("a").isNull() | F.col("a").rlike("^[A-Za-z]{8}$")).alias("texts_well_formed"),
        F.avg(F.col("a").isNull().cast("double")).between(0.3, 0.7).alias("about_half_null"),
    )


@query(
    "generate_claimants",
    """with s as (select c_custkey, unnest(range(greatest(c_custkey % 3, 1))) from customer),
       p as (select *, unnest([0, 1]) as i from s)
       select 'contract' as kind, case when c_custkey % 2 = 0 then 2 else 1 end as people,
         case when c_custkey % 5 = 0 then 20240329 end as closed, case when c_custkey % 7 = 0 then 20240330 end as suspended,
         cast(null as varchar) as pay, cast(null as integer) as starts, cast(null as integer) as ends, count(*) as documents from s group by all
       union all select 'claimant', null, null, null, null, null, null, cast(sum(case when c_custkey % 2 = 0 then 2 else 1 end) as bigint) from s
       union all select 'statement', null, null, null, case i when 0 then '601.88' else '433.32' end,
         case i when 0 then 20231228 else 20240128 end, case i when 0 then 20240127 else 20240227 end, count(*) from p group by all""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    period = lambda a, z, pay: F.struct(
        F.lit(-3).alias("start_days"), F.lit(a).alias("start_months"), F.lit(-4).alias("end_days"),
        F.lit(z).alias("end_months"), F.lit(pay).alias("amount"),
    )
    scenarios = b.table(spark, sf_dir, "customer").select(
        k.alias("scenario_id"), (k % 3).cast("int").alias("count"), (k % 2 == 0).alias("partner"),
        F.when(k % 5 == 0, -2).alias("closed_days"), F.when(k % 7 == 0, -1).alias("suspended_days"),
        F.array(period(-3, -2, "601.88"), period(-2, -1, "433.32")).alias("assessment_periods"),
    )
    made = generate.generate_claimants(scenarios, F.lit("2024-03-31").cast("date"))
    none = F.lit(None).cast("int")
    count = F.count("*").alias("documents")
    contracts = made["contracts"].groupBy(
        F.size("people").alias("people"), F.col("closedDate").alias("closed"), F.col("claimSuspension.suspensionDate").alias("suspended")
    ).agg(count).select(F.lit("contract").alias("kind"), "*", F.lit(None).cast("string").alias("pay"), none.alias("starts"), none.alias("ends"))
    people = made["claimants"].agg(count).select(F.lit("claimant").alias("kind"), "documents")
    # a period's dates: days first, months second
    paid = made["statements"].groupBy(
        F.col("takeHomePay").alias("pay"), F.col("assessmentPeriod.startDate").alias("starts"), F.col("assessmentPeriod.endDate").alias("ends")
    ).agg(count).select(F.lit("statement").alias("kind"), "*")
    return contracts.unionByName(people, allowMissingColumns=True).unionByName(paid, allowMissingColumns=True)


# --- streaming ------------------------------------------------------------


TOPIC_TASK_BYTES = 64 << 20  # message text that one task writes, so what it sorts by topic stays bounded


def _message_stream(spark, sf_dir):
    """The event messages as a file-backed topic, newest first, read as a stream of several batches."""
    path = scratch_path(spark, "topic")
    messages = b.envelopes(spark, sf_dir).select("topic", F.col("event_id").cast("string").alias("key"), "value")
    # a file per topic, part and task; tasks follow the size, and batches hold as many times more files, so they stay a few
    size = messages.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    tasks = 1 + size // (3 * TOPIC_TASK_BYTES)
    for part in (2, 1, 0):
        some = messages.where(F.pmod(F.col("key").cast("long"), F.lit(3)) == part)
        kafka.file_topic_write(some.repartition(tasks, "key", "value"), path)
    stream = kafka.file_topic_stream(spark, path, 6 * tasks)
    return stream.select(F.col("key").cast("bigint").alias("sequence"), "topic", "value")


def _ingested(spark, sf_dir):
    layout = ingest.Layout(scratch_path(spark, "ingest"))
    job = ingest.ingest_stream(_message_stream(spark, sf_dir), layout)
    job.awaitTermination()
    return layout


@query(
    "stream_latest_upsert",
    cdc.MSG_SQL + "select topic, id, version, event_id as sequence, record_type, body from latest",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "state")
    state = ingest.newest_state(f"{root}/state", buckets=16)
    upsert_stream(_message_stream(spark, sf_dir), state, f"{root}/checkpoint", ingest.accepted_records).awaitTermination()
    return current(spark, state).select("topic", "id", "version", "sequence", "record_type", "body")


@query(
    "stream_log_compaction",
    cdc.MSG_SQL + "select topic, id, version, event_id as sequence, record_type, body from latest",
)
def _(spark, sf_dir):
    layout = _ingested(spark, sf_dir)
    ingest.compact(spark, layout)
    state = ingest.current_state(spark, layout)
    return state.select("topic", "id", "version", "sequence", "record_type", "body")


@query(
    "stream_manifest_and_metadata",
    cdc.MSG_SQL
    + """select 'manifest' as kind, '"' || id || '"|' || version || '|' || database || '|' || collection
           || '|STREAMED|K2HB|"' || id || '"|KAFKA_RECORD' as line from accepted
         union all select 'metadata', id || '|' || version || '|' || topic || '|1' from accepted""",
)
def _(spark, sf_dir):
    layout = _ingested(spark, sf_dir)
    lines = spark.read.schema("value string").parquet(layout.manifest)
    meta = ingest.reconcile(spark, layout, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    noted = F.concat_ws("|", "hbase_id", "hbase_timestamp", "topic_name", "reconciled_result")
    return lines.select(F.lit("manifest").alias("kind"), F.col("value").alias("line")).unionByName(
        meta.select(F.lit("metadata").alias("kind"), noted.alias("line"))
    )


@query(
    "stream_family_rules",
    """with t as (select event_id, case event_id % 4 when 0 then 'data.equality' when 1 then 'data.businessAudit'
              when 2 then 'db.core.' || event_type else 'core.' || event_type || '|x' end as topic from events)
       select event_id, case event_id % 4 when 0 then 'equalities' when 1 then 'audit' else 'main' end as family,
         case event_id % 4 when 3 then 'db.' || split_part(topic, '|', 1) else topic end as qualified_topic,
         event_id % 4 >= 2 as needs_database from t""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    topic = (
        F.when(kind == 0, "data.equality").when(kind == 1, "data.businessAudit")
        .when(kind == 2, F.concat(F.lit("db.core."), "event_type"))
        .otherwise(F.concat(F.lit("core."), F.col("event_type"), F.lit("|x")))
    )
    ruled = ingest.family_rules(e.select("event_id", topic.alias("topic")))
    return ruled.select("event_id", "family", "qualified_topic", "needs_database")


@query(
    "stream_dlq_archive",
    cdc.MSG_SQL + "select topic, reason, count(*) as messages from read where reason is not null group by 1, 2",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "dead-letters")
    dead = envelope.dead_letters(envelope.read_messages(_message_stream(spark, sf_dir)), extra=("sequence", "topic"))
    ingest.dlq_archive(dead, f"{root}/archive", f"{root}/checkpoint").awaitTermination()
    back = spark.read.schema("sequence bigint, topic string, body string, reason string, key string").parquet(f"{root}/archive")
    return back.groupBy("topic", "reason").agg(F.count("*").alias("messages"))


@query(
    "kafka_source_sink",
    "select 'db.events.' || event_type as topic, count(*) as messages from events group by 1",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "published")
    job = (
        _message_stream(spark, sf_dir)
        .writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", scratch_path(spark, "published-checkpoint"))
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    received = spark.read.schema("sequence bigint, topic string, value string").parquet(path)
    return received.groupBy("topic").agg(F.count("*").alias("messages"))
