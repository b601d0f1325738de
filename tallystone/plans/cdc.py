"""Change-data queries: validation, versions, metadata and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import ids, payload
from tallystone.operators import checks, compare, envelope, versions
from tallystone.plans import bindings as b
from tallystone.plans.registry import ORACLES, query
from tallystone.session import scratch_path
from tallystone.sources import sinks
from tallystone.streaming import incremental

KEYS = ["topic", "id"]
ORDER = ["version", "event_id"]
RECONCILED_AT = "2024-02-01 00:00:00"
LOAD_SPLIT_MS = 1705276800000

MSG_SQL = """
with msgs as (
  select event_id, 'db.events.' || event_type as topic,
    '{"traceId":"trace-' || event_id || '","unitOfWorkId":"unit-' || user_id || '","@type":"V4","version":"core-1","timestamp":"' || stamp
    || '","message":{"@type":"' || case when event_id % 9 = 0 then 'MONGO_DELETE' else 'MONGO_UPDATE' end || '"'
    || case when d <> 2 then ',"collection":"' || event_type || '"' else '' end
    || case when d <> 1 then ',"db":"events"' else '' end
    || ',"_id":{"userId": "' || user_id || '"}'
    || case when d not in (5, 6) then ',"_lastModifiedDateTime":"' || stamp || '"' else '' end
    || case when d <> 6 then ',"createdDateTime":"2015-03-20T12:23:25.183+0000"' else '' end
    || ',"encryption":{"encryptionKeyId":"key-1"'
    || case when d = 8 then '' else ',"encryptedEncryptionKey":"' || case d when 9 then '' when 10 then 'foobar' else '%(key)s' end || '"' end
    || '}'
    || case when d = 3 then '' when d = 7 then ',"dbObject":' || props else ',"dbObject":"' || to_base64(encode(props)) || '"' end
    || '}}' || case when d = 4 then '}' else '' end as value
  from (select *, event_id %% 50 as d, strftime(ts, '%%Y-%%m-%%dT%%H:%%M:%%S.%%g') || '+0000' as stamp from events)),
parsed as (select *, try_cast(value as json) as j from msgs),
read as (
  select *, case when j is null then 'Invalid'
    when json_extract_string(j, '$.message.db') is null then 'missing database'
    when json_extract_string(j, '$.message.collection') is null then 'missing collection'
    when coalesce(json_type(j, '$.message.dbObject'), 'NULL') = 'NULL' then 'missing dbObject'
    when json_type(j, '$.message.dbObject') <> 'VARCHAR' then 'unencrypted dbObject' end as reason
  from parsed),
accepted as (
  select event_id, topic, cast(json_extract(j, '$.message._id') as varchar) as id,
    epoch_us(strptime(replace(coalesce(json_extract_string(j, '$.message._lastModifiedDateTime'),
      json_extract_string(j, '$.message.createdDateTime'), '1980-01-01T00:00:00.000+0000'), '+0000', ''),
      '%%Y-%%m-%%dT%%H:%%M:%%S.%%g')) // 1000 as version,
    json_extract_string(j, '$.message."@type"') as record_type,
    json_extract_string(j, '$.message.db') as database, json_extract_string(j, '$.message.collection') as collection,
    case when json_extract_string(j, '$.message._lastModifiedDateTime') is not null then '_lastModifiedDateTime'
         when json_extract_string(j, '$.message.createdDateTime') is not null then 'createdDateTime' else 'epoch' end as timestamp_created_from,
    json_extract_string(j, '$.message.dbObject') as body
  from read where reason is null),
latest as (
  select * exclude rn from (
    select *, row_number() over (partition by topic, id order by version desc, event_id desc) rn from accepted) where rn = 1)
""".replace("%(key)s", b.ENCRYPTED_KEY).replace("%%", "%")

ACCEPTED_COLS = "event_id, topic, id, version, record_type, database, collection, timestamp_created_from, body"


def read(spark, sf_dir):
    return envelope.read_messages(b.envelopes(spark, sf_dir))


def records(spark, sf_dir):
    return envelope.accepted(read(spark, sf_dir), extra=("event_id",))


def store(spark, sf_dir):
    return versions.latest_version_per_id(records(spark, sf_dir), KEYS, ORDER)


@query(
    "stream_validate_split",
    MSG_SQL
    + """select event_id, topic, coalesce(reason, 'accepted') as outcome,
         json_extract_string(j, '$.message._id.userId') as key from read""",
)
def _(spark, sf_dir):
    r = read(spark, sf_dir)
    key = F.get_json_object(F.col("envelope")["message"]["_id"], "$.userId")
    return r.select("event_id", "topic", F.coalesce("reason", F.lit("accepted")).alias("outcome"), key.alias("key"))


@query(
    "latest_version_per_id",
    MSG_SQL + f"select {ACCEPTED_COLS} from latest",
)
def _(spark, sf_dir):
    return store(spark, sf_dir)


@query(
    "delete_propagation",
    MSG_SQL + "select topic, id, version, record_type from latest where record_type <> 'MONGO_DELETE'",
)
def _(spark, sf_dir):
    kept = versions.without_deleted(store(spark, sf_dir))
    return kept.select("topic", "id", "version", "record_type")


@query(
    "record_timestamp",
    MSG_SQL + "select event_id, version, timestamp_created_from from accepted",
)
def _(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", "version", "timestamp_created_from")


@query(
    "skip_earlier_later",
    MSG_SQL
    + f"select event_id, version from accepted where version >= {LOAD_SPLIT_MS} and version <= {LOAD_SPLIT_MS} + 86400000",
)
def _(spark, sf_dir):
    kept = versions.skip_window(
        records(spark, sf_dir), "version", F.lit(LOAD_SPLIT_MS), F.lit(LOAD_SPLIT_MS + 86_400_000)
    )
    return kept.select("event_id", "version")


@query(
    "export_time_window",
    MSG_SQL
    + f"""select topic, id, version from latest
          where version between {LOAD_SPLIT_MS} and {LOAD_SPLIT_MS} + 1209600000""",
)
def _(spark, sf_dir):
    kept = versions.time_window(store(spark, sf_dir), "version", LOAD_SPLIT_MS, LOAD_SPLIT_MS + 1_209_600_000)
    return kept.select("topic", "id", "version")


SKIP_SQL = MSG_SQL + f"""
select topic, id, version, event_id, mode from (
  select *, 'skip' as mode, row_number() over (partition by topic, id
     order by case when version < {LOAD_SPLIT_MS} then 1 else 0 end desc, version desc, event_id desc) rn from accepted
  union all
  select *, 'upsert' as mode, row_number() over (partition by topic, id order by version desc, event_id desc) rn from accepted)
where rn = 1"""


@query("skip_existing_load", SKIP_SQL)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    before = versions.latest_version_per_id(rows.where(F.col("version") < LOAD_SPLIT_MS), KEYS, ORDER)
    new = rows.where(F.col("version") >= LOAD_SPLIT_MS)
    load = lambda skip, name: versions.skip_existing_load(new, before, KEYS, ORDER, skip).withColumn("mode", F.lit(name))
    return load(True, "skip").unionByName(load(False, "upsert"))


# --- metadata, manifests and lookups --------------------------------------


@query(
    "sink_manifest_line",
    MSG_SQL
    + """select event_id, '"' || id || '"|' || version || '|' || database || '|' || collection
         || '|STREAMED|K2HB|"' || id || '"|KAFKA_RECORD' as line from accepted""",
)
def _(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select(
        "event_id", sinks.manifest_line(F.col("id"), F.col("version"), F.col("topic")).alias("line")
    )


def metadata(spark, sf_dir):
    return envelope.metadata_rows(records(spark, sf_dir))


@query(
    "metadata_lookup",
    MSG_SQL
    + """select id as hbase_id, version as hbase_timestamp, topic as topic_name from accepted
         where topic = 'db.events.click' and contains(id, '"userId":"1')""",
)
def _(spark, sf_dir):
    found = compare.metadata_lookup(metadata(spark, sf_dir), '"userId":"1', "db.events.click")
    return found.select("hbase_id", "hbase_timestamp", "topic_name")


@query(
    "metadata_reconcile",
    MSG_SQL
    + f"""select a.id as hbase_id, a.version as hbase_timestamp, a.topic as topic_name,
          case when l.id is not null then 1 else 0 end as reconciled_result,
          case when l.id is not null then timestamp '{RECONCILED_AT}' end as reconciled_timestamp
          from accepted a left join latest l on a.topic = l.topic and a.id = l.id and a.version = l.version""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir)
    newest = versions.latest_version_per_id(rows.select("topic", "id", "version", "event_id"), KEYS, ORDER)
    return compare.metadata_reconcile(
        envelope.metadata_rows(rows), newest, F.lit(RECONCILED_AT).cast("timestamp")
    )


@query(
    "dlq_not_in_store",
    MSG_SQL
    + """select topic, event_id as sequence, reason from read where reason is not null and event_id % 100 not in (4, 53)""",
)
def _(spark, sf_dir):
    r = read(spark, sf_dir)
    dead = envelope.dead_letters(r, extra=("event_id", "topic")).select(
        "topic", "key", F.col("event_id").alias("sequence"), "reason"
    )
    rows = envelope.accepted(r, extra=("event_id",))
    noted = rows.select(
        F.col("topic").alias("topic_name"), F.col("id").alias("hbase_id"), F.col("event_id").alias("sequence")
    )
    stored = rows.select("topic", "id", F.col("event_id").alias("sequence"))
    # some rejected messages are held all the same: broken ones, which have no key, in the store, others in the metadata
    wrong = lambda rest: dead.where(F.col("sequence") % 100 == rest).select("topic", "key", "sequence")
    stored = stored.union(wrong(4))
    noted = noted.union(wrong(53))
    return compare.dlq_not_in_store(dead, stored, noted).select("topic", "sequence", "reason")


@query(
    "store_lookup_compare",
    MSG_SQL
    + """, e as (select r.event_id, a.topic, a.id, a.version from read r join accepted a using (event_id))
         select e.event_id, true as found, (e.version = l.version) as passed
         from e join latest l on e.topic = l.topic and e.id = l.id""",
)
def _(spark, sf_dir):
    # the body is volatile and masked; the version is a stable field, so only
    # messages that are the stored version compare equal
    rows = records(spark, sf_dir)
    text = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("traceId"),
            F.struct(F.col("id").alias("_id"), F.col("version").alias("v"), F.col("body").alias("dbObject")).alias("message"),
        )
    )
    docs = rows.select("topic", "id", "version", "event_id", text.alias("value"))
    newest = versions.latest_version_per_id(docs, KEYS, ORDER).select("topic", "id", "value")
    return compare.store_lookup_compare(docs, newest).select("event_id", "found", "passed")


@query(
    "snapshot_containment",
    MSG_SQL
    + """select topic, id, count(*) as not_in_snapshot from (
           select topic, id, version from accepted
           except select topic, id, version from latest) group by topic, id""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    flipped = F.to_json(F.struct("version", "topic", "id"))
    straight = F.to_json(F.struct("topic", "id", "version"))
    newest = versions.latest_version_per_id(rows, KEYS, ORDER)
    absent = compare.snapshot_containment(
        rows.select(flipped.alias("value")), newest.select(straight.alias("value"))
    )
    fields = F.from_json("value", "topic string, id string, version bigint")
    return (
        absent.select(fields.alias("r"))
        .groupBy("r.topic", "r.id")
        .agg(F.count("*").alias("not_in_snapshot"))
    )


@query(
    "id_set_equality",
    MSG_SQL
    + """, l as (select distinct collection, id from accepted), r as (select distinct collection, id from latest where record_type <> 'MONGO_DELETE')
         select coalesce(l.collection, r.collection) as collection, count(l.id) as expected_ids, count(r.id) as actual_ids,
           count(*) filter (r.id is null) as missing_ids, count(*) filter (l.id is null) as unexpected_ids,
           (count(*) filter (r.id is null or l.id is null)) = 0 as equal
         from l full join r on l.collection = r.collection and l.id = r.id group by 1""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir)
    kept = versions.without_deleted(versions.latest_version_per_id(rows, KEYS, ORDER))
    return compare.id_set_equality(
        rows.select("collection", "id"), kept.select("collection", "id"), ["collection"]
    )


@query(
    "set_equal",
    MSG_SQL
    + """select (select count(*) from (select topic, id from accepted except select topic, id from latest)) as only_left,
           cast(0 as bigint) as only_right, true as equal""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    newest = versions.latest_version_per_id(rows, KEYS, ORDER)
    return compare.set_equal(rows.select("topic", "id"), newest.select("topic", "id"))


@query(
    "set_contains",
    MSG_SQL
    + """select topic, id, version from accepted except select topic, id, version from latest""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    newest = versions.latest_version_per_id(rows, KEYS, ORDER)
    return compare.set_contains(rows.select("topic", "id", "version"), newest.select("topic", "id", "version"))


@query(
    "result_set_verify",
    MSG_SQL
    + """, n as (select topic, id, count(*) c from accepted group by 1, 2)
         select cast(sum(c) as bigint) as golden_rows, count(*) as actual_rows, cast(sum(c) - count(*) as bigint) as missing_rows,
           cast(0 as bigint) as unexpected_rows, sum(c) = count(*) as matches from n""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    newest = versions.latest_version_per_id(rows, KEYS, ORDER)
    return compare.result_set_verify(rows.select("topic", "id"), newest.select("topic", "id"))


@query(
    "mask_volatile_fields",
    MSG_SQL
    + """select event_id, 'ignored value' as trace, 'ignored value' as unit, 'ignored value' as at, 'ignored value' as version,
           'ignored value' as encryption,
           case when json_type(j, '$.message.dbObject') is not null then 'ignored value' end as object,
           json_extract_string(j, '$.message.db') as db, json_extract_string(j, '$.message."@type"') as kind
         from parsed where j is not null""",
)
def _(spark, sf_dir):
    r = read(spark, sf_dir).where("envelope is not null")
    masked = r.select("event_id", payload.mask_fields(F.col("value")).alias("m"))
    get = lambda path: F.get_json_object("m", path)
    return masked.select(
        "event_id",
        get("$.traceId").alias("trace"),
        get("$.unitOfWorkId").alias("unit"),
        get("$.timestamp").alias("at"),
        get("$.version").alias("version"),
        get("$.message.encryption").alias("encryption"),
        get("$.message.dbObject").alias("object"),
        get("$.message.db").alias("db"),
        get("$.message['@type']").alias("kind"),
    )


@query("distinct_pairs", MSG_SQL + "select distinct database, collection from accepted")
def _(spark, sf_dir):
    return compare.distinct_pairs(records(spark, sf_dir))


@query(
    "corporate_ingest_strict",
    MSG_SQL
    + """, v as (select case when j is null then 'Invalid'
            when coalesce(json_type(j, '$.message.dbObject'), 'NULL') = 'NULL' then 'missing dbObject'
            when k is null then 'missing encryptedEncryptionKey' when k = '' then 'empty encryptedEncryptionKey'
            when not regexp_full_match(k, '[A-Za-z0-9+/]{32,}={0,2}') then 'incorrect encryptedEncryptionKey' end as violation
          from (select *, json_extract_string(j, '$.message.encryption.encryptedEncryptionKey') as k from parsed))
         select violation, count(*) as messages from v where violation is not null group by 1""",
)
def _(spark, sf_dir):
    return envelope.strict_violations(b.envelopes(spark, sf_dir))


@query(
    "row_count_check",
    MSG_SQL
    + """, sent as (select * from events where event_id % 50 not in (1, 2, 3, 4, 7))
         select 'daily' as name, (select count(*) from accepted) as actual, (select count(*) from sent) as expected, true as passed
         union all select 'export', (select count(*) from latest), (select count(*) from (select distinct event_type, user_id from sent)), true""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("topic", "id", "version", "event_id")
    # what must arrive follows from the source: all events but those sent with a defect
    sent = b.table(spark, sf_dir, "events").where("event_id % 50 not in (1, 2, 3, 4, 7)")
    daily = checks.row_count_check(rows, sent.agg(F.count("*").alias("expected")), "daily")
    ids_only = sent.select("event_type", "user_id").distinct().agg(F.count("*").alias("expected"))
    newest = versions.latest_version_per_id(rows, KEYS, ORDER)
    return daily.unionByName(checks.row_count_check(newest, ids_only, "export"))


@query(
    "incremental_bookmark",
    MSG_SQL
    + f""", first as (select collection, max(version) as processed_end from accepted where version > 0 and version <= {LOAD_SPLIT_MS} group by 1)
          select a.event_id, a.collection, a.version from accepted a left join first f using (collection)
          where a.version > coalesce(f.processed_end, 0) and a.version <= {LOAD_SPLIT_MS} + 604800000""",
)
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("event_id", "collection", "version")
    path = scratch_path(spark, "processed-ends")
    first = versions.incremental_slice(rows, versions.read_bookmarks(spark, path), F.lit(LOAD_SPLIT_MS))
    versions.save_bookmarks(first, path)
    # the next run starts from what the first one kept
    return versions.incremental_slice(rows, versions.read_bookmarks(spark, path), F.lit(LOAD_SPLIT_MS + 604_800_000)).select(
        "event_id", "collection", "version"
    )


@query("incremental_bookmark_stream", ORACLES["incremental_bookmark"])
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select("event_id", "collection", "version").where("version > 0")
    root, week = scratch_path(spark, "incremental"), 604_800_000
    arrived = lambda low, high: rows.where((F.col("version") > low) & (F.col("version") <= high)).write.mode("append").json(f"{root}/source")
    load = lambda number: incremental.load_new_files(
        spark, f"{root}/source", "event_id bigint, collection string, version bigint", f"{root}/target", f"{root}/checkpoint", number
    ).awaitTermination()
    # the second start finds a week's more files and reads only those
    arrived(0, LOAD_SPLIT_MS)
    load(1)
    arrived(LOAD_SPLIT_MS, LOAD_SPLIT_MS + week)
    load(2)
    return incremental.loaded(spark, f"{root}/target").where("load = 2").select("event_id", "collection", "version")


# --- ids and historic records ---------------------------------------------


@query(
    "extract_id",
    MSG_SQL
    + """select event_id, cast(json_extract(j, '$.message._id') as varchar) as id,
           json_extract_string(j, '$.message._id.userId') as first_value from parsed where j is not null""",
)
def _(spark, sf_dir):
    r = read(spark, sf_dir).where("envelope is not null")
    id_text = ids.message_id(F.col("value"))
    return r.select("event_id", id_text.alias("id"), ids.first_id_value(id_text).alias("first_value"))


@query(
    "wrap_id",
    MSG_SQL
    + """select event_id, '{"id":' || cast(to_json(id) as varchar) || '}' as wrapped from accepted""",
)
def _(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", ids.wrap_id(F.col("id")).alias("wrapped"))


HIST_SQL = """
with o as (select o_orderkey as k, o_orderkey % 8 as d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') as stamp,
             cast(o_orderkey as varchar) as key from orders),
h as (
  select k, d,
    case when d = 2 then key when d = 3 then '{"orderId":"' || key || '","createdDateTime":"' || stamp || 'Z"}'
         else '{"orderId":"' || key || '"}' end as id,
    d in (2, 3) as mongo_format_stripped_from_id,
    case when d in (6, 7) then 'MONGO_DELETE' when d in (0, 1) then 'E2E_IMPORT' else 'MONGO_IMPORT' end as record_type,
    case when d = 4 then '2015-03-20T12:23:25.183+0000' when d = 5 then '1980-01-01T00:00:00.000+0000' else stamp || '+0000' end as last_modified,
    case when d = 4 then 'createdDateTime' when d = 5 then 'epoch' when d = 1 then '_lastModifiedDateTime'
         else '_lastModifiedDateTimeStripped' end as timestamp_created_from,
    d <> 1 as last_modified_date_time_was_altered, d <> 5 as created_date_time_was_altered,
    d = 6 as removed_date_time_was_altered, d = 7 as archived_date_time_was_altered,
    d = 6 as historic_removed_record_altered_on_import, d = 7 as historic_archived_record_altered_on_import
  from o)
"""


def historic(spark, sf_dir):
    return payload.normalise_historic(b.historic_records(spark, sf_dir))


@query("strip_mongo_id", HIST_SQL + "select k, id, mongo_format_stripped_from_id from h")
def _(spark, sf_dir):
    return historic(spark, sf_dir).select("k", "id", "mongo_format_stripped_from_id")


@query(
    "normalise_dates",
    HIST_SQL
    + """select k, last_modified, last_modified_date_time_was_altered, created_date_time_was_altered,
           removed_date_time_was_altered, archived_date_time_was_altered, timestamp_created_from from h""",
)
def _(spark, sf_dir):
    return historic(spark, sf_dir).select(
        "k", "last_modified", *payload.DATE_FLAGS.values(), "timestamp_created_from"
    )


@query(
    "unwrap_removed_archived",
    HIST_SQL
    + """select k, record_type, historic_removed_record_altered_on_import, historic_archived_record_altered_on_import from h""",
)
def _(spark, sf_dir):
    return historic(spark, sf_dir).select(
        "k", "record_type", "historic_removed_record_altered_on_import", "historic_archived_record_altered_on_import"
    )


@query(
    "default_record_type",
    HIST_SQL + "select k, case when d in (0, 1) then 'E2E_IMPORT' else 'MONGO_IMPORT' end as record_type from h",
)
def _(spark, sf_dir):
    h = b.historic_records(spark, sf_dir)
    opened = payload.unwrap_removed_archived(h, "record")
    return opened.select("k", payload.default_record_type(F.col("parsed")).alias("record_type"))


@query(
    "dollar_to_d_keys",
    """select o_orderkey as k,
         case o_orderkey % 8 when 2 then null
           when 4 then null when 5 then null when 1 then null
           when 6 then null when 7 then null
           else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as modified,
         case when o_orderkey % 8 = 2 then cast(o_orderkey as varchar) when o_orderkey % 8 in (6, 7) then 'outer' end as oid
       from orders""".replace("case o_orderkey % 8 when 2 then null\n", "case o_orderkey % 8 when 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'\n"),
)
def _(spark, sf_dir):
    h = b.historic_records(spark, sf_dir).select("k", payload.dollar_to_d_keys(F.col("record")).alias("record"))
    get = lambda path: F.get_json_object("record", path)
    return h.select("k", get("$._lastModifiedDateTime.d_date").alias("modified"), get("$._id.d_oid").alias("oid"))
