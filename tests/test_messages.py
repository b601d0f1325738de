"""Envelope validation, record clean-up and versions."""

import json

import pytest
from pyspark.sql import functions as F

from tallystone.functions import dates, ids, payload
from tallystone.operators import envelope, versions

KEY = "AQID" + "A" * 40


def message(**change):
    body = {
        "traceId": "t", "unitOfWorkId": "u", "@type": "V4", "version": "v", "timestamp": "2018-12-12T15:01:02.000+0000",
        "message": {
            "@type": "E2E_IMPORT", "collection": "c", "db": "d", "_id": {"e2eId": "1"},
            "_lastModifiedDateTime": "2018-11-01T03:02:01.001+0000",
            "encryption": {"encryptedEncryptionKey": KEY}, "dbObject": "c2VjcmV0",
        },
    }
    for name, value in change.items():
        if value is None:
            body["message"].pop(name)
        else:
            body["message"][name] = value
    return json.dumps(body)


def read(spark, values, topic="db.d.c"):
    df = spark.createDataFrame([(i, topic, v) for i, v in enumerate(values)], "sequence int, topic string, value string")
    return envelope.read_messages(df)


@pytest.mark.parametrize("topic", ["db.d.c", "data.equality", "data.businessAudit"])
def test_bad_messages_are_rejected(spark, topic):
    good = message()
    bad = {
        "broken": good.replace('"encryption": {', '"encryption": { {'),
        "trailing brace": good + "}",
        "two documents": good + "," + good,
        "closing early": good + "],[",
        "with fake marker": good + ',{"_end":"1"}]',
        "scalar": "5",
        "empty": "",
        "missing dbObject": message(dbObject=None),
        "plain dbObject": message(dbObject={"a": 1}),
    }
    got = {r.sequence: r.reason for r in read(spark, [good, *bad.values()], topic).collect()}
    assert got[0] is None
    assert [got[i] for i in range(1, 8)] == [envelope.INVALID_JSON] * 7
    assert got[8] == envelope.MISSING_OBJECT and got[9] == envelope.PLAIN_OBJECT


def test_database_and_collection_only_matter_on_main(spark):
    values = [message(db=None), message(collection=None)]
    main = [r.reason for r in read(spark, values).orderBy("sequence").collect()]
    assert main == [envelope.MISSING_DATABASE, envelope.MISSING_COLLECTION]
    other = [r.reason for r in read(spark, values, "data.equality").collect()]
    assert other == [None, None]


def test_every_message_is_either_accepted_or_dead(spark, sf_dir):
    from tallystone.plans import bindings as b

    messages = b.envelopes(spark, sf_dir)
    r = envelope.read_messages(messages)
    assert envelope.accepted(r).count() + envelope.dead_letters(r).count() == messages.count()


def test_version_and_its_source(spark):
    values = [
        message(),
        message(_lastModifiedDateTime=None, createdDateTime="2017-10-03T05:04:03.003+0000"),
        message(_lastModifiedDateTime=None),
        message(_lastModifiedDateTime=""),
    ]
    got = envelope.accepted(read(spark, values), extra=("sequence",)).orderBy("sequence").collect()
    assert [g.timestamp_created_from for g in got] == ["_lastModifiedDateTime", "createdDateTime", "epoch", "epoch"]
    assert [g.version for g in got] == [1541041321001, 1507007043003, 315532800000, 315532800000]
    assert got[0].id == '{"e2eId":"1"}' and got[0].body == "c2VjcmV0"


def test_strict_load_reasons_and_failure(spark):
    values = [
        message(),
        message(_lastModifiedDateTime=None),
        message(dbObject=None),
        message(encryption={}),
        message(encryption={"encryptedEncryptionKey": ""}),
        message(encryption={"encryptedEncryptionKey": "foobar"}),
        message() + "x",
    ]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r.violation: r.messages for r in envelope.strict_violations(df).collect()}
    assert got == {
        envelope.MISSING_OBJECT: 1, envelope.MISSING_KEY: 1, envelope.EMPTY_KEY: 1,
        envelope.WRONG_KEY: 1, envelope.INVALID_JSON: 1,
    }
    assert envelope.strict_ingest(df.limit(2)).select("value").count() == 2
    # a full read, one column that is not the message, and a bare count all see the bad ones
    for use in (lambda d: d.collect(), lambda d: d.select("envelope").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="encryptedEncryptionKey|dbObject|Invalid"):
            use(envelope.strict_ingest(df))


STAMP = "2018-11-01T03:02:01.001Z"
OUT = "2018-11-01T03:02:01.001+0000"
CREATED = {"$date": "2015-03-20T12:23:25.183Z"}


def historic(spark, *records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "n int, record string")
    return payload.normalise_historic(df).orderBy("n").collect()


def test_historic_shapes(spark):
    plain = {"_id": {"e2eId": "1"}, "@type": "E2E_IMPORT", "createdDateTime": CREATED, "_lastModifiedDateTime": {"$date": STAMP}}
    text_date = {**plain, "_lastModifiedDateTime": STAMP}
    oid = {"_id": {"$oid": "1"}, "createdDateTime": STAMP, "_removedDateTime": {"$date": STAMP}, "_lastModifiedDateTime": {"$date": STAMP}}
    embedded = {**plain, "_id": {"e2eId": "1", "createdDateTime": {"$date": STAMP}}}
    no_last = {k: v for k, v in plain.items() if k != "_lastModifiedDateTime"}
    neither = {"_id": {"e2eId": "1"}, "@type": "E2E_IMPORT"}
    removed = {"_id": {"$oid": "outer"}, "_removed": plain, "_removedDateTime": {"$date": STAMP}}
    archived = {"_id": {"$oid": "outer"}, "_archived": plain, "_archivedDateTime": {"$date": STAMP}}
    got = historic(spark, plain, text_date, oid, embedded, no_last, neither, removed, archived)

    flags = lambda g: (
        g.mongo_format_stripped_from_id, g.last_modified_date_time_was_altered, g.created_date_time_was_altered,
        g.removed_date_time_was_altered, g.archived_date_time_was_altered,
        g.historic_removed_record_altered_on_import, g.historic_archived_record_altered_on_import,
    )
    T, f = True, False
    assert [flags(g) for g in got] == [
        (f, T, T, f, f, f, f),
        (f, f, T, f, f, f, f),
        (T, T, f, T, f, f, f),
        (T, T, T, f, f, f, f),
        (f, T, T, f, f, f, f),
        (f, T, f, f, f, f, f),
        (f, T, T, T, f, T, f),
        (f, T, T, f, T, f, T),
    ]
    stripped = "_lastModifiedDateTimeStripped"
    assert [g.timestamp_created_from for g in got] == [
        stripped, "_lastModifiedDateTime", stripped, stripped, "createdDateTime", "epoch", stripped, stripped,
    ]
    assert [g.last_modified for g in got] == [
        OUT, OUT, OUT, OUT, "2015-03-20T12:23:25.183+0000", dates.EPOCH_DEFAULT, OUT, OUT,
    ]
    assert [g.record_type for g in got] == ["E2E_IMPORT", "E2E_IMPORT", "MONGO_IMPORT"] + ["E2E_IMPORT"] * 3 + ["MONGO_DELETE"] * 2
    assert got[2].id == "1"
    assert json.loads(got[3].id) == {"e2eId": "1", "createdDateTime": STAMP}
    assert json.loads(got[6].record) == plain and json.loads(got[6].id) == {"e2eId": "1"}


def test_payload_edits(spark):
    doc = {"secret": 1, "a": {"secret": 2, "b": [{"secret": 3}], "c": {"secret": {"x": 1}, "k": None}}}
    df = spark.createDataFrame([(json.dumps(doc),), (None,)], "t string")
    got = df.select(payload.json_drop_key(F.col("t"), "secret").alias("d"), payload.json_replace_value(F.col("t"), "secret", 0).alias("r")).collect()
    assert json.loads(got[0].d) == {"a": {"b": [{"secret": 3}], "c": {"k": None}}}
    assert json.loads(got[0].r) == {"secret": 0, "a": {"secret": 0, "b": [{"secret": 3}], "c": {"secret": 0, "k": None}}}
    assert got[1].d is None


def test_masking_keeps_other_fields(spark):
    doc = {"body": "x", "reason": None, "key": 1.50, "message": {"dbObject": {"q": 1}, "encryption": {}, "keep": [1, {"z": 1, "a": 2}]}}
    df = spark.createDataFrame([(json.dumps(doc),), ('{"message":"text","key":"k"}',)], "t string")
    got = [json.loads(r[0]) for r in df.select(payload.mask_fields(F.col("t"))).collect()]
    hidden = payload.IGNORED
    assert got[0] == {
        "body": hidden, "reason": hidden, "key": 1.5,
        "message": {"dbObject": hidden, "encryption": hidden, "keep": [1, {"z": 1, "a": 2}]},
    }
    assert got[1] == {"message": "text", "key": "k"}


def test_ids(spark):
    df = spark.createDataFrame([('{"e2eId": "a b"}',), ("plain",), ('{"$oid": "x"}',)], "i string")
    got = df.select(
        ids.first_id_value(F.col("i")).alias("first"), ids.wrap_id(F.col("i")).alias("wrapped"), ids.strip_mongo_id(F.col("i")).alias("bare")
    ).collect()
    assert [g.first for g in got] == ["a b", "plain", "x"]
    assert got[0].wrapped == json.dumps({"id": json.dumps({"e2eId": "a b"})}).replace(" ", "")
    assert [g.bare for g in got] == ['{"e2eId": "a b"}', "plain", "x"]


def test_newest_version_with_a_dominant_key(spark):
    # one key holds a third of all rows and many equal versions
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("key"),
        (F.col("id") % 7).alias("version"), F.col("id").alias("sequence"),
    )
    got = {r.key: (r.version, r.sequence) for r in versions.latest_version_per_id(rows, ["key"], ["version", "sequence"]).collect()}
    want = {}
    for r in rows.collect():
        want[r.key] = max(want.get(r.key, (-1, -1)), (r.version, r.sequence))
    assert got == want
    again = versions.latest_version_per_id(
        versions.latest_version_per_id(rows, ["key"], ["version", "sequence"]), ["key"], ["version", "sequence"]
    )
    assert {r.key: (r.version, r.sequence) for r in again.collect()} == want


def test_forty_messages_of_twenty_ids(spark):
    rows = spark.range(40).select((F.col("id") % 20).alias("id"), F.lit(1).alias("version"), F.col("id").alias("sequence"),
                                  F.when(F.col("id") >= 20, "MONGO_DELETE").otherwise("MONGO_UPDATE").alias("record_type"))
    newest = versions.latest_version_per_id(rows, ["id"], ["version", "sequence"])
    assert newest.count() == 20
    assert newest.where("record_type = 'MONGO_DELETE'").count() == 20
    assert versions.without_deleted(newest).count() == 0


def test_skip_existing(spark):
    schema = "topic string, id string, version int, sequence int"
    store = spark.createDataFrame([("t", "a", 5, 1), ("t", "b", 5, 1)], schema)
    new = spark.createDataFrame([("t", "a", 9, 2), ("t", "b", 3, 2), ("t", "c", 1, 2), ("t", "c", 2, 3)], schema)
    load = lambda skip: sorted((r.id, r.version) for r in versions.skip_existing_load(new, store, ["topic", "id"], ["version", "sequence"], skip).collect())
    assert load(True) == [("a", 5), ("b", 5), ("c", 2)]
    assert load(False) == [("a", 9), ("b", 5), ("c", 2)]
