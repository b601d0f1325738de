"""Golden figures of every reconciliation report."""

import json

import pytest

import manifest_fixture as fx
from tallystone.operators import manifest as m
from tallystone.operators import reports as r
from tallystone.session import materialise
from tallystone.sources.readers import scan_manifest_csv

S = fx.BASE_SECOND * 1000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    imp, exp = fx.write(str(tmp_path_factory.mktemp("manifests")))
    cut = lambda path: m.cutoff_window(scan_manifest_csv(spark, path), None, fx.CUTOFF_END_MS, fx.MARGIN_MINUTES)
    imports, exports = cut(imp), cut(exp)
    matched = materialise(m.match_manifests(imports, exports), "matched")
    return r.Tables(
        counts=m.collection_counts(m.match_for_counts(imports, exports)),
        missing_imports=m.missing_imports(matched),
        missing_exports=m.missing_exports(matched, m.collections_of(exports)),
        mismatched=m.mismatched_timestamps(matched),
    )


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_totals(tables):
    assert rows(r.export_totals(tables.counts)) == [(8, 25, 0, 25)]
    assert rows(r.import_totals(tables.counts)) == [(13, 31)]
    assert rows(r.missing_exported_totals(tables.counts)) == [(6,)]
    assert rows(r.missing_imported_totals(tables.counts)) == [(5,)]


def test_missing_databases_and_collections(tables):
    assert rows(r.missing_exported_databases(tables.counts)) == [("core",), ("dbimportonly",)]
    assert rows(r.missing_imported_databases(tables.counts)) == [("dbexportonly",)]
    assert rows(r.missing_exported_collections(tables.counts)) == [
        ("accepted-data", "bankDetails"),
        ("dbone", "claimant"),
        ("dbone", "collectionduplicatedone"),
        ("dbone", "collectionimportonly"),
        ("dbone", "collectionimportonlytwo"),
        ("dbone", "dbduplicatedone"),
    ]
    assert rows(r.missing_imported_collections(tables.counts)) == [
        ("dbone", "collectionexportonly"),
        ("dbone", "collectionexportonlytwo"),
    ]


def test_percentages_round_half_up(tables):
    c = tables.counts
    assert rows(r.missing_exported_id_counts(c)) == [("dbone", "collectionfive", 17, 6, 35)]
    assert rows(r.missing_imported_id_counts(c)) == [("dbone", "collectionfive", 16, 5, 31)]
    assert rows(r.mismatched_earlier_in_import_count(c)) == [("dbone", "collectionfive", 17, 4, 24)]
    assert rows(r.mismatched_earlier_in_export_count(c)) == [
        ("dbone", "collectionfive", 16, 4, 25),
        ("dbone", "collectionmismatched", 3, 2, 67),
    ]


def test_totals_by_collection(tables):
    got = {(x[0], x[1]): x[2:] for x in rows(r.import_totals_by_collection(tables.counts))}
    assert len(got) == 13
    assert got["dbone", "collectionfive"] == (17, S + 1033000, S + 721000)
    assert got["dbone", "collectionmismatched"] == (3, S + 726000, S + 722000)
    assert got["dbone", "collectionimportonly"] == (1, S + 1010000, S + 1010000)
    got = {(x[0], x[1]): x[2:] for x in rows(r.export_totals_by_collection(tables.counts))}
    assert len(got) == 8
    assert got["dbone", "collectionfive"] == (16, 0, 16, S + 1031000, S + 721000)
    assert got["dbexportonly", "collectionone"] == (1, 0, 1, S + 725000, S + 725000)


def test_missing_ids(tables):
    assert [(x[2], x[3] - S, x[5]) for x in rows(r.missing_exported_ids(tables.missing_exports))] == [
        ("guid57", 725000, "MONGO_UPDATE"),
        ('{""importonlybeforebackuptakenid"": ""44"", "secondid": "44-2", "thirdid": "44-3"}', 725000, "MONGO_DELETE"),
        ('{""importonlybeforebackuptakenid"": ""45"", "secondid": "45-2", "thirdid": "45-3"}', 726000, "MONGO_DELETE"),
        ('{""importonlybeforebackuptakenid"": ""46"", "secondid": "46-2", "thirdid": "46-3"}', 726000, "test_update"),
        ('{""importonlyinsidemarginid"": ""42""}', 1008000, "test_update"),
        ('{""importonlyinsidemarginid"": ""43"", "secondid": "43-2"}', 1007000, "MONGO_INSERT"),
    ]
    assert [x[2] for x in rows(r.missing_imported_ids(tables.missing_imports))][0] == "guid60"
    assert tables.missing_imports.count() == 5


def test_earlier_timestamps(tables):
    got = rows(r.timestamps_earlier_in_export(tables.mismatched))
    assert [(x[1], x[5] - S, x[6] - S, x[7]) for x in got] == [
        ("collectionfive", 723000, 724000, "export"),
        ("collectionfive", 1030000, 1031000, "export"),
        ("collectionfive", 1031000, 1032000, "export"),
        ("collectionfive", 1031000, 1033000, "export"),
        ("collectionmismatched", 724000, 725000, "export"),
        ("collectionmismatched", 724000, 726000, "export"),
    ]
    quoted = [x[2] for x in got if x[2].startswith('{"earlier')]
    assert quoted == ['{"earlierinexportbeforebackuptakenid": "56"}']
    got = rows(r.timestamps_earlier_in_import(tables.mismatched))
    assert [x[2] for x in got] == [
        "35",
        '{""earlierinimportbeforebackuptakenid"": ""34""}',
        '{""earlierinimportinsidemarginid"": ""32""}',
        '{""earlierinimportinsidemarginid"": ""33""}',
    ]


def test_type_totals_two_ways(tables):
    one = rows(r.individual_type_totals(tables.missing_imports, tables.missing_exports))
    two = rows(r.union_all_labelled(tables.missing_imports, tables.missing_exports))
    assert one == two
    got = dict(one)
    assert got["Total missing exports"] == 6
    assert got["Total missing exports of type delete"] == 2
    assert got["Total missing exports of type insert"] == 1
    assert got["Total missing exports of type update"] == 1
    assert got["Total missing exports of type other"] == 2
    assert got["Total missing imports of type other"] == 5


def test_window_end_includes_margin(spark, tmp_path):
    imp, _ = fx.write(str(tmp_path))
    lines = scan_manifest_csv(spark, imp)
    assert m.cutoff_window(lines, None, fx.CUTOFF_END_MS, 2).count() == 31
    assert m.cutoff_window(lines, None, fx.CUTOFF_END_MS, 0).count() == 23


def test_pack_json_is_one_document(tables):
    pack = r.report_pack(tables)
    lines = r.report_json_lines(pack, "me", "1").where("query_type = 'main'").collect()
    doc = json.loads("".join(x["line"] for x in lines))
    assert doc["executed_by"] == "me"
    names = [q["query_details"]["query_name"] for q in doc["query_results"]]
    assert names[0] == "Missing exported databases" and len(names) == 8
    assert doc["query_results"][2]["query_results"] == [
        {
            "exported_collections_count": "8",
            "exported_count": "25",
            "exported_count_from_data_load": "0",
            "exported_count_from_streaming_feed": "25",
        }
    ]
    text = [x["line"] for x in r.report_text_lines(pack).where("query_type = 'main'").collect()]
    assert "\t-- imported_collections_count: 13, imported_count: 31" in text
    # an order number above the number of reports is still run
    assert pack.where("query_type = 'specific' and query_order = 6").count() == 12


def test_repeated_lines_count_once(spark):
    schema = "id string, timestamp bigint, database string, collection string, source string, component string, original_id string, type string"
    imp = spark.createDataFrame([("a", t, "d", "c", "import", "HDI", "a", "x") for t in (1, 3, 2)], schema)
    exp = spark.createDataFrame([("a", t, "d", "c", "export", "K2HB", "a", "x") for t in (5, 4)], schema)
    got = m.match_manifests(imp, exp).collect()
    assert [(g.import_timestamp, g.export_timestamp, g.earliest_manifest) for g in got] == [(3, 5, "import")]
    c = m.collection_counts(m.match_for_counts(imp, exp)).collect()[0]
    assert (c.imported_count, c.exported_count, c.exported_count_from_streaming_feed) == (1, 1, 1)
    d = m.collection_counts(m.match_manifests(imp, exp)).collect()[0]
    assert c == d


def test_direct_form_of_the_missing_tables(spark, tables, tmp_path):
    imp, exp = fx.write(str(tmp_path))
    cut = lambda path: m.cutoff_window(scan_manifest_csv(spark, path), None, fx.CUTOFF_END_MS, fx.MARGIN_MINUTES)
    got = sorted(rows(m.missing_exports_of(cut(imp), cut(exp))))
    assert got == sorted(rows(tables.missing_exports)) and len(got) == 6
    got = sorted(rows(m.missing_imports_of(cut(imp), cut(exp))))
    assert got == sorted(rows(tables.missing_imports)) and len(got) == 5
