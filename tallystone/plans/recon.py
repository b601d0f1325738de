"""Manifest reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import manifest as m
from tallystone.operators import ranking, reports
from tallystone.plans import bindings as b
from tallystone.plans.registry import query
from tallystone.sources import sinks
from tallystone.session import materialise, scratch_path

CUT_START, CUT_END, CUT_MARGIN = 694224000000, 852076800000, 2
AFTER_MS = 852076800000

# Independent SQL form of the same tables: two manifests joined by a FULL JOIN.
BASE_SQL = r"""
with base as (
  select o_orderkey k, cast(o_orderkey as varchar) id, epoch_us(o_orderdate) // 1000 as ts,
         case when o_orderkey % 97 = 0 then 'db_x' else 'db_' || lower(o_orderstatus) end as database,
         o_orderpriority as collection
  from orders),
imp as (
  select *, 'HDI' component, 'import' source,
         case k % 5 when 0 then 'MONGO_INSERT' when 1 then 'MONGO_UPDATE' when 2 then 'MONGO_DELETE'
                    when 3 then 'MONGO_IMPORT' else 'test_update' end as type
  from base
  where k % 10 <> 3 and not (database = 'db_p' and collection = '5-LOW') and database <> 'db_o'),
exp as (
  select k, id, ts + case k % 11 when 0 then 1000 when 1 then -1000 else 0 end as ts, database, collection,
         case when k % 3 = 0 then 'HDI' else 'K2HB' end component, 'export' source,
         case when k % 17 = 0 then null when k % 2 = 0 then 'MONGO_INSERT' else 'test_insert' end as type
  from base
  where k % 7 <> 2 and not (database = 'db_f' and collection = '1-URGENT') and database <> 'db_x'),
matched as (
  select coalesce(i.id, e.id) id, coalesce(i.database, e.database) as database,
         coalesce(i.collection, e.collection) as collection,
         i.ts import_timestamp, i.source import_source, i.component import_component, i.type import_type,
         e.ts export_timestamp, e.source export_source, e.component export_component, e.type export_type,
         least(i.ts, e.ts) earliest_timestamp, greatest(i.ts, e.ts) latest_timestamp,
         case when e.ts is null or i.ts < e.ts then 'import'
              when i.ts is null or e.ts < i.ts then 'export' end earliest_manifest
  from imp i full join exp e on i.database = e.database and i.collection = e.collection and i.id = e.id),
counts as (
  select database || '.' || collection as database_collection, database, collection,
         count(import_timestamp) imported_count, count(export_timestamp) exported_count,
         count(*) filter (export_component = 'HDI') exported_count_from_data_load,
         count(*) filter (export_component <> 'HDI') exported_count_from_streaming_feed,
         count(*) filter (import_timestamp is null) missing_imported_count,
         count(*) filter (export_timestamp is null) missing_exported_count,
         count(*) filter (import_timestamp < export_timestamp) mismatched_timestamps_earlier_in_import_count,
         count(*) filter (export_timestamp < import_timestamp) mismatched_timestamps_earlier_in_export_count,
         max(import_timestamp) latest_import_timestamp, min(import_timestamp) earliest_import_timestamp,
         max(export_timestamp) latest_export_timestamp, min(export_timestamp) earliest_export_timestamp
  from matched group by database, collection),
missing_exports as (
  select id, database, collection, import_timestamp, import_component, import_type from matched
  where export_timestamp is null and (database, collection) in (select (database, collection) from exp)),
missing_imports as (
  select id, database, collection, export_timestamp, export_component, export_type from matched
  where import_timestamp is null and (database, collection) in (select (database, collection) from imp)),
mismatched as (select * from matched where import_timestamp <> export_timestamp)
"""


def sides(spark, sf_dir):
    return b.import_manifest(spark, sf_dir), b.export_manifest(spark, sf_dir)


def counts_table(spark, sf_dir):
    return m.collection_counts(m.match_for_counts(*sides(spark, sf_dir)))


def missing_exports_table(spark, sf_dir):
    return m.missing_exports_of(*sides(spark, sf_dir))


def missing_imports_table(spark, sf_dir):
    return m.missing_imports_of(*sides(spark, sf_dir))


def mismatched_table(spark, sf_dir):
    return m.mismatched_timestamps(m.match_manifests(*sides(spark, sf_dir)))


def reconciled_tables(spark, sf_dir) -> reports.Tables:
    """The four tables, matched once and written before the reports fan out."""
    imports, exports = sides(spark, sf_dir)
    matched = materialise(m.match_manifests(imports, exports), "matched")
    counts = materialise(m.collection_counts(matched), "counts")
    pair = ["database", "collection"]
    exported = counts.where("exported_count > 0").select(*pair)
    imported = counts.where("imported_count > 0").select(*pair)
    # the reports scan these three narrow tables, never the matched one
    return reports.Tables(
        counts=counts,
        missing_imports=materialise(m.missing_imports(matched, imported), "missing-imports"),
        missing_exports=materialise(m.missing_exports(matched, exported), "missing-exports"),
        mismatched=materialise(m.mismatched_timestamps(matched), "mismatched"),
        after_ms=AFTER_MS,
    )


@query("manifest_full_outer", BASE_SQL + "select * from matched")
def _(spark, sf_dir):
    return m.match_manifests(*sides(spark, sf_dir))


@query("manifest_full_outer_kept", BASE_SQL + "select * from matched")
def _(spark, sf_dir):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(manifest, name):
        path = scratch_path(spark, name)
        return m.keep_manifest(manifest, path.rpartition("/")[2].replace("-", "_"), path, buckets)

    imports, exports = sides(spark, sf_dir)
    return m.match_kept(kept(imports, "kept-imports"), kept(exports, "kept-exports"))


@query("collection_counts", BASE_SQL + "select * from counts")
def _(spark, sf_dir):
    return counts_table(spark, sf_dir)


query("missing_exports", BASE_SQL + "select * from missing_exports")(missing_exports_table)
query("missing_imports", BASE_SQL + "select * from missing_imports")(missing_imports_table)
query("mismatched_timestamps", BASE_SQL + "select * from mismatched")(mismatched_table)


@query(
    "cutoff_window",
    BASE_SQL
    + f"""select id, ts as timestamp, database, collection from imp
          where ts >= {CUT_START} and ts <= {CUT_END} + {CUT_MARGIN} * 60000""",
)
def _(spark, sf_dir):
    kept = m.cutoff_window(b.import_manifest(spark, sf_dir), CUT_START, CUT_END, CUT_MARGIN)
    return kept.select("id", "timestamp", "database", "collection")


def _totals(column, other, name):
    return (
        BASE_SQL
        + f"""select cast(sum({column}) as bigint) as {name} from counts
              where {column} > 0 and {other} > 0 and {column} <> {other}"""
    )


def _id_counts(missing, present):
    return (
        BASE_SQL
        + f"""select database, collection, {present}, {missing},
              cast(({missing} * 200 + {present}) // ({present} * 2) as integer) as percentage_missing
              from counts where {missing} > 0 and {present} > 0 and {missing} <> {present}"""
    )


def _mismatch(column, present):
    return (
        BASE_SQL
        + f"""select database, collection, {present}, {column},
              cast(({column} * 200 + {present}) // ({present} * 2) as integer) as percentage_mismatched
              from counts where {column} > 0"""
    )


def _databases(missing, present):
    return (
        BASE_SQL
        + f"select database from counts group by database having sum({missing}) = 0 and sum({present}) > 0"
    )


def _collections(missing, present):
    return (
        BASE_SQL
        + f"""select distinct database, collection from counts where {missing} = 0 and {present} > 0
              and database in (select database from counts group by database having sum({missing}) > 0)"""
    )


COUNT_REPORTS = {
    "export_totals": (
        reports.export_totals,
        BASE_SQL
        + """select count(*) filter (exported_count > 0) as exported_collections_count,
             cast(sum(exported_count) as bigint) as exported_count,
             cast(sum(exported_count_from_data_load) as bigint) as exported_count_from_data_load,
             cast(sum(exported_count_from_streaming_feed) as bigint) as exported_count_from_streaming_feed
             from counts""",
    ),
    "import_totals": (
        reports.import_totals,
        BASE_SQL
        + """select count(*) filter (imported_count > 0) as imported_collections_count,
             cast(sum(imported_count) as bigint) as imported_count from counts""",
    ),
    "missing_exported_totals": (
        reports.missing_exported_totals,
        _totals("missing_exported_count", "imported_count", "missing_exported_count"),
    ),
    "missing_imported_totals": (
        reports.missing_imported_totals,
        _totals("missing_imported_count", "exported_count", "missing_imported_count"),
    ),
    "missing_exported_databases": (
        reports.missing_exported_databases, _databases("exported_count", "imported_count"),
    ),
    "missing_imported_databases": (
        reports.missing_imported_databases, _databases("imported_count", "exported_count"),
    ),
    "missing_exported_collections": (
        reports.missing_exported_collections, _collections("exported_count", "imported_count"),
    ),
    "missing_imported_collections": (
        reports.missing_imported_collections, _collections("imported_count", "exported_count"),
    ),
    "missing_exported_id_counts": (
        reports.missing_exported_id_counts, _id_counts("missing_exported_count", "imported_count"),
    ),
    "missing_imported_id_counts": (
        reports.missing_imported_id_counts, _id_counts("missing_imported_count", "exported_count"),
    ),
    "mismatched_earlier_in_export_count": (
        reports.mismatched_earlier_in_export_count,
        _mismatch("mismatched_timestamps_earlier_in_export_count", "exported_count"),
    ),
    "mismatched_earlier_in_import_count": (
        reports.mismatched_earlier_in_import_count,
        _mismatch("mismatched_timestamps_earlier_in_import_count", "imported_count"),
    ),
    "import_totals_by_collection": (
        reports.import_totals_by_collection,
        BASE_SQL
        + """select database, collection, imported_count, latest_import_timestamp, earliest_import_timestamp
             from counts where imported_count > 0""",
    ),
    "export_totals_by_collection": (
        reports.export_totals_by_collection,
        BASE_SQL
        + """select database, collection, exported_count, exported_count_from_data_load,
             exported_count_from_streaming_feed, latest_export_timestamp, earliest_export_timestamp
             from counts where exported_count > 0""",
    ),
}
for _name, (_report, _sql) in COUNT_REPORTS.items():
    query(_name, _sql)(lambda spark, sf_dir, r=_report: r(counts_table(spark, sf_dir)))


def _top(source, columns, where="true"):
    return (
        BASE_SQL
        + f"""select {columns} from (
                select *, row_number() over (partition by database, collection order by id desc) rn
                from {source} where {where}) where rn <= {reports.DEFAULT_TOP_IDS}"""
    )


_EARLIER = "database, collection, id, export_component, export_type, earliest_timestamp, latest_timestamp, earliest_manifest"
ID_REPORTS = {
    "missing_exported_ids_top_n": (
        lambda s, d: reports.missing_exported_ids(missing_exports_table(s, d)),
        _top("missing_exports", "database, collection, id, import_timestamp, import_component, import_type"),
    ),
    "missing_imported_ids_top_n": (
        lambda s, d: reports.missing_imported_ids(missing_imports_table(s, d)),
        _top("missing_imports", "database, collection, id, export_timestamp, export_component, export_type"),
    ),
    "timestamps_earlier_in_export_top_n": (
        lambda s, d: reports.timestamps_earlier_in_export(mismatched_table(s, d)),
        _top("mismatched", _EARLIER, "lower(earliest_manifest) = 'export'"),
    ),
    "timestamps_earlier_in_import_top_n": (
        lambda s, d: reports.timestamps_earlier_in_import(mismatched_table(s, d)),
        _top("mismatched", _EARLIER, "lower(earliest_manifest) = 'import'"),
    ),
    "missing_exported_ids_after_date": (
        lambda s, d: reports.missing_exported_ids_after_date(missing_exports_table(s, d), AFTER_MS),
        BASE_SQL + f"select * from missing_exports where import_timestamp > {AFTER_MS}",
    ),
}
for _name, (_build, _sql) in ID_REPORTS.items():
    query(_name, _sql)(_build)


def _label_sql():
    parts = []
    for side, col, tab in (("imports", "export_type", "missing_imports"), ("exports", "import_type", "missing_exports")):
        parts.append(f"select 'Total missing {side}' as label, count(*) as id_count from {tab}")
        for n in reports.NAMED_TYPES:
            parts.append(
                f"select 'Total missing {side} of type {n}', count(*) from {tab} where lower({col}) = 'mongo_{n}'"
            )
        others = " and ".join(f"lower({col}) <> 'mongo_{n}'" for n in reports.NAMED_TYPES)
        parts.append(f"select 'Total missing {side} of type other', count(*) from {tab} where {others}")
    return BASE_SQL + " union all ".join(parts)


def type_counts(spark, sf_dir):
    return reports.collection_type_counts(m.match_for_types(*sides(spark, sf_dir)))


@query("individual_type_totals", _label_sql())
def _(spark, sf_dir):
    return reports.type_totals(type_counts(spark, sf_dir))


@query("union_all_labelled", _label_sql())
def _(spark, sf_dir):
    # one row per collection, which both parts read
    return reports.type_totals_union(materialise(type_counts(spark, sf_dir), "type-counts"))


# --- packs ----------------------------------------------------------------


def _pack_sql():
    """The same pack from the per-report SQL, numbered in report order."""
    bodies = {
        "Missing exported databases": COUNT_REPORTS["missing_exported_databases"][1],
        "Missing exported collections": COUNT_REPORTS["missing_exported_collections"][1],
        "Export totals": COUNT_REPORTS["export_totals"][1],
        "Import totals": COUNT_REPORTS["import_totals"][1],
        "Missing exported totals": COUNT_REPORTS["missing_exported_totals"][1],
        "Missing imported totals": COUNT_REPORTS["missing_imported_totals"][1],
        "Missing exported id counts": COUNT_REPORTS["missing_exported_id_counts"][1],
        "Mismatched timestamps count earlier in the export": COUNT_REPORTS["mismatched_earlier_in_export_count"][1],
        "Missing imported databases": COUNT_REPORTS["missing_imported_databases"][1],
        "Missing imported collections": COUNT_REPORTS["missing_imported_collections"][1],
        "Missing imported id counts": COUNT_REPORTS["missing_imported_id_counts"][1],
        "Missing imported ids": ID_REPORTS["missing_imported_ids_top_n"][1],
        "Mismatched timestamps count earlier in the import": COUNT_REPORTS["mismatched_earlier_in_import_count"][1],
        "Timestamps earlier in export": ID_REPORTS["timestamps_earlier_in_export_top_n"][1],
        "Timestamps earlier in import": ID_REPORTS["timestamps_earlier_in_import_top_n"][1],
        "Missing exported ids": ID_REPORTS["missing_exported_ids_top_n"][1],
        "Import totals by collection": COUNT_REPORTS["import_totals_by_collection"][1],
        "Export totals by collection": COUNT_REPORTS["export_totals_by_collection"][1],
        "Output missing exported ids after given timestamp": ID_REPORTS["missing_exported_ids_after_date"][1],
        "Individual types totals": _label_sql(),
    }
    parts = []
    for r in reports.REPORTS:
        body = bodies[r.name][len(BASE_SQL):]
        order = ", ".join([r.rank, *r.text_order])
        label = "key || ': ' || " if r.show_column_names else ""
        text = f"array_to_string(list_transform(json_keys(j), lambda key: {label}json_extract_string(j, '$.' || key)), ', ')"
        parts.append(
            f"""select '{r.query_type}' as query_type, cast({r.order} as integer) as query_order,
                '{r.name}' as query_name, row_no, cast(j as varchar) as row_json, {text} as row_text
                from (select row_no, to_json(struct_pack(*columns(* exclude row_no))) as j from (
                  select row_no, coalesce(columns(* exclude row_no)::varchar, 'null') as '\\0' from (
                    select row_number() over (order by {order}) as row_no, b.* from ({body}) b)))"""
        )
    return " union all ".join(parts)


PACK_SQL = BASE_SQL + _pack_sql()


@query("report_pack", PACK_SQL)
def _(spark, sf_dir):
    return reports.report_pack(reconciled_tables(spark, sf_dir))


@query(
    "sink_report_text",
    BASE_SQL + f"select query_type, chr(9) || '-- ' || row_text as line from ({_pack_sql()})"
    + " union all "
    + " union all ".join(f"select '{r.query_type}', 'Name: {r.name}'" for r in reports.REPORTS),
)
def _(spark, sf_dir):
    lines = reports.report_text_lines(reports.report_pack(reconciled_tables(spark, sf_dir)))
    return sinks.written_and_read_report(lines, "report-text")


def _json_lines_sql():
    flag = lambda r: "true" if r.show_column_names else "false"
    firsts = {k: min(r.order for r in reports.REPORTS if r.query_type == k) for k in reports.QUERY_TYPES}
    parts = [
        f"""select query_type, query_order, row_no as position,
            case when row_no = 1 then '' else ',' end || row_json as line from ({_pack_sql()})"""
    ]
    for kind in reports.QUERY_TYPES:
        parts.append(
            f"""select '{kind}', cast(0 as integer), cast(0 as bigint),
                '{{"executed_by":"tests","execution_time":"0","query_results":['"""
        )
        parts.append(f"select '{kind}', cast({(1 << 31) - 1} as integer), cast(0 as bigint), ']}}'")
    for r in reports.REPORTS:
        comma = "" if r.order == firsts[r.query_type] else ","
        details = (
            f'{{"query_name":"{r.name}","query_type":"{r.query_type}",'
            f'"show_column_names":{flag(r)},"order":{r.order}}}'
        )
        parts.append(
            f"""select '{r.query_type}', cast({r.order} as integer), cast(0 as bigint),
                '{comma}{{"query_details":{details},"query_results":['"""
        )
        parts.append(
            f"select '{r.query_type}', cast({r.order} as integer), cast({1 << 62} as bigint), ']}}'"
        )
    return BASE_SQL + "select query_type, line from (" + " union all ".join(parts) + ")"


@query("sink_report_json", _json_lines_sql())
def _(spark, sf_dir):
    pack = reports.report_pack(reconciled_tables(spark, sf_dir))
    return sinks.written_and_read_report(reports.report_json_lines(pack, "tests", "0"), "report-json")


@query(
    "sink_report_documents",
    BASE_SQL + f"""select query_type, query_name, cast(count(*) as integer) as row_count,
      cast(sum(strlen(row_json)) as bigint) as row_bytes from ({_pack_sql()}) group by query_type, query_name""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "report-documents")
    pack = reports.report_pack(reconciled_tables(spark, sf_dir))
    sinks.write_report_documents(reports.report_json_lines(pack, "tests", "0"), path)
    # every file is one document
    documents = spark.read.schema("value string, query_type string").text(path, wholetext=True)
    result = "struct<query_details:struct<query_name:string>,query_results:array<string>>"
    parsed = F.from_json("value", f"struct<executed_by:string,execution_time:string,query_results:array<{result}>>", {"mode": "FAILFAST"})
    each = documents.select("query_type", F.explode(parsed["query_results"]).alias("r"))
    rows = F.col("r.query_results")
    return each.where(F.size(rows) > 0).select(
        "query_type",
        F.col("r.query_details.query_name").alias("query_name"),
        F.size(rows).alias("row_count"),
        F.aggregate(rows, F.lit(0).cast("bigint"), lambda n, row: n + F.octet_length(row)).alias("row_bytes"),
    )
