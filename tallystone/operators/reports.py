"""The reconciliation reports.

Each report is a function of the counts table or of one id-level table.  The
``REPORTS`` catalogue holds their fixed metadata and drives the report pack.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import materialise
from tallystone.functions.numbers import percent_half_up
from tallystone.operators.ranking import numbered, top_n_per_group

DEFAULT_TOP_IDS = 10

# Change types counted by name; all others count as "other".
NAMED_TYPES = ("insert", "update", "delete", "import")


def _sorted(df: DataFrame, ordered: bool, *keys) -> DataFrame:
    """Report order; a pack numbers its rows itself and skips the sort."""
    return df.orderBy(*keys) if ordered else df


# --- from the counts table ------------------------------------------------


def export_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count_if(F.col("exported_count") > 0).alias("exported_collections_count"),
        F.sum("exported_count").alias("exported_count"),
        F.sum("exported_count_from_data_load").alias("exported_count_from_data_load"),
        F.sum("exported_count_from_streaming_feed").alias("exported_count_from_streaming_feed"),
    )


def import_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count_if(F.col("imported_count") > 0).alias("imported_collections_count"),
        F.sum("imported_count").alias("imported_count"),
    )


def _partly_missing(counts: DataFrame, missing: str, present: str) -> DataFrame:
    m, p = F.col(missing), F.col(present)
    return counts.where((m > 0) & (p > 0) & (m != p))


def missing_exported_totals(counts: DataFrame) -> DataFrame:
    part = _partly_missing(counts, "missing_exported_count", "imported_count")
    return part.agg(F.sum("missing_exported_count").alias("missing_exported_count"))


def missing_imported_totals(counts: DataFrame) -> DataFrame:
    part = _partly_missing(counts, "missing_imported_count", "exported_count")
    return part.agg(F.sum("missing_imported_count").alias("missing_imported_count"))


def _database_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("database").agg(
        F.sum("imported_count").alias("imported"), F.sum("exported_count").alias("exported")
    )


def missing_exported_databases(counts: DataFrame, ordered: bool = True) -> DataFrame:
    out = _database_sums(counts).where("exported = 0 and imported > 0").select("database")
    return _sorted(out, ordered, "database")


def missing_imported_databases(counts: DataFrame, ordered: bool = True) -> DataFrame:
    out = _database_sums(counts).where("imported = 0 and exported > 0").select("database")
    return _sorted(out, ordered, "database")


def _missing_collections(counts: DataFrame, missing: str, present: str, known: str, ordered: bool) -> DataFrame:
    known_databases = _database_sums(counts).where(f"{known} > 0").select("database")
    out = (
        counts.where(f"{missing} = 0 and {present} > 0")
        .join(known_databases, "database", "left_semi")
        .select("database", "collection")
        .distinct()
    )
    return _sorted(out, ordered, "database", "collection")


def missing_exported_collections(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _missing_collections(counts, "exported_count", "imported_count", "exported", ordered)


def missing_imported_collections(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _missing_collections(counts, "imported_count", "exported_count", "imported", ordered)


def _missing_id_counts(counts: DataFrame, missing: str, present: str, ordered: bool) -> DataFrame:
    out = _partly_missing(counts, missing, present).select(
        "database",
        "collection",
        present,
        missing,
        percent_half_up(F.col(missing), F.col(present)).alias("percentage_missing"),
    )
    return _sorted(out, ordered, F.desc(missing), "database", "collection")


def missing_exported_id_counts(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _missing_id_counts(counts, "missing_exported_count", "imported_count", ordered)


def missing_imported_id_counts(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _missing_id_counts(counts, "missing_imported_count", "exported_count", ordered)


def _mismatch_counts(counts: DataFrame, mismatched: str, present: str, ordered: bool) -> DataFrame:
    out = counts.where(F.col(mismatched) > 0).select(
        "database",
        "collection",
        present,
        mismatched,
        percent_half_up(F.col(mismatched), F.col(present)).alias("percentage_mismatched"),
    )
    return _sorted(out, ordered, "database", "collection")


def mismatched_earlier_in_export_count(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _mismatch_counts(counts, "mismatched_timestamps_earlier_in_export_count", "exported_count", ordered)


def mismatched_earlier_in_import_count(counts: DataFrame, ordered: bool = True) -> DataFrame:
    return _mismatch_counts(counts, "mismatched_timestamps_earlier_in_import_count", "imported_count", ordered)


def import_totals_by_collection(counts: DataFrame, ordered: bool = True) -> DataFrame:
    out = counts.where("imported_count > 0").select(
        "database", "collection", "imported_count", "latest_import_timestamp", "earliest_import_timestamp"
    )
    return _sorted(out, ordered, "database", "collection")


def export_totals_by_collection(counts: DataFrame, ordered: bool = True) -> DataFrame:
    out = counts.where("exported_count > 0").select(
        "database",
        "collection",
        "exported_count",
        "exported_count_from_data_load",
        "exported_count_from_streaming_feed",
        "latest_export_timestamp",
        "earliest_export_timestamp",
    )
    return _sorted(out, ordered, "database", "collection")


# --- from the id-level tables ---------------------------------------------


def _top_ids(df: DataFrame, columns: list[str], n: int, ordered: bool) -> DataFrame:
    top = top_n_per_group(df.select(*columns), ["database", "collection"], [F.desc("id")], n)
    return _sorted(top, ordered, "database", "collection", "id")


def missing_exported_ids(missing_exports: DataFrame, n: int = DEFAULT_TOP_IDS, ordered: bool = True) -> DataFrame:
    return _top_ids(
        missing_exports,
        ["database", "collection", "id", "import_timestamp", "import_component", "import_type"],
        n,
        ordered,
    )


def missing_imported_ids(missing_imports: DataFrame, n: int = DEFAULT_TOP_IDS, ordered: bool = True) -> DataFrame:
    return _top_ids(
        missing_imports,
        ["database", "collection", "id", "export_timestamp", "export_component", "export_type"],
        n,
        ordered,
    )


def _timestamps_earlier(mismatched: DataFrame, side: str, n: int, ordered: bool) -> DataFrame:
    columns = [
        "database", "collection", "id", "export_component", "export_type",
        "earliest_timestamp", "latest_timestamp", "earliest_manifest",
    ]
    return _top_ids(mismatched.where(F.lower("earliest_manifest") == side), columns, n, ordered)


def timestamps_earlier_in_export(mismatched: DataFrame, n: int = DEFAULT_TOP_IDS, ordered: bool = True) -> DataFrame:
    return _timestamps_earlier(mismatched, "export", n, ordered)


def timestamps_earlier_in_import(mismatched: DataFrame, n: int = DEFAULT_TOP_IDS, ordered: bool = True) -> DataFrame:
    return _timestamps_earlier(mismatched, "import", n, ordered)


def missing_exported_ids_after_date(missing_exports: DataFrame, after_ms: int) -> DataFrame:
    return missing_exports.where(F.col("import_timestamp") > after_ms)


def _type_tallies(missing: DataFrame, side: str, type_col: str) -> DataFrame:
    kind = F.lower(type_col)
    full = lambda name: f"mongo_{name}"
    tallies = [F.count("*").alias("all")]
    tallies += [F.count_if(kind == full(name)).alias(name) for name in NAMED_TYPES]
    # a NULL type is in the total only: it satisfies neither = nor <>
    tallies.append(F.count_if(~kind.isin([full(n) for n in NAMED_TYPES])).alias("other"))
    labels = [("all", f"Total missing {side}")]
    labels += [(n, f"Total missing {side} of type {n}") for n in (*NAMED_TYPES, "other")]
    pairs = ", ".join(f"'{label}', `{column}`" for column, label in labels)
    return missing.agg(*tallies).selectExpr(f"stack({len(labels)}, {pairs}) as (label, id_count)")


def _tally_names(side: str) -> list[tuple[str, str]]:
    """(column, label) of a side's tallies."""
    labels = [(f"{side}_all", f"Total missing {side}")]
    return labels + [(f"{side}_{n}", f"Total missing {side} of type {n}") for n in (*NAMED_TYPES, "other")]


def collection_type_counts(matched: DataFrame) -> DataFrame:
    """Missing ids by type, side and collection, from :func:`manifest.match_for_types`.

    The first of two levels: tasks leave one row per collection, so nothing record-sized
    leaves the match. A side's ids count as missing only where it holds some of the
    collection, which is known when its rows are added up.
    """
    tallies = [F.bool_or("imported").alias("has_imports"), F.bool_or("exported").alias("has_exports")]
    for side, absent, kind in (("imports", ~F.col("imported"), F.lower("export_type")), ("exports", ~F.col("exported"), F.lower("import_type"))):
        named = [f"mongo_{n}" for n in NAMED_TYPES]
        tallies.append(F.count_if(absent).alias(f"{side}_all"))
        tallies += [F.count_if(absent & (kind == full)).alias(f"{side}_{n}") for n, full in zip(NAMED_TYPES, named)]
        # a NULL type is in the total only: it satisfies neither = nor <>
        tallies.append(F.count_if(absent & ~kind.isin(named)).alias(f"{side}_other"))
    return matched.groupBy("database", "collection").agg(*tallies)


def _added_up(by_collection: DataFrame, *sides: str) -> DataFrame:
    """Labelled sums over the collections that a side holds some of."""
    names = [(side, *pair) for side in sides for pair in _tally_names(side)]
    sums = [F.coalesce(F.sum(F.when(F.col(f"has_{side}"), F.col(column))), F.lit(0)).alias(column) for side, column, _ in names]
    pairs = ", ".join(f"'{label}', `{column}`" for _, column, label in names)
    return by_collection.agg(*sums).selectExpr(f"stack({len(names)}, {pairs}) as (label, id_count)")


def type_totals(by_collection: DataFrame, ordered: bool = True) -> DataFrame:
    """Twelve labelled counts in one pass over the counts of all collections."""
    return _sorted(_added_up(by_collection, "imports", "exports"), ordered, "label", "id_count")


def type_totals_union(by_collection: DataFrame) -> DataFrame:
    """The same counts as a union of one labelled part per side."""
    parts = [_added_up(by_collection, side) for side in ("imports", "exports")]
    return parts[0].unionByName(parts[1]).orderBy("label", "id_count")


def individual_type_totals(
    missing_imports: DataFrame, missing_exports: DataFrame, ordered: bool = True
) -> DataFrame:
    """Twelve labelled counts; each side is scanned and aggregated once."""
    out = _type_tallies(missing_imports, "imports", "export_type").unionByName(
        _type_tallies(missing_exports, "exports", "import_type")
    )
    return _sorted(out, ordered, "label", "id_count")


def union_all_labelled(missing_imports: DataFrame, missing_exports: DataFrame) -> DataFrame:
    """Union of labelled counts, one label per type and side.

    All labels of a side come from one aggregate over one scan.
    """
    sides = [_type_tallies(missing_imports, "imports", "export_type"), _type_tallies(missing_exports, "exports", "import_type")]
    return sides[0].unionByName(sides[1]).orderBy("label", "id_count")


# --- catalogue and pack ---------------------------------------------------


@dataclass(frozen=True)
class Report:
    """Fixed metadata of one report, its builder and its row order."""

    query_type: str
    order: int
    name: str
    show_column_names: bool
    build: Callable[["Tables"], DataFrame]
    rank: str = "0"  # numeric expression that sorts before the text columns
    text_order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tables:
    """The four reconciled tables plus report parameters."""

    counts: DataFrame
    missing_imports: DataFrame
    missing_exports: DataFrame
    mismatched: DataFrame
    top_ids: int = DEFAULT_TOP_IDS
    after_ms: int = 0


_BY_COLLECTION = ("database", "collection")
_BY_ID = ("database", "collection", "id")

# Report names, types, order and header setting.
REPORTS = (
    Report("main", 1, "Missing exported databases", False, lambda t: missing_exported_databases(t.counts, False), text_order=("database",)),
    Report("main", 2, "Missing exported collections", False, lambda t: missing_exported_collections(t.counts, False), text_order=_BY_COLLECTION),
    Report("main", 3, "Export totals", True, lambda t: export_totals(t.counts)),
    Report("main", 4, "Import totals", True, lambda t: import_totals(t.counts)),
    Report("main", 5, "Missing exported totals", True, lambda t: missing_exported_totals(t.counts)),
    Report("main", 6, "Missing imported totals", True, lambda t: missing_imported_totals(t.counts)),
    Report("main", 7, "Missing exported id counts", True, lambda t: missing_exported_id_counts(t.counts, False), "-missing_exported_count", _BY_COLLECTION),
    Report("main", 8, "Mismatched timestamps count earlier in the export", True, lambda t: mismatched_earlier_in_export_count(t.counts, False), text_order=_BY_COLLECTION),
    Report("additional", 1, "Missing imported databases", False, lambda t: missing_imported_databases(t.counts, False), text_order=("database",)),
    Report("additional", 2, "Missing imported collections", False, lambda t: missing_imported_collections(t.counts, False), text_order=_BY_COLLECTION),
    Report("additional", 3, "Missing imported id counts", True, lambda t: missing_imported_id_counts(t.counts, False), "-missing_imported_count", _BY_COLLECTION),
    Report("additional", 4, "Missing imported ids", False, lambda t: missing_imported_ids(t.missing_imports, t.top_ids, False), text_order=_BY_ID),
    Report("additional", 5, "Mismatched timestamps count earlier in the import", True, lambda t: mismatched_earlier_in_import_count(t.counts, False), text_order=_BY_COLLECTION),
    Report("additional", 6, "Timestamps earlier in export", True, lambda t: timestamps_earlier_in_export(t.mismatched, t.top_ids, False), text_order=_BY_ID),
    Report("additional", 7, "Timestamps earlier in import", True, lambda t: timestamps_earlier_in_import(t.mismatched, t.top_ids, False), text_order=_BY_ID),
    Report("additional", 8, "Missing exported ids", False, lambda t: missing_exported_ids(t.missing_exports, t.top_ids, False), text_order=_BY_ID),
    Report("additional", 9, "Import totals by collection", True, lambda t: import_totals_by_collection(t.counts, False), text_order=_BY_COLLECTION),
    Report("additional", 10, "Export totals by collection", True, lambda t: export_totals_by_collection(t.counts, False), text_order=_BY_COLLECTION),
    Report("specific", 1, "Output missing exported ids after given timestamp", False, lambda t: missing_exported_ids_after_date(t.missing_exports, t.after_ms), text_order=_BY_ID),
    Report("specific", 6, "Individual types totals", False, lambda t: individual_type_totals(t.missing_imports, t.missing_exports, False), text_order=("label",)),
)


def row_as_json(df: DataFrame) -> Column:
    """Row as a JSON object of texts; a missing value is the text ``null``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in df.columns]
    return F.to_json(F.struct(*cells))


def row_as_text(df: DataFrame, show_column_names: bool) -> Column:
    """Row as ``col: value, …`` or ``value, …``; a missing value is ``null``."""
    cells = []
    for name in df.columns:
        value = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        cells.append(F.concat(F.lit(f"{name}: "), value) if show_column_names else value)
    return F.concat_ws(", ", *cells)


QUERY_TYPES = ("main", "additional", "specific")
LINE_KEYS = ("query_type", "query_order", "position")


def report_pack(tables: Tables, query_types: tuple[str, ...] = QUERY_TYPES) -> DataFrame:
    """All reports of the given types as one table with row numbers in report order.

    The table itself is in no order; writers sort by the numbers.
    Columns: ``query_type, query_order, query_name, row_no, row_json, row_text``.
    """
    parts = []
    for report in REPORTS:
        if report.query_type not in query_types:
            continue
        rows = report.build(tables)
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.text_order]
        parts.append(
            rows.select(
                F.lit(f"{report.query_type}-{report.order}").alias("report_key"),
                F.lit(report.query_type).alias("query_type"),
                F.lit(report.order).alias("query_order"),
                F.lit(report.name).alias("query_name"),
                F.expr(report.rank).cast("long").alias("rank_number"),
                F.array(*keys).cast("array<string>").alias("rank_text"),
                row_as_json(rows).alias("row_json"),
                row_as_text(rows, report.show_column_names).alias("row_text"),
            )
        )
    pack = parts[0]
    for part in parts[1:]:
        pack = pack.unionByName(part)
    # written before numbering, whose range sampling would else evaluate every report twice
    ranked = numbered(materialise(pack, "report-pack"), "report_key", ["rank_number", "rank_text", "row_json"])
    return ranked.select(
        "query_type", "query_order", "query_name", F.col("row_no").cast("long").alias("row_no"), "row_json", "row_text"
    )


def report_headers(spark, query_types: tuple[str, ...]) -> DataFrame:
    """Metadata of the reports (one row per report), marking the first of each type."""
    chosen = [r for r in REPORTS if r.query_type in query_types]
    firsts = {k: min(r.order for r in chosen if r.query_type == k) for k in query_types}
    return spark.createDataFrame(
        [(r.order, r.name, r.query_type, r.show_column_names, r.order == firsts[r.query_type]) for r in chosen],
        "query_order int, query_name string, query_type string, show_column_names boolean, first boolean",
    )


def _line(order, position, text) -> list[Column]:
    at = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        F.col("query_type"),
        at(order).cast("int").alias("query_order"),
        at(position).cast("long").alias("position"),
        at(text).alias("line"),
    ]


def report_json_lines(
    pack: DataFrame, executed_by: str, execution_time: str, query_types: tuple[str, ...] = QUERY_TYPES
) -> DataFrame:
    """One JSON document per query type, as ordered lines.

    Written in order, the lines of a type form
    ``{executed_by, execution_time, query_results: [{query_details, query_results: […]}]}``.
    Rows stay distributed: no report is ever gathered into a single value.
    """
    headers = report_headers(pack.sparkSession, query_types)
    types = headers.where("first")
    quoted = lambda value: json.dumps(value, ensure_ascii=False)
    opening = f'{{"executed_by":{quoted(executed_by)},"execution_time":{quoted(execution_time)},"query_results":['
    details = F.to_json(
        F.struct("query_name", "query_type", "show_column_names", F.col("query_order").alias("order"))
    )
    comma = F.when(F.col("first"), "").otherwise(",")
    order = F.col("query_order")
    lines = [
        types.select(*_line(0, 0, opening)),
        headers.select(
            *_line(order, 0, F.concat(comma, F.lit('{"query_details":'), details, F.lit(',"query_results":[')))
        ),
        pack.select(
            *_line(order, F.col("row_no"), F.concat(F.when(F.col("row_no") == 1, "").otherwise(","), "row_json"))
        ),
        headers.select(*_line(order, 1 << 62, "]}")),
        types.select(*_line((1 << 31) - 1, 0, "]}")),
    ]
    out = lines[0]
    for part in lines[1:]:
        out = out.unionByName(part)
    return out.orderBy(*LINE_KEYS)


def report_text_lines(pack: DataFrame, query_types: tuple[str, ...] = QUERY_TYPES) -> DataFrame:
    """Plain-text form: a name line per report followed by its ``-- `` rows."""
    order = F.col("query_order")
    names = report_headers(pack.sparkSession, query_types).select(
        *_line(order, 0, F.concat(F.lit("Name: "), "query_name"))
    )
    rows = pack.select(*_line(order, F.col("row_no"), F.concat(F.lit("\t-- "), "row_text")))
    return names.unionByName(rows).orderBy(*LINE_KEYS)
