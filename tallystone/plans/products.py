"""Claimant, product, quality and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates
from tallystone.operators import checks, claimants, products, versions
from tallystone.plans import bindings as b
from tallystone.plans.registry import query
from tallystone.session import materialise, scan_in_small_tasks, scratch_path
from tallystone.sources import readers

TODAY = 19990101
FROM_DATE, TO_DATE = 19980315, 19990630

CLAIM_SQL = f"""
with contract as (
  select o_orderkey, 'k-' || o_orderkey as cid, 'c-' || o_custkey as citizen,
    case when o_orderstatus = 'F' then cast(strftime(o_orderdate, '%Y%m%d') as integer) end as closed,
    case when o_orderkey % 10 = 0 then cast(strftime(o_orderdate, '%Y%m%d') as integer) end as suspended,
    date_trunc('month', o_orderdate) as month from orders),
open_contract as (select * from contract where closed is null or closed >= {TODAY}),
award as (
  select c.cid, c.citizen, c.suspended, 'ap-' || l_orderkey || '-' || l_linenumber as period,
    cast(strftime(c.month + to_months(cast(l_linenumber - 1 as integer)), '%Y%m%d') as integer) as start_date,
    cast(strftime(last_day(c.month + to_months(cast(l_linenumber - 1 as integer))), '%Y%m%d') as integer) as end_date,
    cast(cast(l_extendedprice as decimal(18,2)) as varchar) as pay
  from open_contract c left join lineitem on l_orderkey = o_orderkey),
joined as (
  select 'c-' || c_custkey as "citizenId", c_name as nino, a.cid is not null as found, a.cid as "contractId",
    a.suspended as "suspendedDate", a.period as "assessmentPeriodId",
    case when a.period is not null then a.start_date end as "startDate",
    case when a.period is not null then a.end_date end as "endDate", a.pay as "takeHomePay"
  from customer left join award a on a.citizen = 'c-' || c_custkey)
"""


def _docs(spark, sf_dir):
    return b.claimants(spark, sf_dir), b.contracts(spark, sf_dir), b.statements(spark, sf_dir)


@query("claimant_award_join", CLAIM_SQL + "select * from joined")
def _(spark, sf_dir):
    return claimants.claimant_award_join(*_docs(spark, sf_dir), F.lit(TODAY))


@query(
    "claimant_date_query",
    CLAIM_SQL + f"""select * from joined where "startDate" >= {FROM_DATE} and "endDate" <= {TO_DATE}""",
)
def _(spark, sf_dir):
    return claimants.claimant_awards_between(*_docs(spark, sf_dir), F.lit(TODAY), F.lit(FROM_DATE), F.lit(TO_DATE))


@query(
    "claimant_status",
    CLAIM_SQL
    + """select 'c-' || c_custkey as "citizenId", c_name as nino, count(o.cid) > 0 as found,
           count(o.suspended) > 0 as suspended
         from customer left join open_contract o on o.citizen = 'c-' || c_custkey group by c_custkey, c_name""",
)
def _(spark, sf_dir):
    c, k, _s = _docs(spark, sf_dir)
    return claimants.claimant_status(c, k, F.lit(TODAY))


# --- products -------------------------------------------------------------


def _obligations(spark, sf_dir):
    """Obligation documents: 0-3 easements and 0-2 referrals per order."""
    k = F.col("o_orderkey")
    items = lambda n, word: F.transform(
        F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n.cast("int")),
        lambda i: F.concat(F.lit(word), i.cast("string")),
    )
    stamp = F.concat(F.date_format("o_orderdate", dates.MILLIS_PATTERN), F.lit("Z"))
    return b.table(spark, sf_dir, "orders").select(
        F.struct(F.concat(F.lit("y-"), k).alias("youthObligationDetailsId")).alias("_id"),
        F.concat(F.lit("c-"), F.col("o_custkey")).alias("claimantId"),
        F.col("o_orderstatus").alias("youthObligationStatus"),
        items(k % 3, "r").alias("youthObligationReferrals"),
        items(k % 4, "e").alias("youthObligationEasements"),
        (F.lit(20170000) + k % 1400).cast("int").alias("statusLastChangedDate"),
        F.struct(stamp.alias("d_date")).alias("_lastModifiedDateTime"),
    )


@query(
    "product_obligation_flatten",
    """with o as (select *, try_strptime(cast(20170000 + o_orderkey % 1400 as varchar), '%Y%m%d') as changed from orders),
       e as (select *, unnest(case when o_orderkey % 4 = 0 then [null] else list_transform(range(1, o_orderkey % 4 + 1), lambda i: 'e' || i) end) as easement from o)
       select 'y-' || o_orderkey as obligation_id, 'c-' || o_custkey as claimant_id, cast(changed as date) as status_last_changed_date,
         changed as status_last_changed_ts, o_orderstatus as status, cast(o_orderdate as date) as last_modified_date,
         o_orderdate as last_modified_ts, easement,
         unnest(case when o_orderkey % 3 = 0 then [null] else list_transform(range(1, o_orderkey % 3 + 1), lambda i: 'r' || i) end) as referral
       from e""",
)
def _(spark, sf_dir):
    return products.obligation_flatten(_obligations(spark, sf_dir))


def _statement_versions(spark, sf_dir):
    """Every line item as a version of the statement of its order."""
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s-"), F.col("l_orderkey")).alias("id"),
        F.unix_millis("l_shipdate").alias("version"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("sequence"),
        F.struct(
            F.concat_ws("-", F.lit("ap"), "l_orderkey", "l_linenumber").alias("assessmentPeriodId"),
            F.concat(F.lit("k-"), F.col("l_orderkey")).alias("contractId"),
            dates.date_to_int(month).alias("startDate"),
            dates.date_to_int(F.last_day(month)).alias("endDate"),
        ).alias("assessmentPeriod"),
        *[(F.col("l_extendedprice") + i).cast("decimal(18,2)").cast("string").alias(c) for i, c in enumerate(products.STATEMENT_AMOUNTS)],
    )


_AMOUNT_NAMES = ", ".join(c.lower() for c in products.STATEMENT_AMOUNTS)
_AMOUNT_SQL = ", ".join(f"cast(cast(l_extendedprice + {i} as decimal(18,2)) as varchar) as {c.lower()}" for i, c in enumerate(products.STATEMENT_AMOUNTS))


@query(
    "product_statement_fact",
    f"""select * exclude rn from (select statement_id, contract_id, assessment_period_id, {_AMOUNT_NAMES}, period_start, period_end, version,
         last_modified_ts, last_modified_date, latest_marker, rn from (
         select 's-' || l_orderkey as statement_id, 'k-' || l_orderkey as contract_id,
           'ap-' || l_orderkey || '-' || l_linenumber as assessment_period_id,
           {_AMOUNT_SQL},
           cast(date_trunc('month', l_shipdate) as date) as period_start, last_day(l_shipdate) as period_end,
           epoch_us(l_shipdate) // 1000 as version, l_shipdate as last_modified_ts, cast(l_shipdate as date) as last_modified_date,
           'LATEST' as latest_marker,
           row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn
         from lineitem)) where rn = 1""",
)
def _(spark, sf_dir):
    scan_in_small_tasks(spark)  # a line of some 20 bytes becomes a statement of some 400
    return products.statement_fact(_statement_versions(spark, sf_dir))


@query(
    "message_version_filter",
    """select 's-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as statement_id,
         'MAKE_A_DECISION_MANDATORY_RECONSIDERATION' as reason,
         '{"_id":{"statementId":"s-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey ||
         '"},"assessmentPeriod":{"assessmentPeriodId":"ap-' || l_orderkey || '-' || l_linenumber || '","contractId":"k-' || l_orderkey ||
         '"},"takeHomePay":"' || cast(cast(l_extendedprice as decimal(18,2)) as varchar) || '","type":"MANDATORY_RECONSIDERATION","lastModified":' ||
         (epoch_us(l_shipdate) // 1000) || ',"version":' || cast(l_quantity as integer) || '}' as raw_json
       from lineitem where l_returnflag = 'R'""",
)
def _(spark, sf_dir):
    s = b.statements(spark, sf_dir)
    return products.message_version_filter(
        s, F.to_json(F.struct(*s.columns)), F.col("_id.statementId")
    )


@query(
    "product_contract",
    """select 'k-' || o_orderkey as contract_id, date_trunc('day', o_orderdate) as declared_date, date_trunc('day', o_orderdate) as start_date,
         case when o_orderstatus = 'F' then date_trunc('day', o_orderdate) end as closed_date,
         '{"citizenid":"c-' || o_custkey || '","middlename":"null","note":"Key: ' || o_orderpriority || '","dateofbirth":{"cryptoid":"' || o_orderkey || '-' || i || '"}}' as person
       from (select *, unnest(range(1, 2 + o_orderkey % 2)) as i from orders)
       union all select 'k-none-' || o_orderkey, date_trunc('day', o_orderdate), date_trunc('day', o_orderdate),
         case when o_orderstatus = 'F' then date_trunc('day', o_orderdate) end, null from orders where o_orderkey % 10 = 1""",
)
def _(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    day = dates.date_to_int(F.col("o_orderdate").cast("date"))
    person = lambda i: F.concat(
        F.lit('{"citizenId":"c-'), F.col("o_custkey"), F.lit('","middleName":null,"note":"Key: '),
        F.col("o_orderpriority"), F.lit('","dateOfBirth":{"cryptoId":"'), F.col("o_orderkey"), F.lit(f'-{i}"}}}}'),
    )
    # a JSON array of one or two people
    people = F.concat(F.lit("["), person(1), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit(","), person(2))).otherwise(""), F.lit("]"))
    docs = o.select(
        F.struct(F.concat(F.lit("k-"), F.col("o_orderkey")).alias("contractId")).alias("_id"),
        day.alias("declaredDate"),
        day.alias("startDate"),
        F.when(F.col("o_orderstatus") == "F", day).alias("closedDate"),
        people.alias("people_json"),
    )
    # a contract without people keeps its row
    lonely = o.where("o_orderkey % 10 = 1").select(
        F.struct(F.concat(F.lit("k-none-"), F.col("o_orderkey")).alias("contractId")).alias("_id"), day.alias("declaredDate"),
        day.alias("startDate"), F.when(F.col("o_orderstatus") == "F", day).alias("closedDate"), F.lit("[]").alias("people_json"),
    )
    docs = docs.unionByName(lonely)
    return products.product_contract(docs, F.col("people_json"))


@query(
    "product_raw_json_dated",
    "select props as val, cast(ts as date) as export_date from events",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    path = scratch_path(spark, "raw-json")
    dated = e.select(F.col("props").alias("value"), F.col("ts").cast("date").alias("day"))
    dated.write.partitionBy("day").option("compression", "gzip").text(path)
    lines = spark.read.schema("value string, day date").text(path)
    return products.raw_json_dated(lines, F.col("day"))


@query(
    "product_analytical_dataset",
    """select 'db_' || lower(o_orderstatus) as database, o_orderpriority as collection,
         case when o_orderstatus = 'F' then 'true' else '' end as pii, 'full' as snapshot_type, count(*) as records
       from orders group by 1, 2, 3""",
)
def _(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    pair = [F.concat(F.lit("db_"), F.lower("o_orderstatus")).alias("database"), F.col("o_orderpriority").alias("collection")]
    recs = o.select(*pair, F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value"))
    pii = o.where("o_orderstatus = 'F'").select(*pair).distinct().withColumn("pii", F.lit("true"))
    path = scratch_path(spark, "analytical")
    tagged = products.analytical_dataset(recs, pii, "full")
    flat = tagged.select(
        "value", F.to_json("tags").alias("tags"), F.col("database").alias("db"), F.col("collection").alias("coll")
    )
    flat.write.partitionBy("db", "coll").option("compression", "gzip").parquet(path)
    back = spark.read.schema("value string, tags string, db string, coll string").parquet(path)
    tag = lambda n: F.get_json_object("tags", f"$.{n}")
    return back.groupBy(
        F.col("db").alias("database"), F.col("coll").alias("collection"), tag("pii").alias("pii"),
        tag("snapshot_type").alias("snapshot_type"),
    ).agg(F.count("*").alias("records"))


# --- quality --------------------------------------------------------------

PART_COLUMNS = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_size": "int"}


def _csv_lines(spark, sf_dir):
    """CSV lines in files by brand: one short row per hundred, one brand with a wrong header."""
    p = b.table(spark, sf_dir, "part")
    cells = F.when(
        F.col("p_partkey") % 100 == 7, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand")
    ).otherwise(
        F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string"))
    )
    rows = p.select(F.col("p_brand").alias("brand"), (F.col("p_partkey") + 2).alias("line_no"), cells.alias("value"))
    headers = p.select(F.col("p_brand").alias("brand")).distinct().select(
        "brand",
        F.lit(1).cast("long").alias("line_no"),
        F.when(F.col("brand") == "Brand#3", "p_partkey,p_title,p_brand,p_size").otherwise(",".join(PART_COLUMNS)).alias("value"),
    )
    path = scratch_path(spark, "csv")
    # one file per brand, as such deliveries come, with its header first
    files = rows.unionByName(headers).repartition("brand").sortWithinPartitions("brand", "line_no")
    files.select("brand", "value").write.partitionBy("brand").text(path)
    # folder names are escaped once by the writer and once in the file's URI
    return readers.csv_lines(spark, path).withColumn("file", F.url_decode(F.url_decode(F.regexp_extract("file", "brand=([^/]*)", 1))))


@query(
    "csv_schema_gate",
    """select p_brand as file, count(*) as rows, cast(case when p_brand = 'Brand#3' then 1 else 0 end as bigint) as bad_headers,
         count(*) filter (p_partkey % 100 = 7) as short_rows, cast(0 as bigint) as long_rows,
         p_brand <> 'Brand#3' and count(*) filter (p_partkey % 100 = 7) = 0 as accepted
       from part group by p_brand""",
)
def _(spark, sf_dir):
    return checks.csv_violations(_csv_lines(spark, sf_dir), PART_COLUMNS)


@query(
    "table_shape_check",
    """select count(*) as actual_rows, count(*) as expected_rows, cast(5 as integer) as actual_columns,
         cast(5 as integer) as expected_columns, true as passed from part
       union all select count(*) filter (p_partkey % 100 <> 7), count(*), 4, 5, false from part""",
)
def _(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select(*PART_COLUMNS)
    path = scratch_path(spark, "loaded")
    p.withColumn("load_date", F.lit("2024-01-01")).write.partitionBy("load_date").parquet(path)
    loaded = spark.read.parquet(path)
    # a load that lost a column and some rows
    damaged = loaded.where("p_partkey % 100 <> 7").drop("p_brand")
    expected = p.agg(F.count("*").alias("expected"))
    return checks.table_shape_check(loaded, list(PART_COLUMNS), expected).unionByName(checks.table_shape_check(damaged, list(PART_COLUMNS), expected))


def _statuses(spark, sf_dir):
    """Export status rows: one correlation per customer, one collection per order priority."""
    return b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("corr-"), F.col("o_custkey")).alias("correlation_id"),
        F.col("o_orderpriority").alias("collection"),
        F.col("o_orderkey").alias("sequence"),
        F.when(F.col("o_orderstatus") == "F", "Exporting").when(F.col("o_orderstatus") == "O", "Sent").otherwise("Received").alias("status"),
        (F.col("o_orderkey") % 5).alias("files_exported"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("export_date"),
    )


STATUS_SQL = """
with s as (select 'corr-' || o_custkey as correlation_id, o_orderpriority as collection, o_orderkey as sequence,
    case o_orderstatus when 'F' then 'Exporting' when 'O' then 'Sent' else 'Received' end as status,
    o_orderkey % 5 as files_exported, strftime(o_orderdate, '%Y-%m-%d') as export_date from orders),
latest as (select * exclude rn from (select *, row_number() over (partition by correlation_id, collection order by sequence desc) rn from s) where rn = 1)
"""


def _status_table(spark, sf_dir):
    s = _statuses(spark, sf_dir)
    early, late = s.where("export_date < '1998-01-01'"), s.where("export_date >= '1998-01-01'")
    return checks.status_upsert(early, late, ["correlation_id", "collection"], "sequence")


@query("export_status_upsert", STATUS_SQL + "select * from latest")
def _(spark, sf_dir):
    return _status_table(spark, sf_dir)


@query(
    "status_all_in",
    STATUS_SQL
    + """, wanted as (select distinct s.correlation_id, p.collection from s, (select distinct collection from s) p where p.collection in ('1-URGENT', '2-HIGH'))
         select w.correlation_id, count(*) as topics, count(*) filter (coalesce(l.status in ('Sent', 'Received'), false)) as matched,
           bool_and(coalesce(l.status in ('Sent', 'Received'), false)) as all_matched
         from wanted w left join latest l using (correlation_id, collection) group by 1""",
)
def _(spark, sf_dir):
    table = _status_table(spark, sf_dir)
    topics = table.select("correlation_id").distinct().select(
        "correlation_id", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("collection")
    )
    return checks.status_all_in(table, topics, ["Sent", "Received"])


@query(
    "latest_prior_snapshot",
    """select 'product-' || o_custkey % 50 as data_product,
         coalesce(max(case when o_orderstatus = 'F' and o_orderkey % 5 <> 0 then [strftime(o_orderdate, '%Y-%m-%d'), 'exports/' || lpad(cast(o_orderkey as varchar), 9, '0')] end)[2], 'exports/default') as prefix
       from orders group by 1""",
)
def _(spark, sf_dir):
    runs = b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("product-"), F.col("o_custkey") % 50).alias("data_product"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("exports/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).alias("prefix"),
    )
    return versions.latest_prior_snapshot(runs, "exports/default")


@query(
    "bookmark_next_files",
    """with f as (select 'feed-' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' as file, o_orderkey from orders)
       select o_orderkey, file, (select max(file) from f) as next_bookmark from f where file > 'feed-1998-06-30.csv'""",
)
def _(spark, sf_dir):
    files = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("feed-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv")).alias("file")
    )
    bookmark = "feed-1998-06-30.csv"
    todo = versions.bookmark_next_files(files, bookmark)
    moved = versions.next_bookmark(todo, bookmark).select(F.lit(1).alias("one"), F.col("bookmark").alias("next_bookmark"))
    # the new bookmark is exactly one row: an aggregate without grouping
    return todo.withColumn("one", F.lit(1)).join(F.broadcast(moved), "one").drop("one")


@query(
    "run_metadata_check",
    """select o_orderkey, o_orderkey % 3 = 1 as is_first_run, cast(o_orderdate as date) = date '1998-10-03' as is_today,
         o_orderpriority in ('1-URGENT', '2-HIGH') as step_allowed, o_orderstatus = 'F' as type_matches,
         o_orderkey % 3 = 1 and cast(o_orderdate as date) = date '1998-10-03' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F' as passed
       from orders""",
)
def _(spark, sf_dir):
    runs = b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 3).alias("run_id"),
        F.col("o_orderdate").cast("date").alias("run_date"),
        F.col("o_orderpriority").alias("current_step"),
        F.when(F.col("o_orderstatus") == "F", "FULL").otherwise("incremental").alias("snapshot_type"),
    )
    checked = checks.run_metadata_check(runs, F.lit("1998-10-03").cast("date"), ["1-URGENT", "2-HIGH"], "full")
    return checked.drop("run_id", "run_date", "current_step", "snapshot_type")


@query(
    "file_count_check",
    """with f as (select event_type as topic, count(distinct user_id % 5) as n from events group by 1)
       select topic, n as files, cast(5 + length(topic) % 2 as bigint) as wanted, n = 5 + length(topic) % 2 as passed from f""",
)
def _(spark, sf_dir):
    # one file per event type and fifth of the users; topics with a name of odd length lack one
    path = scratch_path(spark, "exports")
    e = b.table(spark, sf_dir, "events").select("event_id", "props", F.col("event_type").alias("topic"), (F.col("user_id") % 5).alias("part"))
    e.repartition("topic", "part").write.partitionBy("topic", "part").parquet(path)
    listed = readers.file_listing(spark, path, r".*/topic=[^/]+/part=\d/part-[^/]+\.parquet")
    files = listed.select(F.regexp_extract("path", "/topic=([^/]+)/", 1).alias("topic"))
    wanted = e.select("topic").distinct().withColumn("wanted", (5 + F.length("topic") % 2).cast("long"))
    return checks.file_count_check(files, wanted)
