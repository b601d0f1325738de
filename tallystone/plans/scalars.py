"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates, payload, secrets, tags, topics
from tallystone.operators import compare, ranking, routing
from tallystone.plans import bindings as b
from tallystone.plans.recon import BASE_SQL, counts_table
from tallystone.plans.registry import query


def _topics(spark, sf_dir):
    """Topic texts of several shapes, one per event."""
    e = b.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    name = F.col("event_type")
    return e.select(
        "event_id",
        F.when(kind == 0, F.concat(F.lit("db.core."), name))
        .when(kind == 1, F.concat(F.lit("data."), name))
        .when(kind == 2, name)
        .when(kind == 3, F.concat(F.lit("agent-core."), name, F.lit("|2024")))
        .when(kind == 4, F.concat(F.lit("db."), name))
        .otherwise(F.concat(F.lit("ns."), name, F.lit(".x.y")))
        .alias("topic"),
    )


TOPIC_SQL = """
with t as (select event_id, case event_id % 6 when 0 then 'db.core.' || event_type when 1 then 'data.' || event_type
     when 2 then event_type when 3 then 'agent-core.' || event_type || '|2024' when 4 then 'db.' || event_type
     else 'ns.' || event_type || '.x.y' end as topic from events),
s as (select *, case when starts_with(topic, 'db.') then topic[4:] else topic end as short from t)
"""


@query(
    "topic_to_db_collection",
    TOPIC_SQL
    + """select event_id, case when contains(short, '.') then split_part(short, '.', 1) end as database,
         case when contains(short, '.') then split_part(short, '.', 2) else short end as collection from s""",
)
def _(spark, sf_dir):
    t = F.col("topic")
    return _topics(spark, sf_dir).select(
        "event_id", topics.topic_database(t).alias("database"), topics.topic_collection(t).alias("collection")
    )


@query(
    "qualify_topic",
    TOPIC_SQL
    + """select event_id, case when topic like 'db.%' or topic like 'data.%' then split_part(topic, '|', 1)
         else 'db.' || split_part(topic, '|', 1) end as topic from s""",
)
def _(spark, sf_dir):
    return _topics(spark, sf_dir).select("event_id", topics.qualify_topic(F.col("topic")).alias("topic"))


@query(
    "topic_to_table_name",
    TOPIC_SQL
    + r"""select event_id, case when regexp_matches(topic, '^(?:\w*\.)?([-\w]+)\.([-\w]+)$')
          then regexp_replace(topic, '^(?:\w*\.)?([-\w]+)\.([-\w]+)$', '\1:\2') end as table_name from s""",
)
def _(spark, sf_dir):
    return _topics(spark, sf_dir).select("event_id", topics.topic_to_table_name(F.col("topic")).alias("table_name"))


@query(
    "file_name_to_topic",
    """select distinct 'db.' || lower(o_orderstatus) || '-db.' || replace(o_orderpriority, ' ', '_') as topic from orders
       where o_orderkey % 4 <> 0""",
)
def _(spark, sf_dir):
    # every fourth file has an extension that must not be taken for a data file
    files = b.table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("raw/2024/"), F.lower("o_orderstatus"), F.lit("-db."),
            F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")), F.lit("."), F.col("o_orderkey"),
            F.when(F.col("o_orderkey") % 4 == 0, ".json").otherwise(".json.gz"),
        ).alias("path")
    )
    return topics.topics_of_files(files)


def _stamped(spark, sf_dir):
    """Event times as ISO text with each accepted suffix."""
    e = b.table(spark, sf_dir, "events")
    suffix = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+0000").otherwise("")
    return e.select("event_id", "ts", F.concat(F.date_format("ts", dates.MILLIS_PATTERN), suffix).alias("text"))


@query(
    "iso_to_epoch_ms",
    """select event_id, epoch_us(ts) // 1000 as millis,
         epoch_us(ts) // 1000 + 60000 * greatest(event_id % 5 - 1, 0) as later from events""",
)
def _(spark, sf_dir):
    return _stamped(spark, sf_dir).select(
        "event_id",
        dates.iso_to_millis(F.col("text")).alias("millis"),
        dates.iso_to_millis(F.col("text"), F.col("event_id") % 5 - 1).alias("later"),
    )


@query(
    "add_millis_format",
    """select event_id, strftime(ts + to_milliseconds(event_id), '%Y-%m-%dT%H:%M:%S.%g') || '+0000' as with_offset,
         strftime(ts + to_milliseconds(event_id), '%Y-%m-%dT%H:%M:%S.%g') as plain from events""",
)
def _(spark, sf_dir):
    ts, n = F.col("ts"), F.col("event_id")
    return b.table(spark, sf_dir, "events").select(
        "event_id", dates.add_millis(ts, n).alias("with_offset"), dates.add_millis(ts, n, False).alias("plain")
    )


@query("to_zulu", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as zulu from events")
def _(spark, sf_dir):
    return _stamped(spark, sf_dir).select("event_id", dates.to_zulu(F.col("text")).alias("zulu"))


@query(
    "offset_date",
    """with o as (select o_orderkey, cast(o_orderdate as date) + cast(o_orderkey % 41 - 20 as integer) as d,
                    cast(o_orderkey % 13 - 6 as integer) as m from orders)
       select o_orderkey, cast(strftime(d + to_months(m), '%Y%m%d') as integer) as shifted from o""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    shifted = dates.offset_date(
        F.col("o_orderdate").cast("date"), (k % 41 - 20).cast("int"), (k % 13 - 6).cast("int")
    )
    return b.table(spark, sf_dir, "orders").select("o_orderkey", dates.date_to_int(shifted).alias("shifted"))


@query(
    "int_date_parse",
    """with p as (select p_partkey, cast(20170000 + p_partkey % 1400 as integer) as v from part)
       select p_partkey, cast(try_strptime(cast(v as varchar), '%Y%m%d') as date) as day,
         try_strptime(cast(v as varchar), '%Y%m%d') as at from p""",
)
def _(spark, sf_dir):
    day = dates.int_to_date((F.lit(20170000) + F.col("p_partkey") % 1400).cast("int"))
    return b.table(spark, sf_dir, "part").select("p_partkey", day.alias("day"), day.cast("timestamp").alias("at"))


def _documents_as_json(spark, sf_dir):
    """The same document in two key orders."""
    inner = [F.col("o_orderpriority").alias("b"), F.col("o_custkey").alias("a")]
    outer = lambda fields: [F.col("o_orderstatus").alias("z"), F.struct(*fields).alias("m")]
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_json(F.struct(*outer(inner))).alias("value"),
        F.to_json(F.struct(*outer(inner[::-1])[::-1])).alias("flipped"),
    )


@query(
    "canonical_json",
    """select o_orderkey, '{"m":{"a":' || o_custkey || ',"b":"' || o_orderpriority || '"},"z":"' || o_orderstatus || '"}' as value,
         true as same_when_flipped from orders""",
)
def _(spark, sf_dir):
    value = payload.canonical_json(F.col("value"))
    return _documents_as_json(spark, sf_dir).select(
        "o_orderkey",
        value.alias("value"),
        (value == payload.canonical_json(F.col("flipped"))).alias("same_when_flipped"),
    )


@query(
    "json_sort_lines",
    """select '{"m":{"a":' || o_custkey || ',"b":"' || o_orderpriority || '"},"z":"' || o_orderstatus || '"}' as value from orders""",
)
def _(spark, sf_dir):
    return compare.json_sort_lines(_documents_as_json(spark, sf_dir).select("value"))


@query(
    "strip_whitespace",
    "select doc_id, md5(translate(text, chr(10) || chr(13) || chr(9) || ' ', '')) as digest from documents",
)
def _(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(payload.strip_whitespace(F.col("text"))).alias("digest")
    )


@query(
    "hash_identifier",
    """select c_mktsegment, count(*) as customers, count(distinct c_name) as different, true as well_formed, false as salt_ignored
       from (select c_mktsegment, c_name from customer union all select c_mktsegment, c_name from customer) group by 1""",
)
def _(spark, sf_dir):
    # every name twice: equal names must give equal hashes and different ones different hashes
    c = b.table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    hashed = c.unionByName(c).select(
        "c_mktsegment", secrets.hash_identifier(F.col("c_name"), "salt").alias("h"), secrets.hash_identifier(F.col("c_name"), "other").alias("o")
    )
    return hashed.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"),
        F.count_distinct("h").alias("different"),
        F.bool_and(F.col("h").rlike("^[A-Za-z0-9_-]{86}==$")).alias("well_formed"),
        F.bool_or(F.col("h") == F.col("o")).alias("salt_ignored"),
    )


@query(
    "decrypt_amount",
    "select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) as varchar) as amount from lineitem",
)
def _(spark, sf_dir):
    key = F.lit(b.AMOUNT_KEY)
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    sealed = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", secrets.encrypt_amount(amount, key).alias("sealed")
    )
    return sealed.select("l_orderkey", "l_linenumber", secrets.decrypt_amount(F.col("sealed"), key).alias("amount"))


@query(
    "gen_national_id",
    "select c_custkey, true as well_formed from customer",
)
def _(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select("c_custkey", secrets.national_id(F.col("c_custkey")).alias("n"))
    shape = f"^[{secrets.NATIONAL_ID_PREFIX}]{{2}}[0-9]{{6}}[{secrets.NATIONAL_ID_SUFFIX}]$"
    return c.select("c_custkey", F.col("n").rlike(shape).alias("well_formed"))


@query(
    "tags_subset",
    """select o_orderkey, (o_orderkey % 3 = 0 and o_orderstatus = 'F') or o_orderkey % 3 = 1 as subset from orders""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    have = F.create_map(F.lit("db"), F.lit("core"), F.lit("status"), F.col("o_orderstatus"))
    want = (
        F.when(k == 0, F.create_map(F.lit("status"), F.lit("F")))
        .when(k == 1, F.create_map(F.lit("db"), F.lit("core")))
        .otherwise(F.create_map(F.lit("other"), F.lit("x")))
    )
    return b.table(spark, sf_dir, "orders").select("o_orderkey", tags.tags_subset(want, have).alias("subset"))


# --- paths and tags -------------------------------------------------------


def _paths(spark, sf_dir):
    """Object paths naming a region as database and a nation as table, in several depths."""
    e = b.table(spark, sf_dir, "events")
    n = b.table(spark, sf_dir, "nation").join(
        b.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    keyed = e.join(n, F.col("user_id") % 30 == F.col("n_nationkey"), "left")
    db = F.coalesce("r_name", F.lit("NOWHERE"))
    leaf = F.when(F.col("event_id") % 4 == 0, F.lit("UNLISTED")).otherwise(F.coalesce("n_name", F.lit("NONE")))
    file = F.concat(F.lit("part-"), F.col("event_id"))
    kind = F.col("event_id") % 3
    return keyed.select(
        F.when(kind == 0, F.concat(F.lit("base/"), db, F.lit(".db/"), leaf, F.lit("/"), file))
        .when(kind == 1, F.concat(F.lit("base/"), db, F.lit("/"), leaf, F.lit("/day=1/"), file))
        .otherwise(F.concat(F.lit("base/"), db, F.lit(".db/"), leaf, F.lit("_$folder$/"), file))
        .alias("path")
    )


PATH_SQL = """
with keyed as (
  select event_id, coalesce(r_name, 'NOWHERE') as db, case when event_id % 4 = 0 then 'UNLISTED' else coalesce(n_name, 'NONE') end as leaf,
    r_name is not null as known, n_nationkey
  from events left join (nation join region on n_regionkey = r_regionkey) on user_id % 30 = n_nationkey),
p as (
  select *, case event_id % 3 when 0 then 'base/' || db || '.db/' || leaf || '/part-' || event_id
    when 1 then 'base/' || db || '/' || leaf || '/day=1/part-' || event_id
    else 'base/' || db || '.db/' || leaf || '_$folder$/part-' || event_id end as path,
    leaf || case when event_id % 3 = 2 then '_$folder$' else '' end as named
  from keyed)
"""


def _located(spark, sf_dir):
    regions = b.table(spark, sf_dir, "region").select(F.col("r_name").alias("db"))
    return routing.path_to_db_table(_paths(spark, sf_dir), regions)


@query(
    "path_to_db_table",
    PATH_SQL + """select path, case when known then db end as db, case when known then named end as "table" from p""",
)
def _(spark, sf_dir):
    return _located(spark, sf_dir)


@query(
    "tag_classification_join",
    PATH_SQL
    + """select path, case when known then db end as tag_db, case when known then named end as tag_table,
         case when known then case when leaf in ('UNLISTED', 'NONE') or event_id % 3 = 2 then ''
              else cast(n_nationkey % 2 = 0 as varchar) end end as tag_pii from p""",
)
def _(spark, sf_dir):
    classification = (
        b.table(spark, sf_dir, "nation")
        .join(b.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("db"),
            F.col("n_name").alias("table"),
            (F.col("n_nationkey") % 2 == 0).cast("string").alias("pii"),
        )
    )
    tagged = routing.tag_classification_join(_located(spark, sf_dir), classification)
    tag = lambda name: F.try_element_at("tags", F.lit(name)).alias(f"tag_{name}")
    return tagged.select("path", tag("db"), tag("table"), tag("pii"))


# --- payload edits --------------------------------------------------------


def _nested(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    deep = F.struct(F.col("o_orderstatus").alias("secret"), F.col("o_custkey").alias("v"))
    mid = F.struct(F.col("o_orderpriority").alias("secret"), deep.alias("deep"), F.col("o_custkey").alias("w"))
    return o.select("o_orderkey", F.struct(F.lit("x").alias("secret"), mid.alias("mid")).alias("doc"))


@query(
    "drop_key_recursive",
    """select o_orderkey, '{"mid":{"deep":{"v":' || o_custkey || '},"w":' || o_custkey || '}}' as typed,
         '{"mid":{"deep":{"v":' || o_custkey || '},"w":' || o_custkey || '}}' as untyped from orders""",
)
def _(spark, sf_dir):
    docs = _nested(spark, sf_dir).withColumn("text", F.to_json("doc"))
    dropped = payload.drop_key(docs, "doc", "secret")
    return dropped.select(
        "o_orderkey",
        F.to_json("doc").alias("typed"),
        payload.json_drop_key(F.col("text"), "secret").alias("untyped"),
    )


@query(
    "replace_value_recursive",
    """select o_orderkey, '{"secret":"-","mid":{"secret":"-","deep":{"secret":"-","v":' || o_custkey || '},"w":' || o_custkey || '}}' as typed,
         '{"secret":"-","mid":{"secret":"-","deep":{"secret":"-","v":' || o_custkey || '},"w":' || o_custkey || '}}' as untyped from orders""",
)
def _(spark, sf_dir):
    docs = _nested(spark, sf_dir).withColumn("text", F.to_json("doc"))
    replaced = payload.replace_value(docs, "doc", "secret", F.lit("-"))
    return replaced.select(
        "o_orderkey",
        F.to_json("doc").alias("typed"),
        payload.json_replace_value(F.col("text"), "secret", "-").alias("untyped"),
    )


# --- topic selection, routing, ordering -----------------------------------


@query(
    "topic_selection",
    """select -event_id as request_id, 'db.' || event_type || '.' || (event_id % 10) as topic from events
       where (event_type, event_id % 10) in (select (event_type, event_id % 10) from events where event_id % 5 = 1)
       union all select event_id as request_id, unnest(case event_id % 5
         when 0 then ['db.a.x', 'db.a.y'] when 1 then ['db.' || event_type || '.' || (event_id % 10)]
         when 2 then case when user_id % 2 = 0 then ['i1', 'i2'] else ['f1', 'f2', 'f3'] end
         when 3 then ['d1'] else ['fallback.' || event_type] end) as topic from events""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    text = lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]).cast("array<string>")
    own = F.concat(F.lit("db."), F.col("event_type"), F.lit("."), (F.col("event_id") % 10).cast("string"))
    requests = e.select(
        F.col("event_id").alias("request_id"),
        F.when(kind == 0, text("", "db.a.x,db.a.y", "z"))
        .when(kind == 1, text(F.lit(None), own))
        .when(kind == 2, text("ALL"))
        .when(kind == 3, text("", "all"))
        .when(kind == 4, text(""))
        .alias("overrides"),
        F.when(kind == 3, "drift_testing_incremental")
        .when(F.col("user_id") % 2 == 0, "incremental")
        .otherwise("full")
        .alias("snapshot_type"),
        text(F.concat(F.lit("fallback."), F.col("event_type"))).alias("fallback"),
    )
    chosen = routing.topic_selection(requests, "f1,f2,f3", "i1,i2", "d1")
    # and the messages of the chosen topics, under their negative number
    messages = e.select((-F.col("event_id")).alias("request_id"), own.alias("topic"))
    return chosen.unionByName(routing.select_by_topic(messages, chosen))


@query(
    "destination_routing",
    """with p as (select p_partkey, case p_partkey % 3 when 0 then 'ris,cre' else 'ris,!cre' end as rules from part),
       d as (select p_partkey, 'ris' as destination, true as must_exist from p
             union all select p_partkey, 'cre', rules = 'ris,cre' from p)
       select 'part-' || p_partkey as name, destination, must_exist,
         case when destination = 'ris' then true else p_partkey % 4 = 0 end as has_data,
         case when destination = 'ris' then p_partkey % 7 <> 0 else p_partkey % 4 = 0 end as has_control,
         case when destination = 'ris' then p_partkey % 7 <> 0
              when must_exist then p_partkey % 4 = 0 else p_partkey % 4 <> 0 end as passed from d""",
)
def _(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    name = F.concat(F.lit("part-"), F.col("p_partkey")).alias("name")
    rules = p.select(name, F.when(F.col("p_partkey") % 3 == 0, "ris,cre").otherwise("ris,!cre").alias("destination"))
    file = lambda dest, kind: p.select(
        "p_partkey", name, F.lit(dest).alias("destination"), F.lit(kind).alias("kind")
    )
    files = (
        file("ris", "data")
        .unionByName(file("ris", "control").where("p_partkey % 7 <> 0"))
        .unionByName(file("cre", "data").where("p_partkey % 4 = 0"))
        .unionByName(file("cre", "control").where("p_partkey % 4 = 0"))
        .drop("p_partkey")
    )
    return routing.destination_routing(rules, files)


@query(
    "order_by_ordinal",
    BASE_SQL
    + """select database, collection, imported_count, missing_exported_count from counts order by 4 desc, 1, 2""",
)
def _(spark, sf_dir):
    # ordinals are resolved by position, as in the report SQL
    counts = counts_table(spark, sf_dir).select(
        "database", "collection", "imported_count", "missing_exported_count"
    )
    return counts.orderBy(F.desc(F.col(counts.columns[3])), *counts.columns[:2])


@query(
    "top_n_per_group",
    """select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from (
         select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) rn
         from lineitem) where rn <= 5""",
)
def _(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    items = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"
    )
    return ranking.top_n_per_group(items, ["l_suppkey"], order, 5).drop("l_partkey")


@query(
    "case_normalise",
    """select lower(event_type) as kind, count(*) as events from
         (select case when event_id % 2 = 0 then upper(event_type) else event_type end as event_type from events)
       group by 1""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return e.groupBy(F.lower(mixed).alias("kind")).agg(F.count("*").alias("events"))
