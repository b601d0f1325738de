"""Data products, claimant queries, routing and quality gates."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallystone.operators import checks, claimants, products, routing
from tallystone.plans import catalog
from tallystone.session import scan_in_small_tasks
from tallystone.sources import generate


def test_obligations_give_seven_rows(spark):
    doc = lambda i, referrals, easements, day: json.dumps(
        {
            "_id": {"youthObligationDetailsId": i}, "claimantId": "c" + i, "youthObligationStatus": "aa",
            "youthObligationReferrals": referrals, "youthObligationEasements": easements,
            "statusLastChangedDate": day, "_lastModifiedDateTime": {"d_date": "1980-01-01T00:00:00.000Z"},
        }
    )
    docs = [
        doc("1", ["aa"], [], 20173458), doc("2", [], [], 20101082), doc("3", [], [], 20242794),
        doc("4", [], [], 20039183), doc("5", ["aa"], ["aa", "bb", "cc"], 20025407),
    ]
    schema = (
        "_id struct<youthObligationDetailsId:string>, claimantId string, youthObligationStatus string, "
        "youthObligationReferrals array<string>, youthObligationEasements array<string>, "
        "statusLastChangedDate int, _lastModifiedDateTime struct<d_date:string>"
    )
    df = spark.createDataFrame([(d,) for d in docs], "value string").select(F.from_json("value", schema).alias("d")).select("d.*")
    got = sorted(
        (r.obligation_id, r.easement or "", r.referral or "", r.status, r.status_last_changed_date, r.last_modified_date, str(r.last_modified_ts))
        for r in products.obligation_flatten(df).collect()
    )
    day = dt.date(1980, 1, 1)
    row = lambda i, e, r: (i, e, r, "aa", None, day, "1980-01-01 00:00:00")
    assert got == [
        row("1", "", "aa"), row("2", "", ""), row("3", "", ""), row("4", "", ""),
        row("5", "aa", "aa"), row("5", "bb", "aa"), row("5", "cc", "aa"),
    ]


def test_lower_case_keys_and_null_texts(spark):
    text = '{"dateOfBirth":{"cryptoId":"X:Y","Type":"A"},"middleName":null,"note":"Say \\"Key\\": null, ok","list":[null,1]}'
    df = spark.createDataFrame([(text,)], "t string")
    lowered = json.loads(df.select(products.lower_case_keys(F.col("t"))).first()[0])
    assert lowered == {"dateofbirth": {"cryptoid": "X:Y", "type": "A"}, "middlename": None, "note": 'Say "Key": null, ok', "list": [None, 1]}
    plain = spark.createDataFrame([('{"a":null,"b":"x"}',)], "t string")
    assert plain.select(products.nulls_as_text(F.col("t"))).first()[0] == '{"a":"null","b":"x"}'
    tricky = json.loads(df.select(products.nulls_as_text(F.col("t"))).first()[0])
    both = json.loads(df.select(products.lower_keys_and_fill_nulls(F.col("t"))).first()[0])
    assert both == {**lowered, "middlename": "null", "list": ["null", 1]}
    assert tricky["note"] == 'Say "Key": null, ok' and tricky["middleName"] == "null" and tricky["list"] == ["null", 1]


def scenario(spark, periods, today, closed=None, suspended=None, partner=False, count=1):
    schema = (
        "scenario_id int, count int, partner boolean, closed_days int, suspended_days int, "
        "assessment_periods array<struct<start_days:int,start_months:int,end_days:int,end_months:int,amount:string>>"
    )
    df = spark.createDataFrame([(1, count, partner, closed, suspended, periods)], schema)
    return generate.generate_claimants(df, F.lit(today))


THREE = [(-3, -3, -4, -2, "601.88"), (-3, -2, -4, -1, "433.32"), (-3, -1, -4, None, "742.89")]


def test_only_the_contained_month_is_returned(spark):
    today = dt.date(2024, 3, 20)
    made = scenario(spark, THREE, today)
    now = F.lit(int(today.strftime("%Y%m%d")))
    awards = claimants.claimant_award_join(made["claimants"], made["contracts"], made["statements"], now)
    assert sorted((r.startDate, r.endDate, r.takeHomePay) for r in awards.collect()) == [
        (20231217, 20240116, "601.88"), (20240117, 20240216, "433.32"), (20240217, 20240316, "742.89"),
    ]
    # from = days -3 months -2, to = days -5 months -1 (a day before the end) or -3
    late = claimants.claimant_date_query(awards, F.lit(20240117), F.lit(20240217))
    assert [r.takeHomePay for r in late.collect()] == ["433.32"]
    short = claimants.claimant_date_query(awards, F.lit(20240117), F.lit(20240215))
    assert short.count() == 0


def test_closed_suspended_and_partner(spark):
    today = dt.date(2024, 3, 20)
    now = F.lit(20240320)
    closed = scenario(spark, THREE, today, closed=-2)
    status = claimants.claimant_status(closed["claimants"], closed["contracts"], now).collect()
    assert [(s.found, s.suspended) for s in status] == [(False, False)]
    awards = claimants.claimant_award_join(closed["claimants"], closed["contracts"], closed["statements"], now).collect()
    assert [(a.found, a.takeHomePay) for a in awards] == [(False, None)]
    both = scenario(spark, THREE, today, suspended=-1, partner=True, count=2)
    status = claimants.claimant_status(both["claimants"], both["contracts"], now).collect()
    assert [(s.found, s.suspended) for s in status] == [(True, True)] * 4
    assert both["contracts"].count() == 2 and both["statements"].count() == 6


def test_awards_match_brute_force(spark, sf_dir):
    from tallystone.plans import bindings as b

    c, k, s = (f(spark, sf_dir) for f in (b.claimants, b.contracts, b.statements))
    now = 19990101
    got = sorted(
        (r.citizenId, str(r.contractId), str(r.assessmentPeriodId), str(r.startDate), str(r.takeHomePay))
        for r in claimants.claimant_award_join(c, k, s, F.lit(now)).collect()
    )
    pay = {}
    for r in s.collect():
        pay.setdefault(r.assessmentPeriod.contractId, []).append((r.assessmentPeriod.assessmentPeriodId, r.takeHomePay))
    held = {}
    for r in k.collect():
        if r.closedDate is None or r.closedDate >= now:
            starts = {p.assessmentPeriodId: p.startDate for p in r.assessmentPeriods}
            lines = [(p, starts[p], m) for p, m in pay.get(r._id.contractId, [])] or [(None, None, None)]
            for person in r.people:
                held.setdefault(person, []).extend((r._id.contractId, *line) for line in lines)
    want = sorted(
        (r._id.citizenId, *[str(x) for x in line])
        for r in c.collect()
        for line in held.get(r._id.citizenId, [(None, None, None, None)])
    )
    assert got == want


def test_awards_with_a_dominant_contract(spark):
    """One contract owns a third of all statements; joins are shuffled and split."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 9000
        contract = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
        s = spark.range(n).select(
            F.struct(F.concat_ws("-", F.lit("p"), contract, F.col("id") % 4).alias("assessmentPeriodId"), F.concat(F.lit("k"), contract).alias("contractId")).alias("assessmentPeriod"),
            F.col("id").cast("string").alias("takeHomePay"),
        )
        k = spark.range(600).select(
            F.struct(F.concat(F.lit("k"), F.col("id")).alias("contractId")).alias("_id"),
            F.array(F.concat(F.lit("c"), F.col("id") % 7)).alias("people"),
            F.lit(None).cast("int").alias("closedDate"),
            F.struct(F.lit(None).cast("int").alias("suspensionDate")).alias("claimSuspension"),
            F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct(F.concat_ws("-", F.lit("p"), F.col("id"), i).alias("assessmentPeriodId"), (i + 1).alias("startDate"), (i + 2).alias("endDate"))).alias("assessmentPeriods"),
        )
        c = spark.range(8).select(F.struct(F.concat(F.lit("c"), F.col("id")).alias("citizenId")).alias("_id"), F.col("id").cast("string").alias("nino"))
        awards = claimants.claimant_award_join(c, k, s, F.lit(20240101))
        got = awards.groupBy("found", F.col("contractId") == "k0", F.col("takeHomePay").isNull()).count().collect()
        tally = {tuple(r[:3]): r[3] for r in got}
        # contracts 500..599 have no statement, claimant 7 has no contract
        hot = sum(1 for i in range(n) if i % 3 == 0 or i % 500 == 0)
        assert tally == {(True, True, False): hot, (True, False, False): n - hot, (True, False, True): 100, (False, None, True): 1}
        assert awards.where("startDate is null and takeHomePay is not null").count() == 0
    finally:
        for key, v in old.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def test_path_depths(spark):
    paths = ["a/DB.db/t/f", "a/DB/t/d=1/f", "a/b/DB.db/t_$folder$", "x/y", "a/other/t/f", "DB/DB/t/f"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    dbs = spark.createDataFrame([("DB",)], "db string")
    got = {r.path: (r.db, r["table"]) for r in routing.path_to_db_table(df, dbs).collect()}
    assert got == {
        "a/DB.db/t/f": ("DB", "t"), "a/DB/t/d=1/f": ("DB", "t"), "a/b/DB.db/t_$folder$": ("DB", "t"),
        "x/y": (None, None), "a/other/t/f": (None, None), "DB/DB/t/f": ("DB", "t"),
    }
    classes = spark.createDataFrame([("DB", "t", "true")], "db string, table string, pii string")
    tagged = routing.tag_classification_join(routing.path_to_db_table(df, dbs), classes)
    tags = {r.path: r.tags for r in tagged.collect()}
    assert tags["a/DB.db/t/f"] == {"table": "t", "db": "DB", "pii": "true"}
    assert tags["x/y"] is None


def test_excluded_destination_must_stay_empty(spark):
    rules = spark.createDataFrame([("a", "ris,cre"), ("b", "ris,!cre"), ("c", "ris,!cre")], "name string, destination string")
    rows = [(n, d, k) for n in "abc" for d in ("ris",) for k in ("data", "control")] + [("a", "cre", "data"), ("c", "cre", "data")]
    files = spark.createDataFrame(rows, "name string, destination string, kind string")
    got = {(r.name, r.destination): r.passed for r in routing.destination_routing(rules, files).collect()}
    assert got == {("a", "ris"): True, ("a", "cre"): False, ("b", "ris"): True, ("b", "cre"): True, ("c", "ris"): True, ("c", "cre"): False}


@pytest.mark.parametrize(
    "text, fails",
    [("a,b\nx,1\ny,2\n", False), ("a,b,c\nx,1,2\n", True), ("a,z\nx,1\n", True), ("a,b\nx\ny,2\n", True), ("a,b\nx,1,3\n", True)],
)
def test_csv_gate_fails_the_load(spark, tmp_path, text, fails):
    (tmp_path / "f.csv").write_text(text)
    columns = {"a": "string", "b": "int"}
    load = lambda: checks.read_csv_strict(spark, str(tmp_path), columns)
    if fails:
        for use in (lambda d: d.collect(), lambda d: d.select("a").collect(), lambda d: d.count()):
            with pytest.raises(Exception):
                use(load())
    else:
        assert [tuple(r) for r in load().collect()] == [("x", 1), ("y", 2)] and load().count() == 2


def test_very_long_values_pass(spark):
    long = "x" * 1_000_000
    text = '{"Note":"' + long + '","Inner":{"A":null}}'
    df = spark.createDataFrame([(text, f'"{long}""",2')], "text string, value string")
    got = df.select(products.lower_keys_and_fill_nulls(F.col("text")).alias("t")).first().t
    assert got == '{"note":"' + long + '","inner":{"a":"null"}}'
    lines = df.select(F.lit("f").alias("file"), F.lit(2).alias("line_no"), "value").union(spark.createDataFrame([("f", 1, "a,b")]))
    r = checks.csv_violations(lines, {"a": "string", "b": "int"}).first()
    assert (r.rows, r.short_rows, r.long_rows, r.accepted) == (1, 0, 0, True)


def test_quoted_separators_do_not_widen_a_row(spark):
    lines = [("f", 1, "a,b"), ("f", 2, '"x,y",1'), ("f", 3, '"say ""a,b""",2'), ("g", 1, "a,b"), ("g", 2, "x"), ("g", 3, "x,1,2")]
    df = spark.createDataFrame(lines, "file string, line_no int, value string")
    got = {r.file: (r.rows, r.bad_headers, r.short_rows, r.long_rows, r.accepted) for r in checks.csv_violations(df, {"a": "string", "b": "int"}).collect()}
    assert got == {"f": (2, 0, 0, 0, True), "g": (2, 0, 1, 1, False)}


def test_counts_and_status(spark):
    df = spark.range(40)
    assert checks.row_count_check(df, 40, "x").first().passed
    files = spark.createDataFrame([("t",)] * 3, "topic string")
    wanted = spark.createDataFrame([("t", 2), ("none", 1)], "topic string, wanted int")
    exact = {r.topic: r.passed for r in checks.file_count_check(files, wanted).collect()}
    assert exact == {"t": False, "none": False}
    least = {r.topic: r.passed for r in checks.file_count_check(files, wanted, exact=False).collect()}
    assert least == {"t": True, "none": False}
    statuses = spark.createDataFrame([("c", "a", "Sent"), ("c", "b", "Failed")], "correlation_id string, collection string, status string")
    topics = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a")], "correlation_id string, collection string")
    got = {r.correlation_id: r.all_matched for r in checks.status_all_in(statuses, topics, ["Sent"]).collect()}
    assert got == {"c": False, "d": False}


def test_amounts_travel_as_one_text(spark):
    """Nineteen texts a row are sorted and shuffled as one; nulls, empty texts and the marks themselves come back."""
    period = "assessmentPeriod struct<assessmentPeriodId: string, contractId: string, startDate: int, endDate: int>"
    schema = f"id string, version bigint, sequence bigint, {period}, takeHomePay string, advances string, deductions double, sanctions string"
    p = ("ap", "k", 20240101, 20240131)
    rows = [
        ("a", 1, 9, p, "9.99", "9", 9.0, "9"), ("a", 2, 1, p, "1.50", None, 2.5, ""), ("b", 1, 1, p, None, None, None, None),
        ("c", 1, 1, p, "x\x01y", "\x00", 1.0, None), ("d", 1, 1, p, "", "", None, "\x1f\n|"), (None, 1, 1, None, "7", "8", 1.0, "9"),
    ]
    fact = products.statement_fact(spark.createDataFrame(rows, schema))
    got = {r.statement_id: (r.takehomepay, r.advances, r.deductions, r.sanctions, r.totalpayment) for r in fact.collect()}
    assert got == {
        "a": ("1.50", None, 2.5, "", None), "b": (None, None, None, None, None), "c": ("x\x01y", "\x00", 1.0, None, None),
        "d": ("", "", None, "\x1f\n|", None), None: ("7", "8", 1.0, "9", None),
    }
    below = fact._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [id", 1)[1]
    assert "max(struct(" in below and "takeHomePay" not in below.split("max(struct(", 1)[1].split("\n", 1)[0]


def test_statements_are_scanned_in_small_tasks(spark, folder):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128MB")
        lines = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_shipdate timestamp"
        spark.createDataFrame([], lines).write.parquet(folder + "/lineitem.parquet")
        assert catalog.QUERIES["product_statement_fact"](spark, folder).count() == 0
        assert int(spark.conf.get(name)) == 16 << 20
        spark.conf.set(name, "1MB")
        scan_in_small_tasks(spark)
        assert int(spark.conf.get(name)) == 1 << 20  # never larger than it was
    finally:
        spark.conf.set(name, before)
