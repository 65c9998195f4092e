"""Table maintenance, dimensions, streams, listings and cost joins on small frames."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import aggregates, benchmarks, chat, finops, listing, mappings
from lumenlog.operators import dimensions as d
from lumenlog.operators import tracing as t
from lumenlog.session import shared_dir
from lumenlog.sources import io, merge_table
from lumenlog.streaming import jobs


def test_shared_folder_comes_from_the_session():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    cluster = SimpleNamespace(conf=Conf({"spark.checkpoint.dir": "hdfs://shared/ck/"}), sparkContext=SimpleNamespace(master="yarn"))
    assert shared_dir(cluster) == "hdfs://shared/ck"
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="yarn")))
    laptop = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="local[2]"))
    assert shared_dir(laptop) == shared_dir(laptop)


def test_list_params():
    assert listing.ListParams().problems() == []
    bad = listing.ListParams(limit=0, hours=999, severity="LOUD")
    assert len(bad.problems()) == 3
    with pytest.raises(ValueError):
        bad.checked()
    assert (bad.clamped().limit, bad.clamped(250, 168).hours) == (1, 168)


def test_count_by_refuses_other_fields(spark):
    with pytest.raises(ValueError):
        aggregates.count_by(spark.createDataFrame([("x",)], "message string"), "message")


def test_tail_keeps_rows_with_the_cursor_time(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "log_id string, s int").withColumn("event_timestamp", F.timestamp_seconds("s"))
    got = listing.tail(df, "1970-01-01 00:00:01", "a")
    assert [r["log_id"] for r in got.collect()] == ["b", "c"]


def log_frame(spark, rows):
    df = spark.createDataFrame(rows, "log_id string, ts string, severity string, service_name string, message string")
    return df.select("log_id", F.col("ts").cast("timestamp").alias("event_timestamp"), "severity", "service_name", F.lit("r").alias("resource_type"), "message")


def test_append_logs_twice(spark, folder):
    path = f"{folder}/unified"
    rows = [("1", "2024-01-01 01:00:00", "INFO", "a", "x" * 12000), ("1", "2024-01-01 01:00:00", "INFO", "a", "x" * 12000), ("2", "2024-01-02 01:00:00", "ERROR", None, "m"), ("3", None, "INFO", "a", "lost")]
    io.append_logs(log_frame(spark, rows), path, "b1", "2024-02-01 00:00:00")
    io.append_logs(log_frame(spark, rows + [("4", "2024-01-01 02:00:00", "INFO", "b", "new")]), path, "b2", "2024-02-01 00:00:00")
    got = {r["log_id"]: r for r in spark.read.parquet(path).collect()}
    assert sorted(got) == ["1", "2", "3", "4"] and spark.read.parquet(path).count() == 4
    assert len(got["1"]["message"]) == 12000 and got["3"]["log_date"] is None and got["4"]["etl_batch_id"] == "b2" and got["2"]["cluster_key"] == "ERROR:unknown"
    assert os.path.isdir(f"{path}/log_date=2024-01-02")


def test_upsert_and_tenant_delete(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 2), (1, "old", 0)], "id int, v string, seq int")
    once = io.keyed_upsert(df, new, "id", "seq")
    assert {r["id"]: r["v"] for r in once.collect()} == {1: "a", 2: "B", 3: "c"}
    assert sorted(io.keyed_upsert(once, new, "id", "seq").collect()) == sorted(once.collect())
    tenants = spark.createDataFrame([("x",), ("y",), (None,)], "project_id string")
    assert io.without_tenant(tenants, "x").count() == 2


def test_scan_source_keeps_known_fields(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "INFO", 1)], "timestamp string, severity string, zip int").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert io.scan_source(df).columns == ["timestamp", "severity"]
    assert io.scan_source(df, "2024-01-02 00:00:00", 24).count() == 1 and io.scan_source(df, "2024-01-03 00:00:00", 24).count() == 0
    record = io.to_raw_record(io.scan_source(df), "ds", "run_stdout").first()
    assert record["resource_type"] == "unknown" and record["stream_flow"] == "REALTIME" and len(record["log_id"]) == 64
    assert record["log_id"] == io.to_raw_record(io.scan_source(df), "ds", "run_stdout").first()["log_id"]


def test_staging_and_exports(spark, folder):
    lines, array = f"{folder}/lines", f"{folder}/array"
    os.makedirs(lines), os.makedirs(array)
    with open(f"{lines}/a.json", "w") as f:
        f.write('{"name":"n1","assetType":"k"}\n\n{"name":"n2"}\n')
    with open(f"{array}/a.json", "w") as f:
        json.dump([{"name": "n1", "assetType": "k"}, {"name": "n2"}], f)
    for rows in (io.load_staging_json(spark, lines, "2024-01-01 00:00:00"), io.load_staging_array(spark, array, "2024-01-01 00:00:00")):
        assert sorted((r["asset_type"], json.loads(r["payload"])["name"]) for r in rows.collect()) == [("k", "n1"), ("unknown", "n2")]
    with open(f"{lines}/b.json", "w") as f:
        f.write("{}")
    os.utime(f"{lines}/a.json", (1, 1))
    assert [os.path.basename(p) for p in io.latest_export(spark, lines)] == ["b.json"]
    assert [os.path.basename(p) for p in io.latest_export(spark, lines, "a")] == ["a.json"]
    spark.range(10).repartition(4).write.parquet(f"{folder}/export")
    assert len(io.latest_export(spark, f"{folder}/export", "part-")) == 4


def test_sharded_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "z")], "x int, y string")
    assert sorted((r["x"], r["y"]) for r in io.union_sharded([a, b]).collect()) == [(1, None), (2, "z")]


def test_retention_and_cleanup(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2023-01-01",)], "d string").withColumn("d", F.to_date("d"))
    assert io.unexpired(df, "billing_detailed_current", "d", "2024-02-01").count() == 1
    ts = df.withColumn("event_timestamp", F.col("d").cast("timestamp"))
    assert io.older_than(ts, "2023-06-01").count() == 1 and io.survivors(ts, "2023-06-01").count() == 1


DIM = "k string, name string, boss string, active_from date"


def dim(spark, rows):
    from datetime import date

    return spark.createDataFrame([(k, n, b, date(2024, 1, day)) for k, n, b, day in rows], DIM)


def test_scd2(spark):
    first = d.new_dimension(dim(spark, [("a", "A", None, 1), ("b", "B", "x", 1), ("c", "C", "x", 1)]), "k", F.col("active_from"))
    stage = dim(spark, [("a", "A", "y", 5), ("b", "B2", "x", 5), ("n", "N", None, 5)])
    merged = d.scd2_merge(first, stage, "k", ["name", "boss"], "2024-01-06")
    state = {(r["k"], r["name"], r["boss"], r["is_current"], str(r["active_to"])) for r in merged.collect()}
    assert state == {
        ("a", "A", None, False, "2024-01-05"),
        ("a", "A", "y", True, "None"),
        ("b", "B", "x", False, "2024-01-05"),
        ("b", "B2", "x", True, "None"),
        ("c", "C", "x", True, "None"),
        ("n", "N", None, True, "None"),
    }
    assert merged.count() == 6
    assert sorted(map(str, d.scd2_merge(merged, stage, "k", ["name", "boss"], "2024-01-07").collect())) == sorted(map(str, merged.collect()))
    strict = d.scd2_merge(first, stage, "k", ["name", "boss"], "2024-01-06", insert_new_version=False, null_safe=False, close_same_day=True)
    closed = [(r["k"], str(r["active_to"])) for r in strict.collect() if not r["is_current"]]
    assert closed == [("b", "2024-01-06")]


def test_point_in_time(spark):
    from datetime import date

    links = spark.createDataFrame([("s", "p1", date(2024, 1, 1), date(2024, 1, 9)), ("s", "p2", date(2024, 1, 10), None)], "sid string, project string, active_from date, active_to date")
    facts = spark.createDataFrame([("s", date(2024, 1, 9)), ("s", date(2024, 5, 1)), ("s", date(2023, 1, 1))], "sid string, day date")
    got = {str(r["day"]): r["project"] for r in d.resolve_at(facts, links, "sid", "day").collect()}
    assert got == {"2024-01-09": "p1", "2024-05-01": "p2", "2023-01-01": None}


def test_catalog_and_schema_changes(spark):
    old = spark.createDataFrame([("d", "t1", 1), ("d", "t2", 1)], "source_dataset string, source_table string, v int")
    new = spark.createDataFrame([("d", "t2", 2), ("d", "t3", 2)], old.schema)
    assert sorted((r["source_table"], r["v"]) for r in mappings.catalog_upsert(old, new).collect()) == [("t1", 1), ("t2", 2), ("t3", 2)]
    a = mappings.schema_inventory({"t": old})
    b = mappings.schema_inventory({"t": old.drop("v").withColumn("w", F.lit("x"))})
    changes = {(r["change_type"], r["object_name"]) for r in mappings.schema_changelog(mappings.schema_diff(a, b), "v2", "2024-01-01", "me").collect()}
    assert changes == {("drop", "t.v"), ("add", "t.w")}


def test_enhanced_cost_matches_theta_join(spark):
    from datetime import date

    day = date(2001, 11, 1)
    lines = [(i, 1, "a", "s", "svc", f"k{i % 3}", "text", "p", day, float(i % 4), "u", 1.0 + i, "USD", ["n1", "n2", None][i % 3]) for i in range(30)]
    billing = spark.createDataFrame(
        lines, "l_orderkey int, l_linenumber int, billing_account_id string, service_id string, service_name string, sku_id string, sku_description string, project_id string, usage_date date, "
        "usage_amount double, usage_unit string, cost double, currency string, location string",
    )
    prices = [("s", "k0", "n1", 2.0), ("s", "k0", None, 3.0), ("s", "k1", "n9", 5.0), ("s", "k2", None, 7.0)]
    price_frame = spark.createDataFrame(prices, "service_id string, sku_id string, pricing_location string, effective_price_per_unit double")
    cud = spark.createDataFrame([("a", "p", "s", "k0", day, 0.5, 60.0), ("a", "p", "s", "k0", day, 0.25, 20.0)], "billing_account_id string, project_id string, service_id string, sku_id string, usage_date date, discount_amount double, coverage_percentage double")
    got = sorted((r["l_orderkey"], r["effective_price_per_unit"] or 0.0, r["cud_discount_applied"], r["cud_optimization_status"]) for r in finops.enhanced_cost(billing, price_frame, cud, "2001-11-05").collect())
    expected = []
    for line in lines:
        sku, place = line[5], line[13]
        hits = [p for s, k, at, p in prices if k == sku and (at == place or at is None)] or [0.0]
        expected += [(line[0], p, 0.75 if sku == "k0" else 0.0, "LOW_CUD_COVERAGE" if sku == "k0" else "NO_CUD_COVERAGE") for p in hits]
    assert got == sorted(expected)


def test_job_detail_per_job_repeats_lines(spark):
    from datetime import date, datetime

    billing = spark.createDataFrame([(date(2024, 1, 1), "p", 4.0, 1.0, "x", "bq")], "usage_date date, project_id string, cost double, usage_amount double, sku_description string, service_id string")
    jobs_ = spark.createDataFrame(
        [("p", "j1", "u", "SELECT", 2 * 1024**4, 1000, True, datetime(2024, 1, 1, 3)), ("p", "j2", "u", "SELECT", None, 3000, False, datetime(2024, 1, 1, 4))],
        "project_id string, job_id string, user_name string, statement_type string, total_bytes_billed long, total_slot_ms long, cache_hit boolean, creation_time timestamp",
    )
    one = finops.bq_cost_detail(billing, jobs_, "bq").collect()
    assert len(one) == 1 and (one[0]["job_count"], one[0]["cost_per_tb"], one[0]["cost_per_slot_second"]) == (2, 2.0, 1.0)
    per_job = {r["job_id"]: r for r in finops.bq_cost_detail(billing, jobs_, "bq", per_job=True).collect()}
    assert per_job["j1"]["cost_per_tb"] == 2.0 and per_job["j2"]["cost_per_tb"] is None and per_job["j1"]["cost_per_slot_second"] == 4.0


def test_ingest_billing_twice(spark):
    from datetime import date

    flat = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("b", date(2024, 1, 1), 2.0)], "billing_account_id string, usage_date date, cost double")
    stored = flat.filter("billing_account_id = 'a'")
    new = finops.ingest_billing(flat, stored, "2024-01-01", "2024-01-31")
    assert [r["billing_account_id"] for r in new.collect()] == ["b"]
    assert finops.ingest_billing(flat, stored.unionByName(new), "2024-01-01", "2024-01-31").count() == 0
    assert finops.ingest_billing(flat, stored, "2024-01-01", "2024-01-31", by_account=False).count() == 0


def test_related_logs_window_edges(spark):
    rows = [("e", "2024-01-01 12:00:00", "ERROR", "s", "boom"), ("in1", "2024-01-01 11:30:00", "INFO", "s", "x"), ("in2", "2024-01-01 12:30:00", "INFO", "s", "x"), ("out", "2024-01-01 12:30:01", "INFO", "s", "x"), ("other", "2024-01-01 12:00:00", "INFO", "t", "x")]
    logs = log_frame(spark, rows).withColumn("trace_id", F.lit("tr"))
    got = t.related_logs(logs.filter("log_id = 'e'"), logs, 30).orderBy("rn").collect()
    assert [r["log_id"] for r in got] == ["in1", "e", "in2"] and [r["is_error"] for r in got] == [False, True, False]
    assert t.related_logs(logs.filter("log_id = 'e'"), logs, 30, limit=2).count() == 2


def test_tool_pairs_and_budget(spark):
    events = spark.createDataFrame(
        [("s", "t", 1, 10, "tool_start", None), ("s", "t", 1, 12, "tool_end", "failure"), ("s", "t", 2, 20, "tool_start", None)], "session_id string, tool_name string, call_id int, sec long, event_type string, status string"
    ).withColumn("event_timestamp", F.timestamp_seconds("sec"))
    got = {r["call_id"]: (r["duration_ms"], r["status"]) for r in chat.pair_tool_events(events).collect()}
    assert got == {1: (2000, "failure"), 2: (None, "running")}
    talk = spark.createDataFrame([(1, 0, "one two"), (1, 1, ""), (1, 2, " a  b\nc ")], "conv_id int, turn int, text string")
    rows = chat.token_budget(talk, 15).orderBy("turn").collect()
    assert [r["tokens_used"] for r in rows] == [6, 10, 17] and [r["exceeded"] for r in rows] == [False, False, True] and rows[1]["should_summarize"] is False


def test_bench_gates(spark):
    now = spark.createDataFrame([(0.9,), (0.8,)], "recall double")
    before = spark.createDataFrame([(0.95,), (0.95,)], "recall double")
    assert benchmarks.recall_gate(now, before).first()["passed"] is False
    assert benchmarks.recall_gate(now, now).first()["passed"] is True


# --- streams ----------------------------------------------------------------------------------------------------------


def write_part(spark, path, first, n):
    rows = [(i, 1_700_000_000 + i * 7, "ERROR" if i % 4 == 0 else "INFO", f"m{i}", f"u{i % 3}") for i in range(first, first + n)]
    spark.createDataFrame(rows, "id long, sec long, severity string, message string, who string").withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_over_several_runs(spark, folder):
    source, out, windows = f"{folder}/in", f"{folder}/out", f"{folder}/win"
    write_part(spark, source, 0, 50)
    schema = spark.read.parquet(source).schema
    for first in (50, 100, None):
        jobs.append_stream(jobs.stream_files(spark, source, schema, max_files=1), out, f"{folder}/cp1")
        rates = jobs.windowed_rates(jobs.stream_files(spark, source, schema, max_files=1), "ts", "60 seconds")
        jobs.run_windowed(rates, windows, f"{folder}/cp2")
        if first:
            write_part(spark, source, first, 50)
    table = spark.read.parquet(source)
    assert sorted(r["id"] for r in jobs.read_batches(spark, out, schema).collect()) == list(range(150))
    batch = jobs.windowed_rates(table, "ts", "60 seconds")
    live = jobs.latest_updates(spark, windows, batch.schema, ["window_start", "window_end"])
    assert sorted(map(tuple, live.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_dual_write_keeps_latest_state(spark, folder):
    source = f"{folder}/in"
    write_part(spark, source, 0, 10)
    schema = spark.read.parquet(source).schema
    for first in (10, 20, None):
        streams = [jobs.stream_files(spark, source, schema) for _ in range(2)]
        assert jobs.dual_write(*streams, f"{folder}/state", f"{folder}/log", f"{folder}/cp", "who", "id", buckets=4) is None
        if first:
            write_part(spark, source, first, 10)
    state = {r["who"]: r["id"] for r in merge_table.read(spark, f"{folder}/state", "who", "id").collect()}
    assert state == {"u0": 27, "u1": 28, "u2": 29} and spark.read.parquet(f"{folder}/log").count() == 30


def test_log_goes_on_when_the_state_fails(spark, folder):
    source = f"{folder}/in"
    write_part(spark, source, 0, 10)
    schema = spark.read.parquet(source).schema
    with open(f"{folder}/state", "w") as f:
        f.write("a file where the table should be")
    for n in (10, 20):
        streams = [jobs.stream_files(spark, source, schema) for _ in range(2)]
        assert jobs.dual_write(*streams, f"{folder}/state", f"{folder}/log", f"{folder}/cp", "who", "id", buckets=4) is not None
        assert spark.read.parquet(f"{folder}/log").count() == n
        write_part(spark, source, n, 10)
    os.remove(f"{folder}/state")
    streams = [jobs.stream_files(spark, source, schema) for _ in range(2)]
    assert jobs.dual_write(*streams, f"{folder}/state", f"{folder}/log", f"{folder}/cp", "who", "id", buckets=4) is None
    assert {r["who"]: r["id"] for r in merge_table.read(spark, f"{folder}/state", "who", "id").collect()} == {"u0": 27, "u1": 28, "u2": 29}


def test_stored_upsert(spark, folder):
    path = f"{folder}/points"
    df = spark.createDataFrame([(i, f"v{i}", 1) for i in range(50)], "id int, v string, seq int")
    io.upsert_table(spark, path, df, "id", "seq", buckets=4)
    new = spark.createDataFrame([(3, "new", 2), (3, "older", 1), (60, "b", 2), (60, "a", 2)], "id int, v string, seq int")
    for _ in range(2):
        io.upsert_table(spark, path, new, "id", "seq", buckets=99)
    got = spark.read.parquet(path).collect()
    assert len(got) == 51 and {r["buckets"] for r in got} == {4}
    by = {r["id"]: r["v"] for r in got}
    assert by[3] == "new" and by[60] in "ab" and by[4] == "v4"
    io.rebucket(spark, path, f"{folder}/wider", "id", 8)
    assert spark.read.parquet(f"{folder}/wider").count() == 51


def test_equal_order_has_one_winner(spark):
    old = spark.createDataFrame([(1, "stored", 5)], "id int, v string, seq int")
    for rows in ([(1, "x", 5), (1, "y", 5)], [(1, "y", 5), (1, "x", 5)]):
        new = spark.createDataFrame(rows, "id int, v string, seq int").coalesce(1)
        got = {io.keyed_upsert(old, new, "id", "seq").first()["v"]}
        assert got == {io.keyed_upsert(old, new.repartition(2, "v"), "id", "seq").first()["v"]} and "stored" not in got


def test_delete_where(spark, folder):
    path = f"{folder}/t"
    rows = [(1, "a", "2024-01-01"), (2, "a", "2024-01-05"), (3, "b", "2024-01-01"), (4, None, "2024-01-09"), (5, "c", None)]
    df = spark.createDataFrame(rows, "id int, p string, d string").withColumn("event_timestamp", F.to_timestamp("d"))
    df.write.partitionBy("p").parquet(path)
    plan = io.cleanup(spark, path, "2024-01-03", "p", dry_run=True)
    assert sorted((r["p"], r["rows"], r["deleted"]) for r in plan.collect()) == [("a", 2, 1), ("b", 1, 1)]
    assert spark.read.parquet(path).count() == 5
    io.cleanup(spark, path, "2024-01-03", "p")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 4, 5] and not os.path.exists(f"{path}/p=b")
    io.delete_where(spark, path, "p", F.col("event_timestamp") > "2024-01-08")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 5]


def points(spark, path):
    from lumenlog.streaming import etl

    return {r["chunk_id"]: r for r in etl.documents_table(spark, path).collect()}


def test_embed_documents_replaces_whole_documents(spark, folder):
    from lumenlog.streaming import etl

    path, kinds = f"{folder}/vectors", "doc_id long, source string, text string"

    def batch(rows, number, deleted=(), **more):
        gone = spark.createDataFrame([(i,) for i in deleted], "doc_id long")
        return etl.embed_documents(spark.createDataFrame(rows, kinds), path, number, deleted=gone, **more)

    long = " ".join(f"Sentence number {i}." for i in range(12))
    assert batch([(1, "s", "same words"), (2, "s", "same words"), (3, "s", long), (None, "s", "no id"), (4, "s", "  "), (5, "s", "five")], 0, max_size=60)
    first = points(spark, path)
    assert {"1", "2", "5"} < set(first) and sum(k.startswith("3_chunk_") for k in first) == len(first) - 3 > 3
    assert first["1"]["embedding"] == first["2"]["embedding"]
    assert not batch([(1, "s", "a repeat of an applied batch")], 0)
    assert points(spark, path) == first
    # A shorter text, an emptied one, a deleted document, a new one, and one with two texts.
    for number in (1, 2):
        assert batch([(3, "s", "Short now."), (5, "s", None), (6, "s", "six"), (7, "s", "one text"), (7, "s", "another text")], number, deleted=[1, 99], max_size=60)
    second = points(spark, path)
    assert set(second) == {"2", "3", "6", "7"} and second["3"]["chunk_text"] == "Short now." and second["2"] == first["2"]
    assert {r["version"] for k, r in second.items() if k != "2"} == {1}  # the second time nothing was written anew
    merge_table.compact(spark, path, "chunk_id", "version")
    assert points(spark, path) == second
    assert batch([(1, "s", "back again"), (3, "s", long)], 3, max_size=60)
    assert points(spark, path)["1"]["chunk_text"] == "back again" and len(points(spark, path)) == len(first) - 3 + 4


def test_merge_table_against_a_dictionary(spark, folder):
    import random

    rng, want, path = random.Random(3), {}, f"{folder}/t"
    for number in range(8):
        rows = {(rng.randrange(30) or None, rng.randrange(6)): f"v{number}.{k}" for k in range(rng.randrange(1, 15))}
        gone = {(rng.randrange(30), rng.randrange(6)) for _ in range(4)}
        for (key, order), value in rows.items():
            if (order, False) >= want.get(key, ((-1, False), None))[0]:
                want[key] = ((order, False), value)
        for key, order in gone:
            if (order, True) >= want.get(key, ((-1, False), None))[0]:
                want[key] = ((order, True), None)
        changes = spark.createDataFrame([(k, o, f"x{o}") for (k, o) in rows], "k int, o int, v string")
        deletes = spark.createDataFrame(list(gone), "k int, o int")
        assert merge_table.upsert(changes, path, "k", "o", number, "a", deletes, buckets=3)
        assert not merge_table.upsert(changes, path, "k", "o", number, "a")
        if number % 3 == 2:
            merge_table.compact(spark, path, "k", "o")
            merge_table.vacuum(spark, path)
        got = {r["k"]: (r["o"], r["v"]) for r in merge_table.read(spark, path, "k", "o").collect()}
        assert got == {k: (o[0], f"x{o[0]}") for k, (o, v) in want.items() if v is not None}


def test_merge_table_survives_failures_and_readers(spark, folder):
    path = f"{folder}/t"
    rows = spark.createDataFrame([(i, 1, "a") for i in range(200)], "k int, o int, v string")
    merge_table.upsert(rows, path, "k", "o", 0, buckets=4)
    merge_table.compact(spark, path, "k", "o")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    merge_table.upsert(rows.limit(1).withColumns({"o": F.lit(2), "v": F.lit("b")}), path, "k", "o", 1)
    grown = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names) - size
    assert grown < size / 2  # a batch writes its own rows, not the table
    # What a failed write leaves behind is in no manifest.
    rows.withColumns({"v": F.lit("lost"), "_deleted": F.lit(False)}).write.parquet(f"{path}/delta/left-over")
    old = merge_table.manifest(spark, path)
    reader = merge_table.read(spark, path, "k", "o")
    before = sorted(map(tuple, reader.collect()))
    merge_table.compact(spark, path, "k", "o")
    assert sorted(map(tuple, reader.collect())) == before  # a reader keeps its version
    assert sorted(map(tuple, merge_table.read(spark, path, "k", "o").collect())) == before
    assert sorted(map(tuple, merge_table.read(spark, path, "k", "o", old["version"]).collect())) == before
    with pytest.raises(RuntimeError):
        merge_table._commit(spark, path, old)
    assert "delta/left-over" in merge_table.vacuum(spark, path)
    assert sorted(map(tuple, merge_table.read(spark, path, "k", "o").collect())) == before
    assert merge_table.vacuum(spark, path) == []


def test_membership_has_no_false_negatives(spark, folder):
    from lumenlog.sources import membership

    for bits, most in ((20, 40), (6, 3000)):
        path = f"{folder}/{bits}"
        ids = spark.range(3000).selectExpr("concat('id-', id) AS k", "CASE WHEN id % 5 > 0 THEN date_add(DATE '2024-01-01', CAST(id % 5 AS INT)) END AS d")
        for batch in (0, 1, 1):
            membership.add(ids.filter(f"CAST(substr(k, 4) AS INT) % 2 = {batch}"), path, "k", "d", bits)
        assert membership.size(spark, path) == bits
        found = membership.may_hold(spark, path, ids, "k", "d", F.lit(True), bits)
        assert found.count() == 3000 and found.columns == ["k", "d"]
        others = ids.withColumn("k", F.concat(F.lit("new-"), "k"))
        assert membership.may_hold(spark, path, others, "k", "d", F.lit(True), bits).count() <= most
        assert membership.may_hold(spark, path, ids, "k", "d", F.col("day") == "2024-01-02", bits).count() == 600


def test_append_after_a_failure_between_bits_and_rows(spark, folder):
    from lumenlog.sources import membership

    path = f"{folder}/logs"
    rows = [("1", "2024-01-01 00:00:00", "INFO", "a", "m"), ("2", None, "INFO", "a", "m"), ("3", "2024-01-02 00:00:00", "INFO", "a", "m")]
    io.append_logs(log_frame(spark, rows[:1]), path, "b1", "2024-02-01 00:00:00")
    lost = log_frame(spark, rows).select("log_id", F.to_date("event_timestamp").alias("log_date"))
    membership.add(lost, f"{path}_ids", "log_id", "log_date", membership.DAY_BITS)  # the bits of a batch whose rows were never written
    for _ in range(3):
        io.append_logs(log_frame(spark, rows), path, "b2", "2024-02-01 00:00:00")
        assert sorted(r["log_id"] for r in spark.read.parquet(path).collect()) == ["1", "2", "3"]


def test_load_records_failures(spark, folder):
    from lumenlog.streaming import etl

    def sink(n):
        return lambda: spark.createDataFrame([(f"i{k}", f"2024-01-0{k + 1} 00:00:00", f"text {k}") for k in range(n)], "insertId string, t string, textPayload string").withColumn("timestamp", F.to_timestamp("t")).drop("t")

    sinks = {"a": sink(3), "b": sink(2), "gone": lambda: spark.read.parquet(f"{folder}/nothing"), "odd": lambda: spark.createDataFrame([(1,)], "x int")}
    assert etl.run_load(spark, sinks, "d", f"{folder}/t", f"{folder}/jobs", 0, "2024-02-01 00:00:00", continue_on_error=False) == "FAILED"
    assert not io.table_exists(spark, f"{folder}/t")
    for run, added in ((1, {"a": 3, "b": 2}), (2, {"a": 0, "b": 0})):
        assert etl.run_load(spark, sinks, "d", f"{folder}/t", f"{folder}/jobs", run, "2024-02-01 00:00:00") == "PARTIAL"
        rows = {r["stream_id"]: r for r in etl.job_rows(spark, f"{folder}/jobs").filter(f"run = {run}").collect()}
        assert {k: rows[f"d.{k}"]["loaded"] for k in "ab"} == added and rows["d.a"]["extracted"] == 3
        assert rows["d.gone"]["status"] == rows["d.odd"]["status"] == "FAILED" and rows["d.gone"]["error"] and rows[None]["extracted"] == 5
    assert {r["status"] for r in etl.job_rows(spark, f"{folder}/jobs").filter("run = 0").collect()} == {"FAILED"}
    # What stops the write is recorded and raised; the run stays neither running nor complete.
    with open(f"{folder}/file", "w") as f:
        f.write("no table")
    with pytest.raises(Exception):
        etl.run_load(spark, {"a": sink(1)}, "d", f"{folder}/file", f"{folder}/jobs", 3, "2024-02-01 00:00:00")
    assert {r["status"] for r in etl.job_rows(spark, f"{folder}/jobs").filter("run = 3").collect()} == {"FAILED"}
    with pytest.raises(ValueError):
        etl.run_load(spark, sinks, "d", f"{folder}/t", f"{folder}/jobs", 4, "2024-02-01 00:00:00", "sometimes")


def test_load_moves_rows_once_before_they_are_widened(spark, folder, monkeypatch):
    """Raw rows are placed by day and id; stored rows and copies are told there, and nothing that is parsed is moved."""
    from lumenlog.streaming import etl

    monkeypatch.setattr(io, "PIECE_ROWS", 3)
    monkeypatch.setattr(io, "LEAST_ROWS", 2)
    plans, widen, write = [], etl.normalize.normalize_logs, io.write_clustered
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(etl.normalize, "normalize_logs", lambda df: plan(df) or widen(df))
    monkeypatch.setattr(io, "write_clustered", lambda df, *args, **more: plan(df) or write(df, *args, **more))

    def sink(days):
        rows = [(f"i{k}", None if k == 4 else f"2024-01-{k % 9 + 1:02d} 00:00:00", f"text {k}") for k in days]
        return lambda: spark.createDataFrame(rows, "insertId string, t string, textPayload string").withColumn("timestamp", F.to_timestamp("t")).drop("t")

    jobs = f"{folder}/jobs"
    for run, (days, added) in enumerate((([*range(10), 3, 3, 4, 12], 11), ([*range(8, 30), 4, 20], 19), (range(30), 0))):
        etl.run_load(spark, {"a": sink(days)}, "d", f"{folder}/t", jobs, run, "2024-02-01 00:00:00")
        got = etl.job_rows(spark, jobs).filter(f"run = {run} AND stream_id = 'd.a'").first()
        assert (got["status"], got["extracted"], got["loaded"]) == ("COMPLETED", len(days), added)
        assert [p.count("Exchange") for p in plans[-2:]] == [p.count("Exchange rangepartitioning") for p in plans[-2:]] == [1, 1]
    rows = spark.read.parquet(f"{folder}/t").collect()
    assert sorted(r["message"] for r in rows) == sorted(f"text {k}" for k in range(30))
    assert {r["insert_id"]: str(r["log_date"]) for r in rows} == {f"i{k}": "None" if k == 4 else f"2024-01-{k % 9 + 1:02d}" for k in range(30)}


def test_append_keeps_one_row_of_an_id(spark, folder):
    """Null ids are one id in a batch, and none that is stored; rows of an id are taken once, whatever else they hold."""
    rows = [(None, "2024-01-01 00:00:00", "INFO", "a", "m"), (None, "2024-01-02 00:00:00", "INFO", "a", "m"), ("1", "2024-01-01 00:00:00", "INFO", "a", "m"), ("1", "2024-01-01 00:00:00", "ERROR", "b", "n"), ("2", None, "INFO", "a", "m")]
    for batch, left in (("b1", 3), ("b2", 4)):
        io.append_logs(log_frame(spark, rows), f"{folder}/t", batch, "2024-02-01 00:00:00")
        assert spark.read.parquet(f"{folder}/t").count() == left


def test_archive_adds_late_lines_once(spark, folder):
    rows = [("A", 1, 2.0, "b0"), ("A", 20, 4.0, "b0"), ("B", 10, 0.5, "b1"), ("A", 1, 6.0, "b2"), ("A", 1, None, "b2"), ("A", 28, 9.0, "b3")]

    def lines(*batches):
        kept = [(f"acct-{a}", f"2001-01-{d:02d}", c, b) for a, d, c, b in rows if b in batches]
        df = spark.createDataFrame(kept, "billing_account_id string, d string, cost double, batch_id string").withColumn("usage_date", F.to_date("d"))
        others = [k for k in finops.ARCHIVE_KEYS if k != "billing_account_id"]
        return df.withColumns({**{k: F.lit(k) for k in others}, "usage_amount": F.lit(1.0)})

    def stored():
        return {(r["billing_account_id"], r["cost_bucket"]): (r["record_count"], r["total_cost"], r["avg_cost"], str(r["period_start"]), str(r["period_end"])) for r in finops.archived(spark, folder).collect()}

    finops.archive_incremental(lines("b0"), folder, 0, "2001-12-01")
    assert stored() == {("acct-A", "medium"): (2, 6.0, 3.0, "2001-01-01", "2001-01-20")}
    # A run that failed after its sums and before its ledger.
    finops.archive_rollup(lines("b1")).write.parquet(f"{folder}/rows/run=1")
    assert len(stored()) == 1
    for run in (1, 1, 2):
        finops.archive_incremental(lines("b0", "b1", "b2"), folder, run, "2001-12-01")
    late = stored()
    assert late[("acct-B", "small")] == (1, 0.5, 0.5, "2001-01-10", "2001-01-10") and late[("acct-A", "medium")] == (3, 12.0, 4.0, "2001-01-01", "2001-01-20")
    finops.archive_incremental(lines("b0", "b1", "b2", "b3"), folder, 3, "2001-12-01")
    whole = {(r["billing_account_id"], r["cost_bucket"]): (r["record_count"], r["total_cost"], r["avg_cost"], str(r["period_start"]), str(r["period_end"])) for r in finops.archive_rollup(lines("b0", "b1", "b2", "b3")).collect()}
    assert stored() == whole


def test_related_logs_of_many_anchors_in_one_service(spark):
    base = "timestamp_seconds(1704067200 + CAST(id / 4 AS BIGINT))"
    logs = spark.range(20_000).selectExpr("lpad(id, 6, '0') AS log_id", f"{base} AS event_timestamp", "'INFO' AS severity", "CASE WHEN id % 9 = 0 THEN 'b' ELSE 'a' END AS service_name", "'m' AS message", "'t' AS trace_id")
    anchors = logs.filter("CAST(log_id AS INT) % 2 = 0")
    got = t.related_logs(anchors, logs, minutes=1, limit=20)
    assert got.groupBy("anchor_id").count().filter("count = 20").count() == 10_000
    one = {r["rn"]: r["log_id"] for r in got.filter("anchor_id = '010000'").collect()}
    service = [f"{i:06d}" for i in range(20_000) if i % 9 and 2500 - 60 <= i // 4]
    assert [one[k] for k in sorted(one)] == service[:20]


def test_hierarchy_adds_up_to_the_top(spark):
    from lumenlog.operators import finops

    orgs = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "y"), ("y", "Y", "x")], "org_id string, org_name string, parent_org_id string")
    costs = spark.createDataFrame([("c", 10.0), ("b", 1.0), ("x", 2.0)], "org_id string, cost double")
    got = {r["org_id"]: r["total_cost"] for r in finops.org_hierarchy_costs(costs, orgs).collect()}
    assert got == {"a": 11.0, "b": 11.0, "c": 10.0, "x": 2.0, "y": 2.0}


def test_all_members_and_all_errors(spark):
    payload = json.dumps({"project": "p", "name": "n", "iamPolicy": {"bindings": [{"role": "r", "members": ["u1", "u2"]}, {"role": "s", "members": ["u3"]}]}})
    assets = spark.createDataFrame([("2024-01-01", payload)], "fetched_at string, payload string")
    assert sorted((r["role"], r["member"]) for r in d.fact_policy(assets).collect()) == [("r", "u1"), ("r", "u2"), ("s", "u3")]
    logs = spark.range(5000).select(F.col("id").cast("string").alias("log_id"), F.lit("ERROR").alias("severity"), F.lit("2024-01-02").cast("timestamp").alias("event_timestamp"), F.when(F.col("id") < 40, "rare").otherwise("busy").alias("service_name"))
    from lumenlog.operators import aggregates

    assert {r["service"]: r["error_count"] for r in aggregates.error_insights(logs, "2024-01-01 00:00:00").collect()} == {"rare": 40, "busy": 4960}


def test_rolling_counts_on_a_hot_second(spark):
    from lumenlog.functions.ordered import rolling_counts

    df = spark.range(3000).select("id", F.lit("k").alias("key"), F.timestamp_seconds(F.when(F.col("id") < 2000, 100).otherwise(F.col("id"))).alias("ts"))
    got = {r["id"]: r["n"] for r in rolling_counts(df, ["key"], "ts", 9, "n").collect()}
    assert got[0] == 2000 and got[2000] == 1 and got[2500] == 10


def test_nothing_has_arrived_yet(spark, folder):
    assert not io.table_exists(spark, f"{folder}/none")
    assert jobs.read_batches(spark, f"{folder}/none", spark.createDataFrame([], "x int").schema).count() == 0


def test_retries(spark):
    df = spark.createDataFrame([(1, "FAILED", 0, False), (2, "FAILED", 2, False), (3, "COMPLETED", 0, True)], "job_id int, status string, retry_count int, priority boolean")
    again, dead = jobs.split_retries(df)
    assert [r["job_id"] for r in again.collect()] == [1] and [r["job_id"] for r in dead.collect()] == [2]
    assert jobs.redrive(dead).first()["retry_count"] == 0


def test_embed_documents_moves_each_text_once(spark, folder, monkeypatch):
    """One exchange below the stored points has texts under it: that of the distinct texts."""
    from lumenlog.streaming import etl

    plans, upsert = [], merge_table.upsert

    def kept(changes, *more):
        plans.append(changes._jdf.queryExecution().executedPlan().toString().splitlines())
        return upsert(changes, *more)

    monkeypatch.setattr(merge_table, "upsert", kept)
    path = f"{folder}/vectors"
    docs = spark.createDataFrame([(i, "s", f"text {i % 40}") for i in range(400)], "doc_id long, source string, text string")
    assert etl.embed_documents(docs, path, 0) and len(points(spark, path)) == 400
    (lines,) = plans
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    moving = 0
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("Exchange"):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            moving += any("FileScan" in x and "chunk_text" in x for x in lines[i + 1 : end])
    assert moving == 1


def test_some_columns_of_a_merge_table(spark, folder):
    path = f"{folder}/t"
    for number, v in enumerate(("a", "b")):
        rows = spark.createDataFrame([(k, number, v, "x" * k) for k in range(number, 5)], "k long, o long, v string, more string")
        merge_table.upsert(rows, path, "k", "o", number)
        want = sorted((r["v"], r["k"]) for r in merge_table.read(spark, path, "k", "o").collect())
        assert sorted(map(tuple, merge_table.read(spark, path, "k", "o", columns=["v", "k"]).collect())) == want
        if not number:
            merge_table.compact(spark, path, "k", "o")
    assert want == [("a", 0), *[("b", k) for k in range(1, 5)]]
