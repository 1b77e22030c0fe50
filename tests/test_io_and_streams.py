import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laborcast.sources import files, payloads, sinks, stores
from laborcast.streaming import postings as stream

SF = "/root/testdata/sf0.001"


def test_delimited_and_json_files(spark, tmp_path):
    (tmp_path / "occ.txt").write_text("O*NET-SOC Code\tTitle\tDescription\n15-1\tDev\ta\n15-1\tOther\tb\n\tBlank\tc\n", encoding="utf-8")
    assert [tuple(r) for r in files.scan_occupations(spark, str(tmp_path / "occ.txt")).collect()] == [("15-1", "Dev", "a")]
    (tmp_path / "jobs.jsonl").write_text('{"title": "Dev", "companyName": "A", "location": "Pune, MH", "salary": "3-6 Lacs PA", "experience": "1-2 Yrs", "jobId": "7"}\nnot json\n')
    row = files.scan_board_json(spark, str(tmp_path / "jobs.jsonl")).collect()
    assert [(r["city"], r["salary_min_inr"], r["listed_year"]) for r in row] == [("Pune", 300000.0, 2024)]


def test_payload_shapes(spark):
    new = {"data": {"jobs": [{"job_id": "a", "job_title": "Dev", "job_min_salary": 100000, "job_salary_period": "MONTH", "job_city": "bangalore"}]}}
    old = {"data": [{"job_id": "b", "job_title": "Intern", "job_salary_currency": "USD", "job_min_salary": 5e5}]}
    df = spark.createDataFrame([(json.dumps(new),), (json.dumps(old),)], "p string")
    got = {r["job_id"]: (r["salary_min"], r["location"], r["employment_type"]) for r in payloads.fulltext(df, "p", now=F.current_timestamp()).collect()}
    assert got == {"fulltext:a": (1200000, "Bengaluru", "unknown"), "fulltext:b": (None, None, "internship")}


def test_keyed_merge_and_partition_replace(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, o int"), spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k int, v string, o int")
    first = sinks.merge_keyed(old, new, keys=["k"], order="o", keep="first")
    last = sinks.merge_keyed(old, new, keys=["k"], order="o", keep="last")
    assert sorted((r["k"], r["v"]) for r in first.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "t")
    sinks.replace_markets(old, path, ["k"])
    sinks.replace_markets(new, path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_drops_repeated_postings(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("Dev", "Acme", "pune", "2+ years", 900000.0, "2024-01-01T00:00:00Z"), ("dev", "ACME Ltd", "Pune", "2+ years", 900000.0, "2024-01-02T00:00:00Z"),
            ("Chef", "Inn", "delhi", "remote", 1.0, "2024-01-02T00:00:00Z")]
    keys = ["title", "company", "location", "description", "salary", "posted_at"]
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in rows))
    raw = stream.read_postings(spark, str(src), "title string, company string, location string, description string, salary double, posted_at timestamp")
    out = stream.first_copies(stream.normalized(raw))
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) AS n FROM seen").first()["n"] == 2
    v = stream.velocity(stream.normalized(raw).withColumn("role", F.col("title")), size="7 days")
    q = v.writeStream.outputMode("complete").format("memory").queryName("pace").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(postings) AS n FROM pace").first()["n"] == 3


@pytest.mark.parametrize("name", ["a01_regional_years", "a12_floor_percentiles", "b04_inr_salary", "j01_title_resolution", "m15_recency", "o03_occupation_exposure",
                                  "w03_rank_positions", "y04_histogram_estimate"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in entry.catalog.QUERIES and __import__("laborcast.plans.lenses", fromlist=["TABLES"]).TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_a_late_batch_keeps_newer_markets(spark, tmp_path):
    path, by = str(tmp_path / "markets"), ["role", "city"]

    def batch(rows):
        return spark.createDataFrame(rows, "role string, city string, fetched_at string, n int").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))

    source = tmp_path / "in"
    for i, rows in enumerate([[("a", "x", "2024-02-02", 1), ("a", "y", "2024-02-01", 2)], [("a", "x", "2024-01-01", 3), ("b", "x", "2024-01-01", 4)], [("a", "y", "2024-03-01", 5)]]):
        batch(rows).write.mode("append").json(str(source))
        feed = spark.readStream.schema("role string, city string, fetched_at timestamp, n int").json(str(source))
        stream.keep_latest_markets(feed, path, str(tmp_path / "checkpoint"), by).start().awaitTermination()
    assert sorted((r.role, r.city, r.n) for r in stores.BucketStore(spark, path, by).read().collect()) == [("a", "x", 1), ("a", "y", 5), ("b", "x", 4)]


def test_undated_postings_have_a_path(spark):
    rows = spark.createDataFrame([("k", None), ("k", "2024-01-01 00:00:00"), ("k", "2024-01-03 00:00:00")], "duplicate_key string, posted_at string").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    assert stream.undated(rows).count() == 1
    assert [str(r.posted_at) for r in stream.first_copies(rows).collect()] == ["2024-01-01 00:00:00"]


def test_dated_and_undated_postings_in_one_stream(spark, tmp_path):
    schema = "title string, company string, location string, description string, salary double, posted_at timestamp, fetched_at timestamp"
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rounds = [
        [("Dev", "A", "2024-03-01", "2024-03-02"), ("Dev", "A", None, "2024-03-02"), ("Chef", "B", None, "2024-03-02"), ("Nurse", "C", "2024-03-01", "2024-03-02")],
        [("dev", "A Ltd", None, "2024-03-03"), ("Dev", "A", "2024-03-02", "2024-03-03"), ("Cook", "B", None, "2024-03-03")],
        [("Temp", "T", None, "2024-06-20"), ("Temp", "T", "2024-06-20", "2024-06-20")],
        [("Dev", "A", None, "2024-06-25"), ("Dev", "A", "2024-06-24", "2024-06-25"), ("Nurse", "C", "2024-06-25", "2024-06-25"), ("Temp", "T", "2024-06-25", "2024-06-25")],
    ]
    for rows in rounds:  # each round goes on from the checkpoint of the one before
        spark.createDataFrame([(t, c, "Pune", "x", 1.0, p, f) for t, c, p, f in rows], schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(source))
        feed = stream.normalized(stream.read_postings(spark, str(source), schema))
        stream.all_first_copies(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    got = sorted((r.title.lower(), str(r.posted_at)[:10], str(r.fetched_at)[:10]) for r in spark.read.parquet(out).collect())
    # Copies inside 45 days are dropped by kind; once the watermark is past them their state is gone and a copy counts anew.
    first = [("dev", "2024-03-01", "2024-03-02"), ("dev", "None", "2024-03-02"), ("chef", "None", "2024-03-02"), ("nurse", "2024-03-01", "2024-03-02"), ("cook", "None", "2024-03-03")]
    later = [("temp", "None", "2024-06-20"), ("temp", "2024-06-20", "2024-06-20"), ("dev", "None", "2024-06-25"), ("dev", "2024-06-24", "2024-06-25"), ("nurse", "2024-06-25", "2024-06-25")]
    assert got == sorted(first + later)


def test_both_kinds_as_a_batch(spark):
    rows = spark.createDataFrame([("k", None, "2024-02-01"), ("k", None, "2024-01-01"), ("k", "2024-01-05", "2024-02-01"), ("k", "2024-01-03", "2024-02-02"), ("l", None, "2024-01-09")], "duplicate_key string, posted_at string, fetched_at string")
    got = {(r.duplicate_key, r.posted_at, str(r.event_time)[:10]) for r in stream.all_first_copies(rows).collect()}
    assert got == {("k", None, "2024-01-01"), ("k", "2024-01-03", "2024-01-03"), ("l", None, "2024-01-09")}


def test_document_parts_put_together(spark):
    rows = [("a", "tech", f"t{i:03}", None if i % 7 == 0 else round((i * 37 % 100) / 100, 4)) for i in range(95)] + [("b", "task", 'say "hi"\n', 0.0001)]
    parts = sinks.document_parts(spark.createDataFrame(rows, "soc_code string, item_type string, item_name string, importance_norm double").repartition(3), size=10)
    got = sorted(parts.collect(), key=lambda r: (r.soc_code, r.part))
    want = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-(r[3] or 0.0), r[1], r[2]))
    lines = [json.loads(x) for r in got if r.soc_code == "a" for x in r.lines.split("\n")]
    assert [(x["item_type"], x["item_name"], x["importance"]) for x in lines] == [(t, n, None if i is None else f"{i:.4f}") for _, t, n, i in want]
    assert [r["items"] for r in got] == [10] * 9 + [5, 1] and json.loads(got[-1].lines) == {"item_type": "task", "item_name": 'say "hi"\n', "importance": "0.0001"}
    manifest = sinks.document_manifest(spark.createDataFrame([("a", "A"), ("c", "C")], "soc_code string, title string"), parts).collect()
    assert [(m.soc_code, m.parts, m["items"]) for m in manifest] == [("a", 10, 95)]
