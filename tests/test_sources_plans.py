"""Sources, sinks, streaming and the shape of plans."""

import datetime as dt
import json

from pyspark.sql import functions as F

from casemill.functions import schemas
from casemill.plans import catalog, ingest
from casemill.plans.reconstruct import verified_samples
from casemill.sources import adapters, tables
from casemill.streaming import ingest as stream

TEXTS = ["Paid Rs 500 by upi to a@ok, phone 9876543210", "abc", "phishing link https://x.xyz in Kota"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_requests_skip_broken_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join([json.dumps({"text": TEXTS[0], "officer_id": "7"}), "", "{broken", json.dumps({"text": TEXTS[2]})]))
    rows = tables.requests(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows) == sorted([TEXTS[0], TEXTS[2]])


def test_documents_by_suffix_and_size(spark, tmp_path):
    for name, size in (("a.PDF", 10), ("b.txt", 10), ("c.png", 0), ("d.jpeg", 5), ("e.tif", 10 * 1024 * 1024 + 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = tables.documents(spark, str(tmp_path)).select("path", "length").collect()
    assert sorted(r.path[-6:] for r in rows) == ["/a.PDF", "d.jpeg"]
    name = spark.createDataFrame([("s3://x/y z?.png",)], "p string").select(tables.stored_name(F.col("p"), F.lit(dt.datetime(2026, 1, 2, 3, 4, 5))).alias("n")).first().n
    assert name == "20260102_030405_y_z_.png"


def test_samples_and_benchmark_sinks(spark, tmp_path):
    samples, fields = verified_samples(spark.createDataFrame([("f1", TEXTS[0])], "file_id string, verified_text string"))
    for _ in range(2):
        tables.append_samples(samples, str(tmp_path / "s"))
    (tmp_path / "s" / "more.json").write_text('\n{"bad\n')
    back = tables.samples(spark, str(tmp_path / "s"))
    assert back.count() == 2 and back.schema == schemas.SAMPLES and fields.first().phone == "9876543210"
    tables.write_benchmark(samples.withColumn("nested", F.array(F.lit(1))), str(tmp_path / "b"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "b/csv")).first().nested == "[1]"
    assert spark.read.json(str(tmp_path / "b/json")).count() == 1


def test_tables_grow_columns_and_look_up(spark, tmp_path):
    tables.append(spark.range(3).withColumn("a", F.lit("x")), str(tmp_path / "t"))
    tables.append(spark.range(3, 5).withColumn("b", F.lit(1)), str(tmp_path / "t"))
    df = tables.scan(spark, str(tmp_path / "t"))
    assert set(df.columns) == {"id", "a", "b"} and tables.lookup(df, 4).first().b == 1 and tables.lookup(df, 9).count() == 0
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,4)]" in plan_of(tables.lookup(df, 4))
    assert tables.gazetteer(None, ("a",)) == ("a",) and tables.gazetteer("/nowhere", ("b",)) == ("b",)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(t, None) for t in TEXTS], "text string, station_name string")
    rows = ingest.complaint_rows(df, F.lit(dt.datetime(2026, 1, 1)))
    ingest.store(rows, str(tmp_path))
    kept, audit = spark.read.parquet(f"{tmp_path}/complaints"), spark.read.parquet(f"{tmp_path}/audit_logs")
    assert kept.count() == audit.count() == 2 and {r.complaint_id for r in audit.collect()} == {r.id for r in kept.collect()}
    assert all(r.details.startswith("confidence_score=0.") for r in audit.collect())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"text": t}) for t in TEXTS))
    for _ in range(2):  # nothing new the second time
        stream.start(stream.request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/complaints").count() == 2 and spark.read.parquet(f"{tmp_path}/out/audit_logs").count() == 2
    (tmp_path / "in/b.json").write_text(json.dumps({"text": TEXTS[2]}))
    stream.start(stream.request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/complaints").count() == 3
    assert stream.daily_counts(spark.readStream.schema(schemas.COMPLAINTS).parquet(f"{tmp_path}/out/complaints")).isStreaming


def test_plans(spark, sf):
    similar = plan_of(catalog.QUERIES["similar"](spark, sf))
    assert "BroadcastNestedLoopJoin" in similar and "CartesianProduct" not in similar and "TakeOrderedAndProject" in similar
    assert "TakeOrderedAndProject" in plan_of(catalog.QUERIES["nl_cases"](spark, sf))
    requests = spark.createDataFrame([(t, None) for t in TEXTS], "text string, station_name string")
    extraction = plan_of(ingest.complaint_rows(requests, F.lit(catalog.NOW)))
    assert adapters.complaint_texts(spark, sf).rdd.getNumPartitions() == 4
    assert "Python" not in extraction and "Exchange" not in extraction
    totals = plan_of(catalog.QUERIES["top_crimes"](spark, sf))
    assert "partial_count" in totals
    reads = [line for line in plan_of(catalog.QUERIES["best_profiles"](spark, sf)).splitlines() if "ReadSchema" in line]
    assert reads and all("o_orderdate" not in line for line in reads)


def test_library_does_not_import_the_training_data_package():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "casemill"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            tree = ast.parse(path.read_text())
            names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
            assert not any(".llm" in n for n in names), path
