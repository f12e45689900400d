"""Evaluation of recognition and correction runs, and aggregation of pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab as V
from casemill.functions.exprs import half_even, truthy

#: Newest logs whose entities the report looks at.
LATEST = 100
STAGES = ("ocr_runtime_ms", "correction_runtime_ms", "extraction_runtime_ms", "total_pipeline_runtime_ms")


def report_rows(logs: DataFrame, latest: int = LATEST) -> DataFrame:
    """The newest logs with the share of wanted entities that the corrected text has; bad JSON has none.

    Ordered top-k on each task and again on the driver side of the plan; nothing else is sorted.
    """
    top = logs.orderBy(F.desc("created_at"), F.asc("id")).limit(latest)
    entities = F.from_json("corrected_entities_json", "map<string,string>")
    present = {k: F.coalesce(truthy(F.try_element_at(entities, F.lit(k))), F.lit(False)) for k in V.EVALUATED_KEYS}
    share = sum((p.cast("int") for p in present.values()), F.lit(0)) / F.lit(float(len(present)))
    return top.select("id", "created_at", (~F.coalesce("was_rejected", F.lit(False))).alias("correction_accepted"), "rejection_reason", share.alias("coverage"), *(p.alias(f"has_{k}") for k, p in present.items()))


def evaluation_report(logs: DataFrame, samples: DataFrame, latest: int = LATEST) -> DataFrame:
    """One row: rates over all logs, entity coverage over the newest, mean confidence of the samples."""
    rejected = F.coalesce(F.col("was_rejected"), F.lit(False))
    totals = logs.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(rejected).alias("rejected_corrections"))
    rows = report_rows(logs, latest).agg(
        half_even(F.coalesce(F.avg("coverage"), F.lit(0.0)), 4).alias("extraction_accuracy"),
        *(F.count_if(~F.col(f"has_{k}")).alias(f"missing_{k}") for k in V.EVALUATED_KEYS),
    )
    confidence = samples.agg(half_even(F.coalesce(F.avg(F.col("confidence").cast("double")), F.lit(0.0)), 4).alias("confidence"))
    rate = F.when(F.col("total_samples") > 0, half_even((F.col("total_samples") - F.col("rejected_corrections")) / F.col("total_samples").cast("double"), 4)).otherwise(0.0)
    return totals.crossJoin(rows).crossJoin(confidence).withColumn("correction_acceptance_rate", rate)


def runtime_metrics(runs: DataFrame) -> DataFrame:
    """One row of totals and means over a table of runs, and its newest run."""

    def flag(name: str) -> Column:
        return F.count_if(F.coalesce(F.col(name), F.lit(False)))

    means = [half_even(F.coalesce(F.avg(F.coalesce(F.col(s).cast("double"), F.lit(0.0))), F.lit(0.0)), 2).alias(f"avg_{s}") for s in STAGES]
    last = F.max_by(F.struct("run_id", "correction_status"), F.struct("ts", "run_id"))
    return runs.agg(
        F.count(F.lit(1)).alias("total_requests"),
        flag("lightweight_mode").alias("lightweight_runs"),
        flag("timeout_detected").alias("timeout_runs"),
        flag("fallback_used").alias("fallback_runs"),
        F.count_if(F.col("correction_status").startswith("rejected")).alias("rejected_runs"),
        *means,
        last["run_id"].alias("last_run_id"),
        last["correction_status"].alias("last_correction_status"),
    )


def active_engine(usage: Column) -> Column:
    """The engine used most, the first of equals by its place in the map; `unknown` without any."""
    ranked = F.transform(F.map_entries(usage), lambda e, i: F.struct(e["value"].alias("n"), (-i).alias("place"), e["key"].alias("name")))
    return F.coalesce(F.array_max(F.filter(ranked, lambda e: e["n"].isNotNull()))["name"], F.lit("unknown"))


def document_pages(pages: DataFrame) -> DataFrame:
    """One row per document: texts joined in page order, mean confidence (0 to 1), arrays joined, time summed, engines counted.

    Grouping holds a document's pages together, which are as many as a scan has; engine counts are
    summed over exploded (engine, count) rows, pre-aggregated before the shuffle.
    """
    ordered = F.sort_array(F.collect_list(F.struct("page", "raw_text", "line_results", "uncertain_regions")))
    whole = pages.groupBy("document").agg(
        ordered.alias("_pages"),
        F.count(F.lit(1)).alias("pages"),
        half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.coalesce("confidence", F.lit(0.0))))), 4).alias("ocr_confidence"),
        F.sum(F.coalesce("processing_time_ms", F.lit(0.0))).alias("processing_time_ms"),
    )
    named = F.when(F.size(F.coalesce("engine_usage", F.create_map().cast("map<string,int>"))) > 0, F.col("engine_usage")).otherwise(F.create_map(F.coalesce("source_engine", F.lit("unknown")), F.lit(1)))
    used = pages.select("document", "page", F.explode(named).alias("engine", "n")).groupBy("document", "engine").agg(F.sum("n").cast("int").alias("n"), F.min("page").alias("first_page"))
    usage = used.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("first_page", "engine", "n"))).alias("_usage"))
    out = whole.join(usage, "document").select(
        "document",
        F.array_join(F.transform(F.filter("_pages", lambda p: truthy(p["raw_text"])), lambda p: p["raw_text"]), "\n").alias("text"),
        "ocr_confidence",
        F.flatten(F.transform("_pages", lambda p: F.coalesce(p["line_results"], F.array().cast(pages.schema["line_results"].dataType)))).alias("line_results"),
        F.flatten(F.transform("_pages", lambda p: F.coalesce(p["uncertain_regions"], F.array().cast(pages.schema["uncertain_regions"].dataType)))).alias("uncertain_regions"),
        "pages",
        "processing_time_ms",
        F.map_from_entries(F.transform("_usage", lambda u: F.struct(u["engine"], u["n"]))).alias("engine_usage"),
    )
    return out.withColumn("active_ocr_engine", active_engine(F.col("engine_usage"))).withColumn("ocr_engine", F.lit("ensemble"))


def best_profiles(runs: DataFrame) -> DataFrame:
    """The best-scored profile of each sample; of equal scores the last tried."""
    best = F.max_by(F.struct("profile", "score"), F.struct("score", "tried"))
    return runs.groupBy("sample").agg(best.alias("_best")).select("sample", F.col("_best.profile").alias("profile"), F.col("_best.score").alias("score"))


def stage_profile(rows: DataFrame) -> DataFrame:
    """Stage timings of each trace as one map: stage -> milliseconds, two decimals."""
    entries = F.collect_list(F.struct("stage", half_even(F.col("duration_ms"), 2)))
    return rows.groupBy("trace_id").agg(F.map_from_entries(F.sort_array(entries)).alias("stage_timings"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds a `position` to text blocks (page_id, block_id, x0, y0, x1, y1): rows from top to bottom, each from left to right.

    A block joins the row before it if its centre is within a tolerance of that row's mean centre, which
    changes as blocks join: a fold over the page's blocks in order of their centres. The window cannot express the
    running mean, so the page's blocks are folded as an array.
    """
    from casemill.operators.layout import ROW_SHARE, ROW_TOLERANCE

    mid = blocks.withColumns({"_cy": (F.col("y0") + F.col("y1")) / 2.0, "_cx": (F.col("x0") + F.col("x1")) / 2.0})
    pages = mid.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("_cy", "block_id", "_cx"))).alias("_blocks"),
        F.greatest(F.lit(ROW_TOLERANCE), F.avg(F.col("y1") - F.col("y0")) * ROW_SHARE).alias("_tolerance"),
    )
    state = "struct<row:int,total:double,n:int,placed:array<struct<row:int,cx:double,block_id:bigint>>>"
    start = F.from_json(F.lit('{"row":-1,"total":0,"n":0,"placed":[]}'), state)

    def place(acc: Column, b: Column) -> Column:
        same = (acc["n"] > 0) & (F.abs(b["_cy"] - acc["total"] / acc["n"]) <= F.col("_tolerance"))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        added = F.array(F.struct(row.alias("row"), b["_cx"].alias("cx"), b["block_id"].cast("bigint").alias("block_id")))
        return F.struct(
            row.alias("row"),
            (F.when(same, acc["total"]).otherwise(0.0) + b["_cy"]).alias("total"),
            (F.when(same, acc["n"]).otherwise(0) + 1).alias("n"),
            F.concat(acc["placed"], added).alias("placed"),
        ).cast(state)

    folded = pages.select("page_id", F.sort_array(F.aggregate("_blocks", start, place)["placed"]).alias("_placed"))
    return folded.select("page_id", F.posexplode("_placed").alias("position", "_p")).select("page_id", F.col("_p.block_id").alias("block_id"), F.col("_p.row").alias("row"), "position")

