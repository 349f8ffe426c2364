"""Every operator as a query over the sample tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollbook.functions.calendar import shifted
from tollbook.functions.categories import PREFERENCE_RULES, RECOMMENDATION_RULES
from tollbook.functions.folds import folded_window
from tollbook.plans.partials import approximate_spending, refresh_partials, tables_with_partials
from tollbook.plans.reports import REPORTS
from tollbook.schemas import seed_tables
from tollbook.session import shared_folder
from tollbook.sources import conform, sample_star
from tollbook.sources.load import load_extract, load_summary, refused_facts
from tollbook.sources.raw import FACT_HEADERS, read_raw
from tollbook.sources.tables import Tables, append_table, create_store, load_table, reset_facts
from tollbook.streaming.activity import activity_stream, append_to_files, customer_stream, open_activity, publish_open
from tollbook.streaming.freshness import freshness_stream, latest_health
from tollbook.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

PROFILES = {
    "events": (sample_star.events_tables, sample_star.EVENTS_AS_OF),
    "lineitem": (sample_star.lineitem_tables, sample_star.LINEITEM_AS_OF),
}

# Reports run on the line-item profile unless they are about hours, days or expiry.
ON_EVENTS = frozenset(
    (
        "dashboard_kpis",
        "sample_count",
        "sample_time_range",
        "customer_behavior_by_type",
        "customer_lifecycle",
        "customer_profile",
        "customer_recent_events",
        "data_bundles",
        "operations_breakdown",
        "daily_series",
        "usage_patterns",
        "usage_heatmap",
        "expiry_impact",
        "network_capacity",
        "dq_amount_anomalies",
        "dq_timestamp_issues",
        "activity_snapshot",
        "system_health",
        "health_status",
    )
)


def _report(name: str, profile: str, **parameters) -> Query:
    tables_of, as_of = PROFILES[profile]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REPORTS[name](tables_of(spark, sf_dir), as_of, **parameters)

    return query


def report_queries() -> dict[str, Query]:
    queries = {
        name: _report(name, "events" if name in ON_EVENTS else "lineitem") for name in REPORTS
    }
    for name, rules in (
        ("next_offer", RECOMMENDATION_RULES), ("customer_offer_preferences", PREFERENCE_RULES)
    ):
        *others, loans = rules.branches
        first = replace(rules, branches=(loans, *others))
        queries[f"{name}_loans_first"] = _report(name, "lineitem", rules=first)
    queries["kpi_summary_events"] = _report("kpi_summary", "events")
    queries["overall_stats_events"] = _report("overall_stats", "events")
    queries["balance_flow_events"] = _report("balance_flow", "events")
    queries["expiry_forecast_daily"] = _report("expiry_forecast", "events", grain="day")
    return queries


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.conform(sample_star.raw_tables(spark, sf_dir)[0])


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformed extract as a written table, for queries that need it several times."""
    folder = shared_folder(spark, "staged")
    _conformed(spark, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)


def _new_dimensions(
    spark: SparkSession, sf_dir: str, conformed: DataFrame
) -> dict[str, DataFrame]:
    """What one extract adds to the dimensions of a store that holds the seeds."""
    raw_offers, seeds = sample_star.raw_tables(spark, sf_dir)[1], seed_tables(spark)
    object_types = conform.build_object_types(conformed, seeds["object_types"])
    # The store below is taken to know operations 1 to 3 only, so that 4 and 5 are new.
    known = seeds["operation_types"].filter("operation_type_id <= 3")
    return {
        "customers": conform.build_customers(conformed),
        "object_types": object_types,
        "operation_types": conform.build_operation_types(
            conformed, known, seeds["operation_types"]
        ),
        "offers": conform.build_offers(conform.conform_offers(raw_offers), seeds["offers"]),
        "objects": conform.build_objects(
            conformed, seeds["object_types"].unionByName(object_types)
        ),
    }


def _dimension(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_dimensions(spark, sf_dir, _conformed(spark, sf_dir))[name]


FROM_PARTIALS = ("arpu", "balance_flow", "revenue_trend_by_type", "offer_trend")


def _with_partials(spark: SparkSession, sf_dir: str) -> Tables:
    """A store whose facts came in two appends, with partials refreshed after each."""
    tables_of, as_of = PROFILES["lineitem"]
    tables, root = tables_of(spark, sf_dir), shared_folder(spark, "store")
    create_store(spark, root)
    early = F.col("creation_time") < shifted(as_of, -6, "MONTH")
    for part in (early, ~early):
        append_table(tables["cdr_events"].filter(part), root, "cdr_events")
        refresh_partials(spark, root)
    stored = tables_with_partials(spark, root)
    return {**stored, **{name: tables[name] for name in ("customers", "offers")}}


def _from_partials(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REPORTS[name](_with_partials(spark, sf_dir), PROFILES["lineitem"][1])


def spending_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of a year, and whether the sketches come as close to them, and to the median and
    the 80th percentile of a customer's spending in a month, as they promise."""
    tables, as_of = _with_partials(spark, sf_dir), PROFILES["lineitem"][1]
    guess = approximate_spending(tables, as_of)
    folded = folded_window(tables, "customer_months", as_of, 12)
    spent = F.coalesce("deducted", F.lit(0)).cast("double")
    spending, customers = guess.select("spending").scalar(), guess.select("active_customers").scalar()
    below = lambda n: F.avg((spent < spending.getItem(n)).cast("double"))
    up_to = lambda n: F.avg((spent <= spending.getItem(n)).cast("double"))
    counted = folded.agg(
        F.count_distinct("cust_num").alias("active_customers"),
        *(f(n).alias(f"{name}{n}") for n in (0, 1) for name, f in (("below", below), ("up_to", up_to))),
    )
    close = [(F.col(f"below{n}") <= share + 0.02) & (F.col(f"up_to{n}") >= share - 0.02) for n, share in ((0, 0.5), (1, 0.8))]
    return counted.select(
        "active_customers",
        (F.abs(customers - F.col("active_customers")) <= 0.05 * F.col("active_customers")).alias("customers_close"),
        (close[0] & close[1]).alias("percentiles_close"),
    )


def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract written to JSON lines and read back as a raw source."""
    folder = shared_folder(spark, "extract")
    sample_star.raw_tables(spark, sf_dir)[0].write.json(folder)
    back = read_raw(spark, folder, "json", columns=FACT_HEADERS)
    return conform.normalize_headers(back)


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts appended to a new store in two parts and scanned back."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    facts = sample_star.events_tables(spark, sf_dir)["cdr_events"]
    middle = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"
    append_table(facts.filter(f"creation_time < {middle}"), root, "cdr_events")
    append_table(facts.filter(f"creation_time >= {middle}"), root, "cdr_events")
    return _amounts_out(load_table(spark, root, "cdr_events"))


def ingest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.normalize_headers(sample_star.raw_tables(spark, sf_dir)[0])


def ingest_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.rename(ingest_normalize(spark, sf_dir), conform.FACT_NAMES)


def ingest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.project_known(ingest_rename(spark, sf_dir), conform.FACT_COLUMNS)


def _amounts_out(frame: DataFrame) -> DataFrame:
    names = [n for n in conform.AMOUNT_COLUMNS if n in frame.columns]
    return frame.withColumns({n: F.col(n).cast("double") for n in names})


def ingest_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts_out(conform.coerce_numeric(ingest_project(spark, sf_dir)))


def ingest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = conform.coerce_numeric(ingest_project(spark, sf_dir))
    return _amounts_out(conform.fill_amounts(typed))


def ingest_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.parse_times(ingest_project(spark, sf_dir)).select(
        "cdr_id", *conform.TIME_COLUMNS
    )


def ingest_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = conform.drop_invalid(_conformed(spark, sf_dir))
    return _amounts_out(conform.project_known(valid, conform.FACT_COLUMNS))


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.quarantine(_conformed(spark, sf_dir)).select(
        *conform.REQUIRED_COLUMNS, "object_id", "missing_columns"
    )


def _known_before(valid: DataFrame) -> DataFrame:
    """The facts of the first ten days, taken as an earlier load of the same feed."""
    return conform.new_events(valid.filter("creation_time < TIMESTAMP_NTZ '2024-01-11 00:00:00'"))


def ingest_events_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = conform.drop_invalid(_conformed(spark, sf_dir))
    return _amounts_out(conform.new_events(valid, _known_before(valid))).drop("cdr_event_id")


def _referenced(
    spark: SparkSession, conformed: DataFrame, dimensions: dict[str, DataFrame]
) -> DataFrame:
    seeds = seed_tables(spark)
    return conform.enforce_references(
        conform.new_events(conform.drop_invalid(conformed)),
        dimensions["customers"],
        dimensions["objects"].join(dimensions["customers"], "cust_num_bigint", "left_semi"),
        dimensions["offers"].unionByName(seeds["offers"]),
        seeds["operation_types"],
    )


def ingest_fk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(spark, sf_dir)
    facts = _referenced(spark, staged, _new_dimensions(spark, sf_dir, staged))
    return _amounts_out(facts).drop("cdr_event_id")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(spark, sf_dir)
    dimensions = _new_dimensions(spark, sf_dir, staged)
    offered = {
        "customers": staged.select("cust_num"),
        "object_types": staged.select("object_type_code"),
        "operation_types": staged.select("operation_type_id"),
        "offers": conform.conform_offers(sample_star.raw_tables(spark, sf_dir)[1]).select(
            "offer_id"
        ),
        "objects": staged.select("object_id"),
    }
    attempted = {name: keys.distinct().na.drop() for name, keys in offered.items()}
    return load_summary(
        {**attempted, "cdr_events": staged},
        {**dimensions, "cdr_events": _referenced(spark, staged, dimensions)},
    )


def ingest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole load into a new store, and the facts read back from it."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    load_extract(spark, root, *sample_star.raw_tables(spark, sf_dir))
    return _amounts_out(load_table(spark, root, "cdr_events")).drop("cdr_event_id")


def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole load left out, by reason: rows without a required column, facts with unknown
    references, and repeats. With the stored facts these are all rows of the extract."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    result = load_extract(spark, root, *sample_star.raw_tables(spark, sf_dir))
    missing = spark.read.parquet(os.path.join(root, "_quarantine", "*"))
    left = missing.select(F.concat(F.lit("missing "), "missing_columns").alias("reason"))
    left = left.unionByName(refused_facts(spark, root).select(F.col("refused_because").alias("reason")))
    counted = left.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))
    repeats = spark.range(1).select(
        F.lit("repeated").alias("reason"), F.lit(result.repeated).cast("bigint").alias("rejected")
    )
    return counted.unionByName(repeats)


def facts_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, a reset of the facts, the same load again, and the facts read back."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    extract = sample_star.raw_tables(spark, sf_dir)
    load_extract(spark, root, *extract)
    reset_facts(spark, root)
    load_extract(spark, root, *extract)
    return _amounts_out(load_table(spark, root, "cdr_events")).drop("cdr_event_id")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = spark.readStream.schema(sample_star.SAMPLE_COLUMNS["events"])
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_star.facts_of_events(_events_stream(spark, sf_dir))


def stream_activity(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    folder = shared_folder(spark, "activity")
    target = os.path.join(folder, "windows")
    stream = activity_stream(_fact_stream(spark, sf_dir), width)
    append_to_files(stream, target, os.path.join(folder, "checkpoint"))
    return spark.read.parquet(target)


def stream_activity_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "activity")
    target = os.path.join(folder, "versions")
    publish_open(customer_stream(_fact_stream(spark, sf_dir)), target, os.path.join(folder, "checkpoint")).awaitTermination()
    return open_activity(spark, target)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "store")
    create_store(spark, root)
    raw = sample_star.raw_extract(_events_stream(spark, sf_dir))
    ingest_stream(raw, root, os.path.join(root, "_checkpoint")).awaitTermination()
    return _amounts_out(load_table(spark, root, "cdr_events")).drop("cdr_event_id")


def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "freshness")
    reports = os.path.join(folder, "reports")
    freshness_stream(
        _fact_stream(spark, sf_dir),
        sample_star.EVENTS_AS_OF,
        reports,
        os.path.join(folder, "checkpoint"),
    ).awaitTermination()
    return latest_health(spark, reports)


def ingest_queries() -> dict[str, Query]:
    steps = (
        raw_source,
        table_append,
        ingest_normalize,
        ingest_rename,
        ingest_project,
        ingest_cast,
        ingest_fill,
        ingest_ts,
        ingest_required,
        ingest_quarantine,
        ingest_events_incremental,
        ingest_fk_filter,
        ingest_counts,
        ingest_load,
        ingest_rejected,
        facts_reset,
    )
    queries = {step.__name__: step for step in steps}
    for name in ("customers", "object_types", "offers", "operation_types", "objects"):
        queries[f"ingest_{name}"] = partial(_dimension, name)
    return queries


def stream_queries() -> dict[str, Query]:
    return {
        "stream_activity": stream_activity,
        "stream_activity_daily": partial(stream_activity, width="1 day"),
        "stream_activity_open": stream_activity_open,
        "stream_ingest": stream_ingest,
        "stream_freshness": stream_freshness,
    }


def partial_queries() -> dict[str, Query]:
    queries = {f"{name}_from_partials": partial(_from_partials, name) for name in FROM_PARTIALS}
    return {**queries, "spending_sketches": spending_sketches}


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **partial_queries(), **ingest_queries(), **stream_queries()}
