"""Reports over events, judged retrieval, and session references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Events that count as a finished call and as a formatted answer, and the limits of the latency bands.
FINISHED, FORMATTED = "mcp.tool.finished", "mcp.tool.response_formatted"
BANDS_MS = (100, 1_000)
SESSION_MINUTES, KNOWN_IDS = 15, 64


def _number(col: Column) -> Column:
    n = col.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def event_report(events: DataFrame, *, finished: str = FINISHED, formatted: str = FORMATTED) -> DataFrame:
    """One row: calls, sums of tokens, full and reference answers, and calls per latency band. events: event and data, a
    map of text; what isn't a number counts as 0."""
    done, sent = F.col("event") == finished, F.col("event") == formatted
    value = lambda k: _number(F.try_element_at("data", F.lit(k)))
    reference = F.coalesce(F.try_element_at("data", F.lit("responseRepresentation")) == "reference", F.lit(False))
    ms = value("durationMs")
    calls, answers, references = F.count_if(done), F.count_if(sent), F.count_if(done & reference)
    total = lambda cond, k: F.coalesce(F.sum(F.when(cond, value(k))), F.lit(0.0)).cast("bigint")
    return events.agg(
        calls.cast("bigint").alias("calls"), total(done, "tokenBudgetUsed").alias("token_budget_total"), total(sent, "tokens").alias("delivered_tokens"), total(sent & ~reference, "savedTokens").alias("saved_tokens"),
        (F.count_if(sent & reference) + F.greatest(F.lit(0), calls - answers)).cast("bigint").alias("unavailable_savings"), (calls - references).cast("bigint").alias("full_responses"), references.cast("bigint").alias("reference_responses"),
        F.count_if(done & (ms < BANDS_MS[0])).cast("bigint").alias("under_100_ms"), F.count_if(done & (ms >= BANDS_MS[0]) & (ms < BANDS_MS[1])).cast("bigint").alias("under_1000_ms"), F.count_if(done & (ms >= BANDS_MS[1])).cast("bigint").alias("over_1000_ms"),
    )


def latency_bands(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Calls per latency band of a column, and its nearest-rank percentiles 50 and 95, per group."""
    v = F.col(value)
    return rows.groupBy(by).agg(
        F.count("*").cast("bigint").alias("calls"), F.count_if(v < BANDS_MS[0]).cast("bigint").alias("under_100"), F.count_if((v >= BANDS_MS[0]) & (v < BANDS_MS[1])).cast("bigint").alias("under_1000"), F.count_if(v >= BANDS_MS[1]).cast("bigint").alias("over_1000"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
    )


def recent_events(events: DataFrame, days: int = 3, now: Column | None = None) -> DataFrame:
    """Events that aren't older than some days; events without a time are kept."""
    now = F.current_timestamp() if now is None else now
    return events.where(F.col("ts").isNull() | (F.col("ts") >= now - F.make_dt_interval(F.lit(days))))


def session_references(answers: DataFrame, *, session: str = "session", ts: str = "ts", content: str = "content_id", tie: str | None = None, minutes: int = SESSION_MINUTES) -> DataFrame:
    """The answers with representation: reference if the session has had this content before and has not been silent
    for `minutes` since, else full. Sessions end when nothing is asked for that long. The cap on known ids of a session
    is the streaming form's; see streaming.sessions."""
    order = [F.col(ts).asc()] + ([F.col(tie).asc()] if tie else [])
    own = Window.partitionBy(session).orderBy(*order)
    gap = F.col(ts).cast("timestamp") - F.lag(F.col(ts).cast("timestamp")).over(own) >= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    spans = answers.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.row_number().over(Window.partitionBy(session, "_span", content).orderBy(*order)) > 1
    return spans.withColumn("representation", F.when(seen, "reference").otherwise("full")).drop("_new", "_span")


# -- judged retrieval


def evidence_ranks(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """task, target, rank of the first evidence that is (mode exact) or holds (mode contains) the target; null for none.

    targets: task, target, mode; evidence: task, rank, text. Evidence of a task is bounded by its result limit.
    """
    hit = F.when(F.col("mode") == "exact", F.col("text") == F.col("target")).otherwise(F.col("text").contains(F.col("target")))
    return targets.join(evidence, "task", "left").groupBy("task", "target", "mode").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def task_metrics(ranks: DataFrame) -> DataFrame:
    """Per task: targets, hits, recall_pct, first_rank, reciprocal_rank, precision_at_3, top1 and top3."""
    first = F.min("rank")
    return ranks.groupBy("task").agg(
        F.count("*").cast("bigint").alias("targets"), F.count("rank").cast("bigint").alias("hits"), F.round(100.0 * F.count("rank") / F.count("*"), 1).alias("recall_pct"), first.cast("bigint").alias("first_rank"),
        F.coalesce(F.round(1.0 / first, 3), F.lit(0.0)).alias("reciprocal_rank"), F.round(F.count_if(F.col("rank") <= 3) / 3.0, 3).alias("precision_at_3"), F.coalesce(first == 1, F.lit(False)).alias("top1"), F.coalesce(first <= 3, F.lit(False)).alias("top3"),
    )


def metrics_summary(tasks: DataFrame, by: str | None = None) -> DataFrame:
    """Sums and means over tasks, per value of a column and in total (null)."""
    aggregates = [
        F.count("*").cast("bigint").alias("tasks"), F.sum("targets").cast("bigint").alias("targets"), F.sum("hits").cast("bigint").alias("hits"), F.round(100.0 * F.sum("hits") / F.sum("targets"), 1).alias("recall_pct"),
        F.round(F.avg("reciprocal_rank"), 3).alias("mean_reciprocal_rank"), F.round(F.avg("precision_at_3"), 3).alias("mean_precision_at_3"), F.count_if(F.col("top1")).cast("bigint").alias("top1"), F.count_if(F.col("top3")).cast("bigint").alias("top3"),
    ]
    return tasks.rollup(by).agg(*aggregates) if by else tasks.agg(*aggregates)


def baseline_tokens(files: DataFrame, allowed) -> DataFrame:
    """One row: files and tokens (a quarter of the characters) of all contents whose path is allowed."""
    from lodeglass.functions.text import matches_allowed, token_estimate

    own = files.where(matches_allowed(F.col("path"), allowed) & F.col("content").isNotNull())
    return own.agg(F.count("*").cast("bigint").alias("files"), F.coalesce(F.sum(token_estimate("content")), F.lit(0)).cast("bigint").alias("tokens"))


def first_occurrences(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key with the first position it has."""
    return rows.groupBy(key).agg(F.min(position).alias(position))
