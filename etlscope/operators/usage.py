"""Analytics over a usage log: one row a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in an error text and the label they stand for; the first match wins, other texts are unknown.
ERROR_KINDS = (
    ("memory_error", ("memory",)),
    ("timeout", ("timeout",)),
    ("ddl_error", ("ddl",)),
    ("parse_error", ("parse", "sqlglot", "syntax", "tokenize")),
    ("io_error", ("io", "file", "permission", "notfound", "errno", "is a directory")),
)
COLUMNS = ("run_id", "trace_id", "ts", "install_id", "command", "input_type", "asset", "target_table", "elapsed_sec", "status", "error_type", "agent_version", "os")


def usage_from_events(events: DataFrame) -> DataFrame:
    """A usage log derived from the events table."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("run_id"), F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), "ts", F.col("user_id").alias("install_id"), F.col("event_type").alias("command"),
        F.when(k % 2 == 0, "file").otherwise("dir").alias("input_type"), F.concat(F.lit("a"), (k % 7).cast("string")).alias("asset"), F.when(k % 3 == 0, F.concat(F.lit("t"), (k % 11).cast("string"))).alias("target_table"),
        F.col("value").cast("decimal(18,4)").alias("elapsed_sec"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("parse"), F.lit("missing"), F.lit("memory")), (k % 3) + 1)).alias("error_type"),
        F.concat(F.lit("1."), (k % 4).cast("string")).alias("agent_version"), F.element_at(F.array(F.lit("linux"), F.lit("mac")), (k % 2) + 1).alias("os"), "props",
    )


def deduplicated(log: DataFrame) -> DataFrame:
    """One row a run_id: the earliest by ts, then by all its values."""
    rest = [c for c in log.columns if c not in ("run_id", "ts")]
    first = F.min(F.struct("ts", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("tie"), F.struct(*rest).alias("row"))).alias("first")
    best = log.groupBy("run_id").agg(first)
    return best.select("run_id", "first.ts", "first.row.*").select(*log.columns)


def folded(log: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The known columns, null where the log lacks one, and all others as one JSON text ``extra`` (null if there is none)."""
    more = [c for c in log.columns if c not in columns and c != "extra"]
    extra = F.when(F.coalesce(*[F.col(c).cast("string") for c in more], F.lit(None).cast("string")).isNotNull(), F.to_json(F.struct(*more))) if more else F.lit(None).cast("string")
    return log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in columns], extra.alias("extra"))


def ingest(log: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``log`` that the store does not have yet, one for each run, unknown columns folded."""
    return folded(deduplicated(log).join(stored.select("run_id").distinct(), "run_id", "left_anti"))


def overview(log: DataFrame) -> DataFrame:
    ok, bad = F.col("status") == "ok", F.col("status") == "error"
    return log.agg(
        F.count("*").alias("runs"), F.count_distinct("install_id").alias("installs"), F.count_distinct(F.coalesce("trace_id", F.col("run_id").cast("string"))).alias("sessions"),
        F.count_if(ok).alias("n_ok"), F.count_if(bad).alias("n_error"), F.round(F.avg("elapsed_sec"), 2).cast("double").alias("avg_sec"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def daily_active(log: DataFrame, days: int = 30) -> DataFrame:
    """The last ``days`` days of the log, by its own clock."""
    last = log.agg(F.max(F.to_date("ts")).alias("last"))
    recent = log.join(F.broadcast(last), F.to_date("ts") > F.date_sub("last", days))  # one row
    return recent.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.count_distinct("install_id").alias("installs"))


def heat(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias("runs"), F.max("ts").alias("last_ts"))


def top(log: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    return log.groupBy(key.alias(name)).agg(F.count("*").alias("runs"), F.max("ts").alias("last_ts")).orderBy(F.desc("runs"), name).limit(n)


def errors(log: DataFrame) -> DataFrame:
    return log.where("status = 'error'").groupBy("error_type").agg(F.count("*").alias("runs"))


def input_types(log: DataFrame, without: str) -> DataFrame:
    return log.where(F.col("command") != without).groupBy("input_type").agg(F.count("*").alias("runs"))


def spread(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias("runs"), F.count_distinct("install_id").alias("installs"))


def trace_pairs(log: DataFrame, first: str, then: str, n: int = 20) -> DataFrame:
    """The latest runs of ``then`` with the runs of ``first`` in the same trace; k and the total of both durations."""
    a = log.where(F.col("command") == first).select("trace_id", F.col("run_id").alias("first_run"), F.col("elapsed_sec").alias("sec_a"))
    b = log.where(F.col("command").startswith(then)).select("trace_id", F.col("run_id").alias("then_run"), F.col("elapsed_sec").alias("sec_b"), "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pairs = b.join(a, "trace_id").select("trace_id", "first_run", "then_run", "k", "ts", F.round(F.col("sec_a") + F.col("sec_b"), 2).cast("double").alias("total_sec"))
    return pairs.orderBy(F.desc("ts"), "then_run", "first_run").limit(n)


def error_label(text: Column) -> Column:
    """Label of an error text; empty for none."""
    out = F.lit("unknown")
    for label, words in reversed(ERROR_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(out)
