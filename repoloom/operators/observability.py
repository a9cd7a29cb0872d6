"""Traces of analysis runs and token accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoloom.functions.running import previous_rows, running_totals

# Limits and marks for values in logs.
MAX_TEXT = 500
MAX_ITEMS = 10
CUT_MARK = "...(truncated)"


def pair_traces(records: DataFrame) -> DataFrame:
    """Completed actions from start / end records.

    ``records``: (session_id, action, ts, sequence_id, phase). An end closes
    the start just before it in its (session, action); a start followed by
    another start is lost, an end without start is ignored.
    """
    records = records.withColumn("ts", F.col("ts").cast("timestamp"))
    prior = previous_rows(records, ["session_id", "action"], ["ts", "sequence_id"], ["phase", "ts", "sequence_id"])
    closed = prior.filter((F.col("phase") == "end") & (F.col("prev.phase") == "start"))
    micros = F.unix_micros("ts") - F.unix_micros("prev.ts")
    return closed.select(
        "session_id", "action", F.col("prev.sequence_id").alias("sequence_id"), F.col("prev.ts").alias("start_ts"),
        F.col("ts").alias("end_ts"), (micros / 1000).alias("duration_ms"),
    )


def trace_summary(traces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, actions, errors).

    totals: one row; actions: per action with tags and source of its first
    trace; errors: one row per failed trace. Missing numbers count as 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = traces.agg(
        F.count("*").alias("total_actions"), zero(F.sum(zero(F.col("duration_ms")))).alias("total_duration_ms"),
        zero(F.sum(F.col("token_usage.input"))).alias("total_input_tokens"),
        zero(F.sum(F.col("token_usage.output"))).alias("total_output_tokens"),
    )
    first = F.struct("timestamp", "sequence_id")
    source = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    actions = traces.groupBy("action").agg(
        F.count("*").alias("count"), F.sum(zero(F.col("duration_ms"))).alias("total_duration_ms"),
        F.min_by("tags", first).alias("tags"),
        F.min_by(F.when(F.col("source_file").isNotNull(), source), first).alias("source"),
    )
    errors = traces.filter(F.coalesce("error", F.lit("")) != "").select("action", "timestamp", "sequence_id", "error")
    return totals, actions, errors


def token_ledger(messages: DataFrame) -> DataFrame:
    """Add cumulative input and output tokens along each conversation.

    ``messages``: (conv_id, turn, input_tokens, output_tokens).
    """
    run = running_totals(
        messages, ["conv_id"], ["turn"],
        {"_in": F.col("input_tokens"), "_out": F.col("output_tokens")},
    )
    return run.select(
        *messages.columns, (F.col("_in") + F.col("input_tokens")).alias("input_so_far"),
        (F.col("_out") + F.col("output_tokens")).alias("output_so_far"),
    )


def truncate_text(value: Column, max_text: int = MAX_TEXT) -> Column:
    return F.when(F.length(value) > max_text, F.concat(F.substring(value, 1, max_text), F.lit(CUT_MARK))).otherwise(value)


def truncate_items(value: Column, max_items: int = MAX_ITEMS) -> Column:
    """JSON of an array, or its size when it is long."""
    return F.when(F.size(value) > max_items, F.concat(F.lit("["), F.size(value).cast("string"), F.lit(" items]"))).otherwise(F.to_json(value))


def truncate_map(value: Column, max_text: int = MAX_TEXT) -> Column:
    """JSON of a map, or its number of keys when it is long."""
    text = F.to_json(value)
    return F.when(F.length(text) > max_text, F.concat(F.lit("{..."), F.size(value).cast("string"), F.lit(" keys}"))).otherwise(text)


def truncate_values(rows: DataFrame, max_text: int = MAX_TEXT, max_items: int = MAX_ITEMS, whole: str | None = None) -> DataFrame:
    """Shorten every text, array and map column of ``rows`` for logs.

    With ``whole`` each of them stays as it is, and what is shown in a log
    stands beside it in a column of the same name with that ending.
    """
    shorten = {
        "string": lambda c: truncate_text(c, max_text),
        "array": lambda c: truncate_items(c, max_items),
        "map": lambda c: truncate_map(c, max_text),
    }
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    col = lambda name: F.col("`" + name.replace("`", "``") + "`")
    short = {name: shorten[kind](col(name)) for name, kind in kinds.items() if kind in shorten}
    if whole is None:
        return rows.select(*[short[name].alias(name) if name in short else col(name) for name in kinds])
    taken = [name + whole for name in short if name + whole in kinds]
    if not whole or taken:
        raise ValueError(f"ending {whole!r} gives columns that are there already: {taken}")
    return rows.select(*[col(name) for name in kinds], *[c.alias(name + whole) for name, c in short.items()])
