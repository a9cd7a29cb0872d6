"""Corpus audit: parse proposals, compare them with the deterministic graph, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repoloom.functions.text import balanced_span, json_variant
from repoloom.functions.running import ranks, running_totals

# Evidence types by expected category.
DYNAMIC_EVIDENCE = ["http_call", "shared_db", "other"]
MANIFEST_EVIDENCE = ["import", "path_dep"]
# USD per million tokens (model, input, output) and the tier of unknown models.
PRICES = [
    ("anthropic/claude-sonnet-4-6", "3.0", "15.0"),
    ("anthropic/claude-sonnet-4.6", "3.0", "15.0"),
    ("anthropic/claude-sonnet-4", "3.0", "15.0"),
    ("gpt-4o", "2.5", "10.0"),
    ("gpt-4o-mini", "0.15", "0.6"),
]
DEFAULT_PRICE = ("3.0", "15.0")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price string, output_price string")


FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def extract_json(answers: DataFrame) -> DataFrame:
    """(repo, status, doc VARIANT) from free-text answers (repo, raw).

    A fenced object is preferred, else the first balanced braces are tried
    (braces in strings count too); ``parse_failed`` when neither parses.
    """
    fenced = json_variant(F.nullif(F.regexp_extract("raw", FENCED, 1), F.lit("")))
    doc = F.when(fenced.isNotNull(), fenced).otherwise(json_variant(balanced_span(F.col("raw"), "{", "}")))
    return answers.select("repo", doc.alias("doc")).select(
        "repo", F.when(F.col("doc").isNull(), "parse_failed").otherwise("ok").alias("status"), "doc"
    )


def _rows(parsed: DataFrame, part: str, fields: dict[str, str]) -> DataFrame:
    items = parsed.filter("status = 'ok'").select("repo", F.posexplode(F.try_variant_get("doc", f"$.{part}", "array<variant>")).alias("pos", "v"))
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return items.select("repo", "pos", *[get(src).alias(dst) for src, dst in fields.items()])


def proposed_kinds(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "classifications", {"component_name": "component", "proposed_kind": "proposed", "evidence_file": "evidence_file", "reasoning": "reasoning"})


def proposed_edges(parsed: DataFrame) -> DataFrame:
    rows = _rows(parsed, "proposed_edges", {
        "source": "source", "target": "target", "evidence_type": "evidence_type", "evidence_file": "evidence_file",
        "evidence_lines": "evidence_lines", "evidence_snippet": "evidence_snippet", "reasoning": "reasoning",
    })
    return rows.withColumn("evidence_type", F.coalesce("evidence_type", F.lit("unknown")))


def missed_components(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "missed_components", {
        "proposed_name": "proposed_name", "proposed_root_path": "proposed_root_path", "proposed_kind": "proposed_kind",
        "evidence_file": "evidence_file", "reasoning": "reasoning",
    })


def kind_mismatches(components: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals (repo, component, proposed, …) whose kind differs from the inventory."""
    known = components.select("repo", F.col("name").alias("component"), F.col("kind").alias("deterministic"))
    return proposed.join(known, ["repo", "component"]).filter(F.col("deterministic") != F.col("proposed"))


def edge_category(evidence: Column, known: Column) -> Column:
    return (
        F.when(known, "agrees").when(evidence.isin(DYNAMIC_EVIDENCE), "dynamic_edge")
        .when(evidence.isin(MANIFEST_EVIDENCE), "plugin_gap").otherwise("ambiguous")
    )


def edge_discrepancies(components: DataFrame, edges: DataFrame, proposed: DataFrame, missed: DataFrame) -> DataFrame:
    """Proposed edges from a component or a proposed missed component that the
    deterministic graph lacks, with a category."""
    sources = components.select("repo", F.col("name").alias("source")).union(missed.select("repo", F.col("proposed_name").alias("source"))).distinct()
    some = edges.filter("edge_type = 'depends_on'") if "edge_type" in edges.columns else edges
    known = some.select("repo", "source", "target").distinct().withColumn("_known", F.lit(True))
    judged = proposed.join(sources, ["repo", "source"], "left_semi").join(known, ["repo", "source", "target"], "left")
    category = edge_category(F.coalesce("evidence_type", F.lit("unknown")), F.coalesce("_known", F.lit(False)))
    return judged.withColumn("category", category).drop("_known").filter("category <> 'agrees'")


def cost_ledger(usage: DataFrame, prices: DataFrame, budget: float) -> DataFrame:
    """Cost and cumulative cost per row of ``usage`` (seq, model, input_tokens,
    output_tokens), up to the row that reaches ``budget``.

    The budget is tested with the cost of the rows before, so the last row may
    overshoot. Prices are exact decimals; models not listed cost the default tier.
    """
    dec = lambda c, d: F.coalesce(c, F.lit(d)).cast("decimal(18,6)")
    priced = usage.join(prices, "model", "left")
    cost = (
        F.col("input_tokens").cast("decimal(18,0)") * dec(F.col("input_price"), DEFAULT_PRICE[0])
        + F.col("output_tokens").cast("decimal(18,0)") * dec(F.col("output_price"), DEFAULT_PRICE[1])
    )
    costed = priced.withColumn("_cost", cost.cast("decimal(30,6)")).drop("input_price", "output_price")
    run = running_totals(costed, [], ["seq"], {"_before": F.col("_cost")})
    # a narrow type before the division keeps all its digits
    usd = lambda c: (c.cast("decimal(28,6)") / 1_000_000).cast("decimal(30,12)")
    kept = run.filter(usd(F.col("_before")) < F.lit(budget).cast("decimal(30,12)"))
    return kept.select(*usage.columns, usd(F.col("_cost")).alias("cost_usd"), usd(F.col("_before") + F.col("_cost")).alias("cumulative_usd"))


def _by_language(findings: DataFrame, languages: DataFrame) -> DataFrame:
    known = languages.select("repo", "language")
    return findings.join(known, "repo", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def mismatch_report(mismatches: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, change, n): kind mismatches as 'a -> b', most frequent first when sorted by n."""
    change = F.concat("deterministic", F.lit(" -> "), "proposed")
    return _by_language(mismatches, languages).groupBy("language", change.alias("change")).agg(F.count("*").alias("n"))


def discrepancy_report(discrepancies: DataFrame, missed: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, metric, n): discrepancies by category, and missed components."""
    edges = _by_language(discrepancies, languages).groupBy("language", F.concat(F.lit("edge:"), "category").alias("metric")).agg(F.count("*").alias("n"))
    lost = _by_language(missed, languages).groupBy("language", F.lit("missed_components").alias("metric")).agg(F.count("*").alias("n"))
    return edges.unionByName(lost)


def findings(mismatches: DataFrame, discrepancies: DataFrame, languages: DataFrame) -> DataFrame:
    """Both kinds of finding as (language, bucket, repo, item)."""
    kinds = _by_language(mismatches, languages).select(
        "language", F.concat(F.lit("kind:"), "deterministic", F.lit(" -> "), "proposed").alias("bucket"), "repo", F.col("component").alias("item")
    )
    edges = _by_language(discrepancies, languages).select(
        "language", F.concat(F.lit("edge:"), "category").alias("bucket"), "repo", F.concat("source", F.lit(" -> "), "target").alias("item")
    )
    return kinds.unionByName(edges)


def exemplars(found: DataFrame, k: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Findings ranked per (language, bucket); the first ``k`` if given."""
    return ranks(found, ["language", "bucket"], order or ["repo", "item"], k)


def audit_totals(audits: DataFrame, discrepancies: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, repos_audited, plugin_gaps); audits of any status count."""
    repos = _by_language(audits.select("repo").distinct(), languages).groupBy("language").agg(F.count("*").alias("repos_audited"))
    gaps = _by_language(discrepancies.filter("category = 'plugin_gap'"), languages).groupBy("language").agg(F.count("*").alias("plugin_gaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return repos.join(gaps, "language", "full").select("language", zero("repos_audited"), zero("plugin_gaps"))


def audit_report(mismatches: DataFrame, discrepancies: DataFrame, missed: DataFrame, languages: DataFrame, k: int = 3) -> DataFrame:
    """(language, section, key, n, exemplars): the report, one row per counter
    with up to ``k`` exemplars."""
    counts = reduce(DataFrame.unionByName, [
        mismatch_report(mismatches, languages).select("language", F.concat(F.lit("kind:"), "change").alias("key"), "n"),
        discrepancy_report(discrepancies, missed, languages).select("language", F.col("metric").alias("key"), "n"),
    ])
    top = exemplars(findings(mismatches, discrepancies, languages), k)
    shown = top.groupBy("language", F.col("bucket").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "repo", "item"))), lambda s: F.concat(s["repo"], F.lit(": "), s["item"])).alias("exemplars")
    )
    return counts.join(shown, ["language", "key"], "left").select("language", "key", "n", "exemplars")
