"""Component kinds, repository keys and other scalar classifications."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Component kinds, in report order.
KINDS = ["library", "service", "cli", "contract", "infra", "pipeline", "frontend", "unknown"]
# Kinds that run.
EXECUTABLE_KINDS = ["service", "cli", "frontend", "pipeline"]
# Edge types.
EDGE_TYPES = ["depends_on", "calls", "reads_from", "writes_to", "integrates_with", "cited_by"]
# Communication protocols.
PROTOCOLS = [
    "http", "grpc", "graphql", "websocket", "message_queue", "event_bus",
    "shared_database", "shared_filesystem", "ipc", "unknown",
]
# External service categories.
SERVICE_CATEGORIES = [
    "database", "cache", "object_storage", "message_broker", "search", "monitoring",
    "logging", "auth", "payment", "email", "sms", "cdn", "dns", "blockchain", "ai_ml",
    "analytics", "other",
]


def one_of(value: Column, allowed: list[str], fallback: str) -> Column:
    low = F.lower(value)
    return F.when(low.isin(allowed), low).otherwise(F.lit(fallback))


def parse_kind(value: Column) -> Column:
    return one_of(value, KINDS, "unknown")


def is_library(kind: Column) -> Column:
    return kind == "library"


def is_executable(kind: Column) -> Column:
    return kind.isin(EXECUTABLE_KINDS)


def repo_key(source: Column) -> Column:
    """Repository name from a clone URL or a path."""
    github = F.regexp_extract(source, r"^https?://github\.com/[^/?#]+/([^/?#]+?)(?:\.git)?(?:[/?#].*)?$", 1)
    tail = F.regexp_extract(source, r"([^/]+)/*$", 1)
    return F.when(github != "", github).when(F.contains(source, F.lit("/")), tail).otherwise(source)


def slugify(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("__"))
