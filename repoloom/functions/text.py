"""Column expressions over file contents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

NEWLINE = r"\r\n|\r|\n"


def lines(content: Column) -> Column:
    """Lines of a text; a final newline opens no further line."""
    parts = F.split(content, NEWLINE)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def line_count(content: Column) -> Column:
    return F.size(lines(content))


def json_variant(text: Column) -> Column:
    """Parsed JSON, null for broken text. Of a key given twice the last value counts:
    the session setting for that is switched on, as the parser refuses such objects otherwise."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


# Names of JSON types in messages.
JSON_TYPE_NAMES = {
    "OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float",
    "BOOLEAN": "bool", "VOID": "NoneType",
}


def json_type(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def json_type_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in JSON_TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, kind), kind)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def balanced_span(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the ``closing`` that balances it, null if none does.

    A running depth over the brackets alone, each with the text before it, so
    the cost is one step per bracket whatever the text's length.
    """
    tail = F.substr(text, F.nullif(F.instr(text, opening), F.lit(0)))
    both = re.escape(opening) + re.escape(closing)
    parts = F.regexp_extract_all(tail, F.lit(f"(?s)[^{both}]*[{both}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(F.endswith(part, F.lit(opening)), 1).otherwise(-1)
        at = acc["at"] + F.length(part)
        end = F.when(acc["end"] > 0, acc["end"]).when(depth == 0, at).otherwise(0)
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(parts, start, step)["end"]
    return F.when(end > 0, F.substr(tail, F.lit(1), end))


def balanced_spans(text: Column, head: str, opening: str = "(", closing: str = ")") -> Column:
    """The outermost spans ``head … closing`` whose brackets balance, in order.

    ``head`` is a pattern that ends before its opening bracket. The text is
    parted at the heads; a head that stands inside an open span belongs to it.
    """
    parts = F.split(text, f"(?={head}\\s*{re.escape(opening)})")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        now = F.concat(acc["open"], part)
        usable = (acc["open"] != "") | F.rlike(part, F.lit(f"^{head}\\s*{re.escape(opening)}"))
        span = F.when(usable, F.concat(F.substring_index(now, opening, 1), balanced_span(now, opening, closing)))
        return F.struct(
            F.when(usable & span.isNull(), now).otherwise("").alias("open"),
            F.when(span.isNotNull(), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step)["spans"]


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any run of ``chars`` (a regex character class body) at both ends."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def hit_mask(text: Column, words: list[str]) -> Column:
    """Bit i is set when ``words[i]`` occurs in ``text``; merge with ``bit_or``."""
    bits = [
        F.when(F.contains(text, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, w in enumerate(words)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")


def named_import(text: Column, modules: list[str]) -> Column:
    """Does a line import one of ``modules`` (whole word)?"""
    return F.rlike(text, F.lit(r"(?m)^\s*(?:from|import)\s+(?:" + "|".join(modules) + r")\b"))
