"""Surrogates for personal data.

Entities (mail addresses, phone numbers, card and account numbers, social
security numbers, IPv4 addresses, titled names) are replaced in place by
surrogates of the same type, format, script and, for names, gender. A
surrogate is the image of the entity's canonical form under a keyed
permutation of all strings of the same shape (a Feistel network on the mixed
radix number that the string is): letters stay letters of their script and
case, vowels vowels, digits digits, signs and layout stay. A given name between a
title that tells a gender and a surname becomes a given name of that gender,
made of syllables of its script. A person's gender is what all titles before
the name agree on in the whole corpus; without a title that tells, or where
they differ, none. The same entity gets the same surrogate everywhere,
different ones get different ones.

A surrogate can still be somebody else's real value. A distributed check joins
all surrogates with all entities of the corpus; entities that collide, or that
share a surrogate, take the next image. Where a shape has fewer free strings
than values, or does not settle in ``TURNS`` images, all its values keep their
first image: one permutation, so they stay distinct; those that equal another
real value are marked ``real`` in the table and counted in a warning (made
given names have millions of forms per surname, so theirs settle). The few
exceptions are joined back to the documents that need them, broadcast only
below a counted size.

Defined cases: null text stays null, texts without entities stay as they are.
Repeated rows get equal results. Rows without an id are rewritten without
exceptions' help only if no exception touches them; ids are whole numbers and
should be set. Other columns pass, whatever their names. An
empty table gives no rows. Positions are code points of the original text.
"""

from __future__ import annotations

import hashlib
import hmac
import logging
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.runtime import stage

#: Titles before a name, by the gender they tell; fixed values of the languages covered.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña"]
OTHER_TITLES = ["Dr", "Prof", "Doctor", "Professor", "Mx"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Paul", "Mark", "Peter", "Hans", "Karl", "Pierre", "Jean", "Luis", "Carlos", "Juan"]
FEMALE_NAMES = ["Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Emma", "Julia", "Alice", "Maria", "Greta", "Heidi", "Claire", "Marie", "Carmen", "Elena", "Lucia"]

#: Onsets, vowels and endings by gender of made given names; fixed values of the scripts covered.
_GIVEN = {
    "LATIN": ("b d f g h j k l m n p r s t v z".split(), "a e i o u".split(), {"f": "a ia ina ella etta essa".split(), "m": "an ard en ik o us".split()}),
    "CYRILLIC": ("б в г д з к л м н п р с т ф".split(), "а е и о у".split(), {"f": "а ия ина ена юша яна".split(), "m": "ан ей ий ил ислав ор".split()}),
    "GREEK": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split(), {"f": "α ία ίνα ούλα ώ".split(), "m": "ας ης ιος ος ων".split()}),
}
_SYLLABLES = 3

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))
_WORD = r"[^\W\d_][\w'’-]*"
#: kind and pattern, in order of precedence where spans overlap.
DETECTORS = [
    # the host; what may stand before it is taken from there to the left
    ("email", re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w])|(?<![\w.])\+\d{8,14}(?![\w])")),
    ("name", re.compile(rf"\b(?:{_TITLES})\.?\x20((?-i:(?=[^\W\d_a-z])){_WORD}(?:\x20(?=[^\W\d_a-zà-ÿ]){_WORD})?)")),
]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A document holds mail addresses, numbers or titles only if it holds one of these.
_DIGIT = re.compile(r"\d")

#: Alphabets within which a character is replaced; fixed values of the scripts covered.
_ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ",
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
    "".join(map(chr, range(0x3B1, 0x3C2))), "".join(map(chr, range(0x391, 0x3A2))),
]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
#: Scripts whose letters are one long row.
_ROWS = ["".join(map(chr, range(0x4E00, 0xA000))), "".join(map(chr, range(0xAC00, 0xD7A4)))]
#: Images a value takes before its shape counts as not settling.
TURNS = 50


@cache
def _block(number: int, category: str) -> str:
    """The letters of one category among 64 neighbouring characters that no alphabet has."""
    return "".join(c for c in map(chr, range(64 * number, 64 * number + 64)) if c not in _PLACE and unicodedata.category(c) == category)


def _alphabet(c: str) -> tuple[str, int] | None:
    """The characters among which one gets replaced, and its place there."""
    if c in _PLACE:
        return _PLACE[c]
    for row in _ROWS:
        if row[0] <= c <= row[-1]:
            return row, ord(c) - ord(row[0])
    if c.isalpha() and not c.isascii():
        block = _block(ord(c) >> 6, unicodedata.category(c))
        return block, block.index(c)
    return None


def _permuted(key: bytes, tweak: bytes, number: int, size: int) -> int:
    """Keyed permutation of 0 … size - 1: a balanced Feistel network, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for turn in range(8):
            mixed = hmac.digest(key, tweak + bytes([turn]) + right.to_bytes((half + 7) // 8, "big"), "sha256")
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        number = left << half | right
        if number < size:
            return number


def _image(key: bytes, kind: str, value: str, valid: Callable[[str], bool]) -> str:
    """Image of ``value`` among the valid strings of its shape."""
    places = [(i, len(d[0]), d[1]) for i, c in enumerate(value) if (d := _alphabet(c))]
    size = 1
    for _, radix, _ in places:
        size *= radix
    shape = "".join("?" if _alphabet(c) else c for c in value)
    tweak = hashlib.sha256(f"{kind}|{shape}|{[p[1] for p in places]}".encode()).digest()
    number = 0
    for _, radix, digit in places:
        number = number * radix + digit
    for _ in range(10_000):
        number = _permuted(key, tweak, number, size)
        out, rest = list(value), number
        for i, radix, _ in reversed(places):
            rest, digit = divmod(rest, radix)
            out[i] = _alphabet(value[i])[0][digit]
        if valid("".join(out)):
            return "".join(out)
    return "".join(out)


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _like_phone(value: str) -> Callable[[str], bool]:
    """Area code and exchange of ten-digit numbers keep a leading digit of 2 to 9 where they have one, and only there."""
    leads = {i: value[i] in "23456789" for i in (0, 3) if len(value) == 10}
    return lambda s: all((s[i] in "23456789") == own for i, own in leads.items())


def canonical(kind: str, text: str) -> str:
    """Equal for spellings of one entity."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind == "name" else re.sub(r"\D", "", text.split("+")[-1] if kind == "phone" else text)


def _made(value: str, gender: str) -> str:
    """The script in which the first word is made anew as a given name, or nothing."""
    first, _, last = value.partition(" ")
    if not last or not gender or first in MALE_NAMES or first in FEMALE_NAMES:
        return ""
    script = unicodedata.name(first[0], "").split(" ")[0]
    return script if script in _GIVEN else ""


def _given_name(key: bytes, word: str, gender: str, script: str) -> str:
    onsets, vowels, endings = _GIVEN[script]
    number = int.from_bytes(hmac.digest(key, f"given|{gender}|{word}".encode(), "sha256"), "big")
    out = ""
    for turn in range(_SYLLABLES):
        number, at = divmod(number, len(onsets))
        out += onsets[at]
        if turn < _SYLLABLES - 1:
            number, at = divmod(number, len(vowels))
            out += vowels[at]
    out += endings[gender][number % len(endings[gender])]
    return out.upper() if len(word) > 1 and word.isupper() else out.capitalize()


def _name_image(key: bytes, value: str, gender: str) -> str:
    """Known given names change within their gender's list, others are made anew by gender, other words change within their shape."""
    lists = {"m": MALE_NAMES, "f": FEMALE_NAMES}
    known = set(MALE_NAMES + FEMALE_NAMES)
    out, words = [], value.split(" ")
    if script := _made(value, gender):
        out.append(_given_name(key, words.pop(0), gender, script))
    for word in words:
        own = next((n for g, n in lists.items() if word in n and (gender in (g, ""))), next((n for n in lists.values() if word in n), None))
        if own:
            own = lists.get(gender, own) if word in lists.get(gender, own) else own
            out.append(own[_permuted(key, b"given", own.index(word), len(own))])
        else:
            out.append(_image(key, "name", word, lambda s: s not in known))
    return " ".join(out)


def image(key: bytes, kind: str, value: str, gender: str = "", times: int = 1) -> str:
    """The ``times``-th image of a canonical value; never the value itself where its shape has another."""
    out = value
    for _ in range(times):
        for _ in range(3):
            if kind == "name":
                out = _name_image(key, out, gender)
            elif kind == "ip":
                number = 0
                for part in out.split("."):
                    number = number << 8 | int(part)
                number = _permuted(key, b"ip", number, 1 << 32)
                out = ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
            elif kind == "email":
                local, _, host = out.partition("@")
                name, _, top = host.rpartition(".")
                moved = _image(key, kind, f"{local}@{name}", lambda s: True)
                out = f"{moved}.{top}"
            elif kind == "iban":
                out = out[:2] + _image(key, kind, out[2:], lambda s: True)
            elif kind == "card":
                sound = _luhn(out)
                out = _image(key, kind, out, lambda s, sound=sound: _luhn(s) == sound)
            else:
                country = len(out) - 10 if kind == "phone" and 10 < len(out) <= 13 else 0
                out = out[:country] + _image(key, kind, out[country:], _like_phone(out[country:]) if kind == "phone" else lambda s: True)
            if out != value:
                break
    return out


def shape_of(kind: str, value: str, gender: str = "") -> tuple[str, float]:
    """What all images of a canonical value have in common, and how many strings have it."""
    if kind == "ip":
        return kind, 2.0**32
    kept, out, size = 0, [], 1.0
    if kind == "name":
        lists = {"m": MALE_NAMES, "f": FEMALE_NAMES}
        words = [(w, next((g for g, n in lists.items() if w in n), "")) for w in value.split(" ")]
        if script := _made(value, gender):
            onsets, vowels, endings = _GIVEN[script]
            out.append(f"<{script} {gender}>")
            size *= len(onsets) ** _SYLLABLES * len(vowels) ** (_SYLLABLES - 1) * len(endings[gender])
            words.pop(0)
    else:
        kept = len(value) - 10 if kind == "phone" and 10 < len(value) <= 13 else 2 * (kind == "iban")
        top = value.rpartition(".")[2] if kind == "email" else ""
        words = [(value[kept : len(value) - len(top)], "")]
        out = [value[:kept], top]
        if kind == "card":
            out.append(str(_luhn(value)))
            size = 0.1 if _luhn(value) else 0.9
        if kind == "phone" and len(words[0][0]) == 10:
            leads = [words[0][0][i] in "23456789" for i in (0, 3)]
            out.append(str(leads))
            for own in leads:
                size *= 0.8 if own else 0.2
    for word, listed in words:
        if listed:
            out.append(f"<{listed}>")
            size *= len(lists[listed])
            continue
        for c in word:
            found = _alphabet(c)
            out.append(f"{ord(found[0][0]):x}?" if found else f"={c}")
            size = min(size * len(found[0]), 1e300) if found else size
        out.append(" ")
    return f"{kind}|{'|'.join(out)}", size


def _dressed(kind: str, original: str, value: str) -> str:
    """The surrogate in the spelling of the original: its case, its spaces and signs."""
    if kind in ("ip", "name"):
        return value
    if kind == "email":
        return "".join(s.upper() if o.isupper() else s for o, s in zip(original, value, strict=True))
    rest = iter(value)
    head = original.rfind("+") + 1 if kind == "phone" else 0
    keep = str.isalnum if kind == "iban" else str.isdigit
    return original[:head] + "".join(next(rest) if keep(c) else c for c in original[head:])


def _mails(hosts: Iterator[re.Match], text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in hosts:
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical value, gender) of the entities, left to right, without overlap."""
    spans: list[tuple[int, int, str, str, str]] = []
    has = {"email": "@" in text, "name": True}
    digits = bool(_DIGIT.search(text))

    def add(start: int, end: int, kind: str, gender: str = "") -> None:
        # spans are sorted and apart, so only the neighbours can overlap
        at = bisect_left(spans, (start,))
        if (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or end <= spans[at][0]):
            spans.insert(at, (start, end, kind, canonical(kind, text[start:end]), gender))

    for kind, pattern in DETECTORS:
        if not has.get(kind, digits):
            continue
        if kind == "email":
            for start, end in _mails(pattern.finditer(text), text):
                add(start, end, kind)
            continue
        for m in pattern.finditer(text):
            if kind == "phone" and "+" not in m.group() and sum(map(str.isdigit, m.group())) < 9:
                continue  # dates and versions
            if kind == "name":
                title = m.group().split(" ")[0].rstrip(".")
                add(*m.span(1), kind, "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "")
            else:
                add(*m.span(), kind)
    return spans


def rewrite(text: str | None, key: bytes, known: dict[tuple[str, str], tuple[int, str]] | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and what was replaced where (start, end, kind).

    ``known`` has image number and gender of entities for which they are not 1 and what the title says.
    """
    spans = find(text) if text else []
    out, at = [], 0
    for start, end, kind, value, gender in spans:
        times, gender = (known or {}).get((kind, value), (1, gender))
        out += [text[at:start], _dressed(kind, text[start:end], image(key, kind, value, gender, times))]
        at = end
    return (text if not spans else "".join(out) + text[at:]), [s[:3] for s in spans]


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, k, v, g) for i, t in zip(batch["id"], batch["text"], strict=True) if t for k, v, g in {f[2:] for f in find(t)}]
        yield pd.DataFrame(rows, columns=["id", "kind", "value", "gender"]).astype({"id": "Int64"})


def _next_image(key: bytes) -> Callable:
    @F.pandas_udf("string")
    def step(kind: pd.Series, value: pd.Series, gender: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([image(key, k, v, g, int(n)) for k, v, g, n in zip(kind, value, gender, times, strict=True)], dtype=object)

    return step


def _shape() -> Callable:
    @F.pandas_udf("shape string, room double")
    def shape(kind: pd.Series, value: pd.Series, gender: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_of(k, v, g) for k, v, g in zip(kind, value, gender, strict=True)], columns=["shape", "room"])

    return shape


def _rewriter(key: bytes) -> Callable:
    @F.pandas_udf("text string, entities string, n_entities long")
    def rewritten(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, known, strict=True):
            new, spans = rewrite(text, key, {(t["kind"], t["value"]): (t["times"], t["gender"]) for t in own} if own is not None else None)
            rows.append((new, ",".join(f"{k}:{a}:{b}" for a, b, k in spans), len(spans)))
        return pd.DataFrame(rows, columns=["text", "entities", "n_entities"])

    return rewritten


def _checked(table: DataFrame, beside: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The table with ``real`` (the surrogate is another real value) and ``bad`` (that, or another value's surrogate).

    ``beside`` has further values and surrogates that are taken.
    """
    taken = table.select("kind", "value", "surrogate")
    taken = taken if beside is None else taken.unionByName(beside.select("kind", "value", "surrogate"))
    real = taken.select("kind", F.col("value").alias("surrogate")).withColumn("_real", F.lit(True))
    twice = taken.groupBy("kind", "surrogate").agg(F.min("value").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if beside is not None:
        # what is settled keeps its surrogate
        own = beside.select("kind", "surrogate", F.lit("").alias("_settled")).distinct()
        twice = twice.join(own, ["kind", "surrogate"], "left").withColumn("_first", F.coalesce("_settled", "_first")).drop("_settled")
    checked = table.drop("real", "bad").join(real, ["kind", "surrogate"], "left").join(twice.drop("_n"), ["kind", "surrogate"], "left")
    # a value with no other string of its shape keeps its image
    checked = checked.withColumn("real", F.col("_real").isNotNull() & (F.col("surrogate") != F.col("value")))
    checked = checked.withColumn("bad", F.col("real") | (F.col("_first").isNotNull() & (F.col("_first") != F.col("value"))))
    made = F.sum((F.col("bad") & (F.col("kind") == "name") & (F.col("gender") != "")).cast("int"))
    return stage(checked.drop("_real", "_first"), "checked-surrogates", n=F.sum(F.col("bad").cast("int")), made=made)


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Entities per document, and the table ``kind, value, gender, mixed, times, surrogate, real``; no two values of a kind share a surrogate.

    ``mixed`` says that not every occurrence tells the gender that the table has.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found, _ = stage(texts.mapInPandas(_entities, "id long, kind string, value string, gender string"), "entities")
    told = F.expr("nullif(gender, '')")
    agreed = F.when(F.min(told) == F.max(told), F.min(told)).otherwise("")
    table = found.groupBy("kind", "value").agg(agreed.alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed")).withColumn("times", F.lit(1))
    table, _ = stage(table.withColumn("surrogate", _next_image(key)("kind", "value", "gender", "times")), "surrogates")
    columns = ["kind", "value", "gender", "mixed", "times", "surrogate", "real"]
    table, left = _checked(table)
    if not left["n"]:
        return found, table.select(*columns)
    # images stay inside a shape, but for made given names: only shapes with a collision go on
    table, _ = stage(table.withColumn("_s", _shape()("kind", "value", "gender")).select(*columns, "bad", "_s.*"), "shaped-surrogates")
    shapes = table.groupBy("shape").agg(F.max("bad").alias("open"), (2 * F.count(F.lit(1)) > F.first("room")).alias("full"))
    shapes, _ = stage(shapes.filter("open"), "open-shapes")
    done, _ = stage(table.join(shapes.filter("not full"), "shape", "left_anti").select(*columns), "done-surrogates")
    first, _ = stage(table.join(shapes.filter("not full"), "shape", "left_semi"), "open-surrogates")
    going, turn = first, 1
    while True:
        # made names can meet values of any shape, so where one moved, the settled ones are looked at too
        going, left = _checked(going, done.filter("kind = 'name'") if left["made"] else None)
        if not left["n"] or turn == TURNS:
            break
        turn += 1
        moved = going.filter("bad").withColumn("times", F.col("times") + 1)
        moved = moved.withColumn("surrogate", _next_image(key)("kind", "value", "gender", "times"))
        going, _ = stage(going.filter("not bad").unionByName(moved), "surrogates")
    unsettled = going.filter("bad").select("shape").distinct()
    table, real = stage(
        done.unionByName(going.join(unsettled, "shape", "left_anti").select(*columns)).unionByName(first.join(unsettled, "shape", "left_semi").select(*columns)),
        "settled-surrogates", n=F.sum(F.col("real").cast("int")))
    if real["n"]:
        logging.getLogger(__name__).warning("%d surrogates equal another real value: their shapes have too few free strings", real["n"])
    return found, table


def replace_entities(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000,
) -> DataFrame:
    """``docs`` with the text rewritten and the columns ``entities`` (kind:start:end) and ``n_entities``; such columns are replaced."""
    found, table = surrogates(docs, key, id_col, text_col)
    moved, n = stage(table.filter("times > 1 or mixed").select("kind", "value", "times", "gender"), "moved", n=F.count(F.lit(1)))
    moved = F.broadcast(moved) if n["n"] <= broadcast_rows else moved
    late, n = stage(
        found.select("id", "kind", "value").join(moved, ["kind", "value"]).groupBy("id")
        .agg(F.collect_set(F.struct("kind", "value", "times", "gender")).alias("known")), "exceptions", n=F.sum(F.size("known")))
    others = [c for c in docs.columns if c not in (text_col, "entities", "n_entities")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(late) if (n["n"] or 0) <= broadcast_rows else late, "id", "left").withColumn("new", _rewriter(key)("text", "known"))
    return rows.select(
        *[F.col("new.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("entities", "n_entities")],
        "new.entities", "new.n_entities")
