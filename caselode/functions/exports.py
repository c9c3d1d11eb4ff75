"""Values in the forms that leave the engine: metadata, attributes, stamps, replies, merged timings, refusals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an attribute; the items of a list get a quarter each.
ATTRIBUTE = 4096


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 stamp, 0 where it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(stamp)) / 1_000_000, F.lit(0.0))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def list_json(items: Column) -> Column:
    """A list as a JSON list of its items' texts, sorted; nulls are left out."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(F.array_compact(items), lambda x: x.cast("string"))), quoted), ", "), F.lit("]"))


def map_json(entries: Column) -> Column:
    """A map of strings as a JSON object, keys sorted, null values null."""
    pair = lambda e: F.concat(quoted(e.key), F.lit(": "), F.coalesce(quoted(e.value), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(entries)), pair), ", "), F.lit("}"))


def flat(columns: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Metadata with primitive values only, as a map of texts: nulls dropped, lists and maps as JSON."""
    form = {"array": list_json, "map": map_json}
    values = {k: form.get(kinds[k].split("<")[0], lambda c: c.cast("string"))(c) for k, c in columns.items()}
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.when(columns[k].isNotNull(), v))]), lambda _, v: v.isNotNull())


def attribute(value: Column, kind: str) -> Column:
    """A value fit for a trace: texts cut to ATTRIBUTE characters, lists of texts item by item to a quarter, maps as cut JSON; others as they are."""
    if kind == "string":
        return F.substring(value, 1, ATTRIBUTE)
    if kind == "array<string>":
        return F.transform(value, lambda x: F.substring(x, 1, ATTRIBUTE // 4))
    return F.substring(map_json(value), 1, ATTRIBUTE) if kind.startswith("map") else value


def json_in(reply: Column) -> Column:
    """The text from a reply's first opening brace to its last closing one; null where there is no such stretch."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing besides; the parser alone passes over what follows a value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.lit(False))


def uncited(text: Column) -> Column:
    """A text without its marks in brackets; of one that is never closed only the bracket goes."""
    return F.replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit("["), F.lit(""))


def merged_ms(a: Column, b: Column) -> Column:
    """Two maps of stage times added up, to three places."""
    return F.map_zip_with(a, b, lambda _, x, y: F.round(F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)), 3))


def refusal(score: Column, threshold: float, attempts: Column) -> Column:
    """Why a question is refused; a refusal without its reason looks like a fault."""
    form = "I cannot answer this from the indexed document. Retrieval sufficiency scored %.2f against a threshold of %.2f, after %d refinement attempt(s), so any answer would not be supported by the source."
    return F.format_string(form, score, F.lit(threshold), attempts.cast("int"))
