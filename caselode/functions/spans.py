"""Entities as spans, and masking: places from the texts between the matches, overlaps settled from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselode.functions import lexicons as L

SPAN = "array<struct<start:bigint,neg:bigint,cls:string,value:string,end:bigint>>"


def matches(text: Column, cls: str, pattern: str) -> Column:
    """All matches of a pattern, in code points."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc, x):
        start = acc.at + F.length(x.p)
        end = start + F.coalesce(F.length(x.m), F.lit(0))
        one = F.struct(start.cast("long").alias("start"), (start - end).cast("long").alias("neg"), F.lit(cls).alias("cls"), x.m.alias("value"), end.cast("long").alias("end"))
        return F.struct(end.alias("at"), F.when(x.m.isNotNull(), F.concat(acc.out, F.array(one))).otherwise(acc.out).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a.out)


def entities(text: Column) -> Column:
    """Entities of five classes; the earliest, then the longest wins, and what overlaps it goes."""
    found = F.concat(*[matches(text, cls, "(?U)" + pattern) for cls, pattern, _ in L.ENTITIES])
    issued = F.filter(found, lambda x: (x.cls != "ni_number") | ~F.substring(x.value, 1, 2).isin(*L.NINO_UNISSUED))
    keep = lambda acc, x: F.when((F.size(acc) > 0) & (x.start < F.element_at(acc, -1).end), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(issued), F.array().cast(SPAN), keep)


def vault(spans: Column) -> Column:
    """Placeholder and value of each distinct entity: [CLASS_n], numbered by class in order of appearance."""
    label = {cls: name for cls, _, name in L.ENTITIES}

    def of(cls):
        values = F.array_distinct(F.transform(F.filter(spans, lambda y: y.cls == cls), lambda y: y.value))
        return F.transform(values, lambda v, i: F.struct(F.concat(F.lit(f"[{label[cls]}_"), (i + 1).cast("string"), F.lit("]")).alias("key"), v.alias("value")))

    return F.map_from_entries(F.concat(*[of(cls) for cls in label]))


def detokenised(text: Column, held: Column) -> Column:
    """A masked text with the placeholders that the vault holds turned back; others stay as they are."""
    pattern = r"\[(?:" + "|".join(name for _, _, name in L.ENTITIES) + r")_[0-9]+\]"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x.p, F.coalesce(held[x.m], x.m, F.lit("")))), "")


def masked(text: Column, spans: Column) -> Column:
    """The text with each entity replaced by [CLASS_n]; equal values share a number."""
    label = F.create_map(*[x for cls, _, name in L.ENTITIES for x in (F.lit(cls), F.lit(name))])
    values = lambda c: F.array_distinct(F.transform(F.filter(spans, lambda y: y.cls == c), lambda y: y.value))

    def step(acc, x):
        name = F.concat(F.lit("["), F.element_at(label, x.cls), F.lit("_"), F.array_position(values(x.cls), x.value).cast("string"), F.lit("]"))
        return F.struct(F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), (x.start - acc.at).cast("int")), name).alias("out"), x.end.alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substring(text, (a.at + 1).cast("int"), F.length(text))))
