"""Tool-call markers, assembled contexts and the checks on answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselode.functions import lexicons as L
from caselode.functions import text as T

# fixed values: a marker <<tool: name k="v">> and its parameters
CALL = r"(?is)<<\s*tool:\s*([\w.]+)\s*(.*?)>>"
PARAM = r'(?is)(\w+)\s*=\s*"([^"]*)"'
ADDRESS = r"https?://[^\s\]\)>\"']+"


def tool_calls(text: Column) -> Column:
    """Calls in text order: name and parameters; of a repeated parameter the last value counts."""
    names, bodies = (F.regexp_extract_all(text, F.lit(CALL), F.lit(g)) for g in (1, 2))

    def params(body: Column) -> Column:
        keys, values = (F.regexp_extract_all(body, F.lit(PARAM), F.lit(g)) for g in (1, 2))
        pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p.k))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p.k, p.v)))

    return F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda c: F.struct(F.lower(c.n).alias("name"), params(c.b).alias("params")))


def without_calls(text: Column) -> Column:
    """The text without markers, spaces before punctuation and runs of spaces."""
    out = F.regexp_replace(F.regexp_replace(text, CALL, ""), r"\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def context_blocks(context: Column) -> Column:
    """Blocks of an assembled context: citation, breadcrumb, body; blocks without a header are dropped."""
    parts = F.filter(F.split(context, "\n\n"), lambda b: F.trim(b).rlike("^" + L.CITATION))
    head = lambda b: F.trim(F.substring_index(b, "\n", 1))
    body = lambda b: F.when(F.contains(b, F.lit("\n")), F.trim(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b)))).otherwise("")
    return F.transform(parts, lambda b: F.struct(F.regexp_extract(head(b), "^" + L.CITATION, 1).alias("citation"), F.trim(F.regexp_replace(head(b), "^" + L.CITATION, "")).alias("breadcrumb"), body(b).alias("body")))


def actions(answer: Column) -> Column:
    """Action-shaped things of an answer: tool calls, mailboxes, addresses, as kind and target."""
    target = lambda m: F.coalesce(m["to"], m["url"], m["payroll_id"], F.lit(""))
    of = lambda xs, kind, f: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), f(x).alias("target")))
    boxes, urls = F.regexp_extract_all(answer, F.lit("(?U)" + L.MAILBOX), F.lit(0)), F.regexp_extract_all(answer, F.lit(ADDRESS), F.lit(0))
    return F.concat(of(tool_calls(answer), "tool_call", lambda c: target(c.params)), of(boxes, "recipient", lambda x: x), of(urls, "url", lambda x: x))


def follows_evidence(question: Column, answer: Column, evidence: Column) -> Column:
    """A mailbox that the answer has from the evidence and the question did not name: the first one, or null."""
    boxes = lambda t: F.regexp_extract_all(F.lower(t), F.lit("(?U)" + L.MAILBOX), F.lit(0))
    return F.array_min(F.array_except(F.array_intersect(boxes(answer), boxes(evidence)), boxes(question)))


def output_verdict(question: Column, answer: Column, evidence: Column, available: Column, flagged: Column) -> Column:
    """The checks on an answer in order: no action; not asked for; a citation that does not resolve or is flagged; follows the evidence."""
    cited = T.citations(answer)
    return (
        F.when(F.size(actions(answer)) == 0, "pass: no action")
        .when(~T.any_of(F.lower(question), L.REQUEST_INTENT), "block: not asked for")
        .when(F.exists(cited, lambda c: ~T.resolves(c, available)), "block: unresolved citation")
        .when(F.arrays_overlap(F.transform(cited, T.canonical), F.transform(flagged, T.canonical)), "block: flagged source")
        .when(follows_evidence(question, answer, evidence).isNotNull(), "block: follows the evidence")
        .otherwise("pass")
    )


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), F.when(context == "", "(no provisions retrieved)").otherwise(context))


def split_prompt(text: Column) -> Column:
    """Question and context of a prompt."""
    return F.struct(F.regexp_extract(text, r"(?s)^Question: (.*?)\n\nContext:\n", 1).alias("question"), F.regexp_extract(text, r"(?s)\n\nContext:\n(.*)$", 1).alias("context"))
