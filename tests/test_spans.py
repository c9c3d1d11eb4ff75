"""Entities by plain regular expressions, place by place, against the registered queries over whole tables."""

import hashlib
import re
from collections import Counter, defaultdict

from caselode.functions import lexicons as L
from caselode.plans.evaluation import detokenised
from caselode.plans.guard import masked_documents, pii_class_counts
from caselode.plans.scanning import outbound_scan


def entities(text):
    """(start, end, class, value), the earliest, then the longest, what overlaps it left out."""
    found = []
    for cls, pattern, _ in L.ENTITIES:
        for m in re.finditer(pattern, text):
            if cls != "ni_number" or m[0][:2] not in L.NINO_UNISSUED:
                found.append((m.start(), -m.end(), cls, m[0]))
    out = []
    for start, end, cls, value in sorted(found):
        if not out or start >= out[-1][1]:
            out.append((start, -end, cls, value))
    return out


def masked(text, found):
    label, values = {cls: name for cls, _, name in L.ENTITIES}, defaultdict(list)
    out, at = "", 0
    for start, end, cls, value in found:
        if value not in values[cls]:
            values[cls].append(value)
        out += text[at:start] + f"[{label[cls]}_{values[cls].index(value) + 1}]"
        at = end
    return out + text[at:], {f"[{label[c]}_{i + 1}]": v for c, vs in values.items() for i, v in enumerate(vs)}


def texts(spark, sf_dir, table, key):
    return [(r[0], r.text or "") for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_masked_and_counted(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table holds too few entities
    docs = texts(spark, sf_dir, "documents", "doc_id")
    found = {d: entities(t) for d, t in docs}
    assert sum(map(len, found.values())) > 10
    got = {r.doc_id: (r.n, r.sha) for r in masked_documents(spark, sf_dir).collect()}
    assert got == {d: (len(found[d]), sha(masked(t, found[d])[0])) for d, t in docs}
    assert {r.doc_id: r.sha for r in detokenised(spark, sf_dir).collect()} == {d: sha(t) for d, t in docs}
    counts, values = Counter(), defaultdict(set)
    for every in (found.values(), [entities(t) for _, t in texts(spark, sf_dir, "conversations", "conv_id")]):
        for spans in every:
            for _, _, cls, value in spans:
                counts[cls] += 1
                values[cls].add(value)
    assert {r.cls: (r.n, r["values"]) for r in pii_class_counts(spark, sf_dir).collect()} == {c: (n, len(values[c])) for c, n in counts.items()}


def test_outbound(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {}
    for doc, text in texts(spark, sf_dir, "documents", "doc_id"):
        half = text[: len(text) // 2]
        _, vault = masked(half, entities(half))
        known = {v.lower() for v in vault.values()}
        leaks = [c for _, _, c, v in entities(text) if v.lower() not in known and c in L.PERSONAL]
        want[doc] = (not leaks, f"<{leaks[0]}>" if leaks else "")
    assert {r.doc_id: (r.passed, r.matched) for r in outbound_scan(spark, sf_dir).collect()} == want
