import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from caselode.llm.pii import WHOLE, base_spans, op7_pii, sanitise, spans, spelt


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m[0])]
    return ",".join(out)


EDGES = [None, "", "a@b.c_d@e.f%g@h-.i.j", "x@y", "..@a.b.", "@a.b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3", "+1 (555) 123-4567 +49 +1234567 +1-2-3-4-5-6-7-8-", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 4 4", "éü🙂 a@b.co 🙂 +1 (743) 555-3824", "1" * 5000, "a" * 50_000 + "@", "a@b.c " * 300, "1 " * 3000, "+5" + "(" * 9000, "1." * 9000, "12 4539578763621486 34"]


def test_base_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "doc_id long, text string")
    got = df.select("doc_id", spelt(base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: brute(t) for i, t in enumerate(EDGES)}


def test_base_random(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("0123456789.@+-() aZé_%,") for _ in range(draw.randrange(90))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", spelt(base_spans(F.col("text"))).alias("s")).collect()
    assert all(r.s == brute(r.text) for r in got)


def test_documents(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = op7_pii(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)


def brute_terms(rows, generalise=0.75, support=2):
    """Disclosing (value, term) pairs; every mention's words lie within the window here."""
    word = re.compile(r"[^\W_][\w'-]{3,}")
    mention = re.compile(r"\S+@\S+\.com")
    together, contexts, with_term, with_entity = Counter(), defaultdict(set), Counter(), Counter()
    for text in rows:
        words = set(re.split(r"[^\w'-]+", text.lower()))
        with_term.update(w for w in words if len(w) >= 4)
        found = {m[0] for m in mention.finditer(text)}
        with_entity.update(found)
        for e in found:
            terms = [w for part in text.split(e) for w in word.findall(part.lower())]
            for t in set(terms):
                together[e, t] += 1
                contexts[e, t].add(" ".join(terms))
    out = {}
    for (e, t), n in together.items():
        if len(contexts[e, t]) >= support:
            share = 1 + math.log2(n / with_term[t]) / -math.log2(with_entity[e] / len(rows))
            if share >= generalise:
                out[e, t] = share
    return out


def test_disclosing_terms_against_brute_force(spark):
    draw = random.Random(9)
    texts = [f"common {draw.choice(['apple', 'pear', 'plum'])} filler{i}" for i in range(200)]
    texts += [f"the surgeon of Oldtown is ann@x.com common word{i % 3}" for i in range(6)] + ["the surgeon left common things"]
    texts += ["copied ghost text bob@x.com common"] * 5
    want = brute_terms(texts)
    assert {t for _, t in want} == {"surgeon", "oldtown"}
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = {r.id: {(texts[r.id][x.s : x.e].lower(), x.value) for x in r.spans if x.kind == "term"} for r in spans(df).collect()}
    assert all(got[i] == ({("surgeon", "" if want["ann@x.com", "surgeon"] >= 0.9 else "[TERM]"), ("oldtown", "")} if "ann@" in t else set()) for i, t in enumerate(texts))
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert sanitise(df).columns == df.columns and len(clean) == len(texts)
    assert all("@" not in t for t in clean.values())
    assert all(clean[i] == t for i, t in enumerate(texts) if "@" not in t)
    assert clean[200].endswith("is [EMAIL] common word0") and "Oldtown" not in clean[200]


def test_overlaps_null_and_no_rows(spark):
    rows = [(None, "+1.2.3.45678 +4539578763621486", "a"), (1, None, None), (1, "", "b"), (1, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_spans string")
    got = sanitise(df)
    assert sorted((str(r.text) for r in got.collect())) == ["", "", "None", "[PHONE] +[CARD]"]
    assert sanitise(df.limit(0)).count() == 0 and spans(df.limit(0)).count() == 0


def test_terms_at_all_places_and_short_names(spark):
    """Far from the value, once more in the same text, in a text without it, and of three characters."""
    draw = random.Random(4)
    fill = lambda n: " ".join(draw.choice(["apple", "pear", "plum", "is", "of"]) for _ in range(n))
    texts = [fill(60) for _ in range(300)]
    texts += [f"Kim of Vale {fill(80 + i)} bob@y.org {fill(30)} Kim" for i in range(6)] + [f"{fill(9)} Vale {fill(9)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in sanitise(df, **WHOLE).collect()}
    assert not any(re.search("Kim|Vale|bob@", t) for t in clean.values())
    assert all(clean[i] == texts[i] for i in range(300)) and clean[306] == texts[306].replace("Vale", "")
    near = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert not any("Vale" in near[i] for i in range(300, 306))


def test_terms_in_quotes_dashes_and_underscores(spark):
    """Counts take the words as the places do, whatever stands around them."""
    draw = random.Random(6)
    texts = [f"plain words {draw.choice(['apple', 'pear', 'plum'])} {i}" for i in range(300)]
    texts += [f"say {form} to ann@x.com then common {i}" for i, form in enumerate(["'Quixworth", "--quixworth", "_quixworth_", "'Quixworth"])]
    texts += [f"'common --common _common_ {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert not any("quixworth" in t.lower() for t in clean.values())
    assert all("common" in clean[i] for i in range(300, 344)) and all(clean[i] == texts[i] for i in range(304, 344))
