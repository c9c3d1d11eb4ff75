"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give it away.

Base spans are the leftmost matches of four patterns that pass their test (``BASE``). Places come from the texts between
the matches, so everything is done by built-in functions; possessive forms keep long runs linear and match the same.

Terms: every distinct value found is a protected entity e. For the words t of the documents that hold it, base spans
left out, the corpus gives P(e | t), the share of the documents with t that hold e. The information that t discloses
about e is log2(P(e | t) / P(e)); as a share of all there is to know, -log2 P(e), it reaches 1 where t never occurs
without e. From ``GENERALISE`` on the term is generalised to its kind of word, from ``REMOVE`` on it is removed, at all
its places in the documents that hold e, and with ``everywhere`` in all others too. Only pairs seen in ``SUPPORT`` or
more different texts count, so that copies of a text prove nothing. Words have ``shortest`` characters or more. What can't
pass is dropped first: values in too few texts, and terms in too many documents.

Defined results: null and empty texts have no spans; null ids are carried along; a repeated row is a row of its own in
the result and one more document in the counts. Empty tables give no rows. ``sanitise`` keeps all columns of its input,
whatever their names; null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import discard, documents, fresh, spread_join, text_of, written

SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.9

#: Kind, pattern, and a cheap condition without which the pattern can't match.
BASE = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
KINDS = [k for k, _, _ in BASE] + ["term"]
OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A word begins and ends with a letter or digit, whatever quotes, dashes or underscores stand around it.
WORD = r"[\p{L}\p{N}]++(?:['_-]++[\p{L}\p{N}]++)*+"
#: Telling terms are looked for by hash first: so many numbers at most are broadcast, and only words that hit one are sent.
BUCKETS = 1 << 20
#: What the registered queries ask for: words of two characters or more, terms taken out of every text.
WHOLE = {"shortest": 2, "everywhere": True}
SPAN = "array<struct<kind:string,value:string,s:bigint,e:bigint>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str, needs: str | None = None) -> Column:
    """Spans of the passing matches, in code points from 0."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc, x):
        s = acc.at + F.length(x.p)
        e = s + F.coalesce(F.length(x.m), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), x.m.alias("value"), s.cast("long").alias("s"), e.cast("long").alias("e")))
        return F.struct(e.alias("at"), F.when(x.m.isNotNull() & passes(kind, x.m), F.concat(acc.out, one)).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(parts, start, step, lambda acc: acc.out)
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast(SPAN)) if needs else found


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""
    return F.concat(*[matches(text, *b) for b in BASE])


def words_of(text: Column, shortest: int) -> Column:
    """The words of a text, each in lower case."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= shortest), F.lower)


def places_of(text: Column, told: Column) -> Column:
    """Spans of all words that told, an array of structs with a term, lists; kind term, value the term."""
    parts = F.arrays_zip(F.split(text, WORD, -1).alias("p"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("m"))

    def step(acc, x):
        s = acc.at + F.length(x.p)
        e = s + F.coalesce(F.length(x.m), F.lit(0))
        one = F.array(F.struct(F.lit("term").alias("kind"), F.lower(x.m).alias("value"), s.cast("long").alias("s"), e.cast("long").alias("e")))
        return F.struct(e.alias("at"), F.when(F.coalesce(F.array_contains(told, F.lower(x.m)), F.lit(False)), F.concat(acc.out, one)).otherwise(acc.out).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc.out)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its base spans, all else where it was."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))), lambda y: y)

    def step(acc, x):
        start = F.greatest(acc.at, x.s)
        between = F.substring(text, (acc.at + 1).cast("int"), (start - acc.at).cast("int"))
        return F.struct(F.concat(acc.out, F.array(between, F.repeat(F.lit(" "), F.greatest(F.lit(0), x.e - start).cast("int")))).alias("out"), F.greatest(acc.at, x.e).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, (acc.at + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def found_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), id, spans, the entities' kinds and values, text (without them) and its digest; written, as all else reads it."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("whole"))
    rows = rows.withColumn("spans", base_spans(F.col("whole")))
    entities = F.array_distinct(F.transform("spans", lambda x: F.struct(x.kind.alias("kind"), F.lower(x.value).alias("value"))))
    return written(rows.select("row", "id", "spans", entities.alias("entities"), blanked(F.col("whole"), F.col("spans")).alias("text"), F.xxhash64("whole").alias("digest")), "spans")


def likely_words(found: DataFrame, terms: DataFrame, shortest: int) -> DataFrame:
    """row and term, the distinct words of each row whose hash is that of one of terms: all places of these terms, and few others."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")
    words = found.select("row", F.explode(F.array_distinct(words_of(F.col("text"), shortest))).alias("term"))
    return words.select("*", bucket).join(F.broadcast(terms.select(bucket).distinct()), "bucket", "left_semi").select("row", "term")


def disclosing(found: DataFrame, generalise: float, support: int, shortest: int) -> DataFrame:
    """Pairs of entity (kind, value) and term, with the share of the entity's information that the term discloses.

    Texts are counted by one row each (own = 1), so all counts combine map-side. Terms fail first by the counts of the
    entities' own documents; only the hashes of what is left, at most BUCKETS, are looked for in the whole corpus.
    """
    total = found.count()
    holding = found.where(F.size("entities") > 0)
    own = holding.groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(1).alias("own"))
    mentions = holding.select("row", F.explode("entities").alias("m")).select("row", F.xxhash64("m.kind", "m.value").alias("entity"), "m.kind", "m.value")
    mentions = written(mentions.join(own, "row", "left").withColumn("own", F.coalesce("own", F.lit(0))), "mentions")
    counts = mentions.groupBy("entity", "kind", "value").agg(F.count("*").alias("with_entity"), F.sum("own").alias("texts"))
    entity = written(counts.where((F.col("texts") >= support) & (F.col("with_entity") < total)).select("entity", "kind", "value", "with_entity"), "entities")
    holders = written(spread_join(mentions.select("entity", "row", "own"), entity.select("entity"), "entity"), "holders")
    beside = found.join(holders.select("row").distinct(), "row", "left_semi").select("row", F.explode(F.array_distinct(words_of(F.col("text"), shortest))).alias("term"))
    beside = written(beside, "beside")
    joint = holders.join(beside, "row").groupBy("entity", "term").agg(F.count("*").alias("together"), F.sum("own").alias("texts")).where(F.col("texts") >= support)
    # the share is reached where the term stands in at most so many documents
    most = F.floor(F.col("together") * F.pow(F.lit(total) / F.col("with_entity"), F.lit(1 - generalise)) * (1 + 1e-9))
    first = written(joint.join(entity, "entity").select("entity", "kind", "value", "term", "together", "with_entity", most.alias("most")), "joint")
    count_of = lambda words, name: words.groupBy("term").agg(F.count("*").alias(name))
    few = written(spread_join(first, count_of(beside, "among"), "term").where("among <= most").drop("among"), "joint")
    discard(mentions, entity, holders, beside, first)
    joint = spread_join(few, count_of(likely_words(found, few, shortest), "with_term"), "term")
    share = 1 + F.log2(F.col("together") / F.col("with_term")) / -F.log2(F.col("with_entity") / F.lit(total))
    told = written(joint.withColumn("share", share).where(F.col("share") >= generalise).select("kind", "value", "term", "share"), "told")
    discard(few)
    return told


def spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    support: int = SUPPORT,
    shortest: int = 4,
    everywhere: bool = False,
) -> DataFrame:
    """row, id and spans (kind, value, s, e, by kind, then start) of every row of df; kind term for disclosing words.

    A term's value is what takes its place: empty where it is removed.
    """
    found = found_spans(df, id_col, text_col)
    told = disclosing(found, generalise, support, shortest)
    if everywhere:
        terms = told.groupBy("term").agg(F.max("share").alias("share"))
        shares = spread_join(written(likely_words(found, told, shortest), "likely"), terms, "term").select("row", "term", "share")
    else:
        held = found.select("row", F.explode("entities").alias("m")).select("row", "m.kind", "m.value")
        shares = held.join(told, ["kind", "value"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    place = F.when(F.col("share") >= remove, "").when(F.col("term").rlike("^[0-9]+$"), "[NUMBER]").otherwise("[TERM]")
    per_row = shares.withColumn("place", place).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "place"))).alias("places"))
    hits = found.select("row", "text").join(per_row, "row").select("row", "places", F.map_keys("places").alias("told"), "text")
    at = places_of(F.col("text"), F.col("told"))
    terms = hits.select("row", F.transform(at, lambda x: F.struct(x.kind.alias("kind"), F.col("places")[x.value].alias("value"), x.s.alias("s"), x.e.alias("e"))).alias("terms"))
    out = found.select("row", "id", "spans").join(terms, "row", "left")
    return out.select("row", "id", F.concat("spans", F.coalesce("terms", F.array().cast(SPAN))).alias("spans"))


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """df with the spans of its texts replaced: [EMAIL], [IP], [CARD], [PHONE]; terms generalised or removed.

    The rows are written once with their numbers, so that spans meet their texts by number.
    """
    row, own = fresh(df, "row_number_"), fresh(df, "own_spans")
    numbered = written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    places = spans(numbered, row, text_col, **settings).select(F.col("id").alias(row), F.col("spans").alias(own)).where(F.size(own) > 0)
    text = F.col(text_col)

    def step(acc, x):
        name = F.when(x.kind == "term", x.value).otherwise(F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        between = F.substring(text, (acc.at + 1).cast("int"), F.greatest(F.lit(0), x.s - acc.at).cast("int"))
        return F.struct(F.concat(acc.out, between, F.when(x.s >= acc.at, name).otherwise("")).alias("out"), F.greatest(acc.at, x.e).alias("at"))

    ordered = F.transform(F.array_sort(F.transform(own, lambda x: F.struct(x.s.alias("s"), x.alias("x")))), lambda y: y.x)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    new = F.aggregate(ordered, start, step, lambda acc: F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), F.length(text))))
    joined = numbered.join(places, row, "left").withColumn(text_col, F.when(F.col(own).isNotNull(), new).otherwise(text))
    return joined.select(*df.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = spans(documents(spark, sf_dir), **WHOLE)
    of = lambda kind: F.filter("spans", lambda x: x.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = spelt(F.filter("spans", lambda x: x.kind != "term"))
    return out.select(F.col("id").alias("doc_id"), *counts[:4], F.sha2(base.cast("binary"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"), counts[4])
