"""Column functions over text, all built-in. Patterns with classes such as word characters are Unicode-aware."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselode.functions import lexicons as L


def words_of(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


def term_list(text: Column) -> Column:
    """All terms in text order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(L.TERM), F.lit(0))


def kept(terms: Column, at_least: int, without) -> Column:
    """Terms of that length or more that are not in a list."""
    stop = words_of(without)
    return F.filter(terms, lambda w: (F.length(w) >= at_least) & ~F.array_contains(stop, w))


def words(text: Column) -> Column:
    return F.array_distinct(term_list(text))


def distinctive(text: Column) -> Column:
    return kept(words(text), 5, L.GENERIC)


def embedding_tokens(text: Column) -> Column:
    return kept(term_list(text), 2, L.STOPWORDS)


def content_words(text: Column) -> Column:
    return kept(words(text), 3, L.FILLER)


def question_terms(text: Column) -> Column:
    return F.array_except(content_words(text), words_of(L.GENERIC))


def topic_terms(text: Column) -> Column:
    """Terms that name a topic, in text order, repeats kept."""
    return kept(term_list(text), 4, L.GENERIC)


def coverage(wanted: Column, there: Column) -> Column:
    """Share of the wanted words that are there; 0 if none is wanted."""
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, there)) / F.size(wanted))


def any_of(text: Column, needles) -> Column:
    """Whether text holds any of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def intent(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("general")
    for name, keywords in reversed(L.INTENTS):
        out = F.when(any_of(low, keywords), name).otherwise(out)
    return out


def follow_up(text: Column) -> Column:
    """Whether a question leans on an earlier one."""
    low = F.lower(F.trim(text))
    terms, topic = term_list(low), topic_terms(text)
    first = F.get(terms, 0)
    leans = F.arrays_overlap(F.array_distinct(terms), words_of(L.ANAPHORA)) & (F.size(topic) <= 1)
    short = (F.size(terms) <= 5) & (F.size(topic) == 0)
    return F.coalesce((low != "") & (F.coalesce(first.isin(*L.CONJUNCTIONS), F.lit(False)) | any_of(low, L.FOLLOW_UP) | short | leans), F.lit(False))


def redacted(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, "(?U)" + r[0], r[1].replace("$", r"\$")), L.REDACTIONS, text)


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: a quarter of its length, rounded up."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4))).cast("long")


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? and white space, never inside [...]; blank ones dropped.

    Marks are hidden by doubling their inner full stops with a control character that texts do not hold.
    """
    marks = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]{2,160}\]"), F.lit(0))
    hidden = F.aggregate(marks, F.trim(text), lambda t, m: F.replace(t, m, F.regexp_replace(m, r"([.!?])(\s)", "$1\u0002$2")))
    parts = F.split(F.regexp_replace(hidden, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\u0002", ""))), lambda p: p != "")


def citations(text: Column) -> Column:
    """Citation marks in text order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(L.CITATION), F.lit(1)))


def canonical(citation: Column) -> Column:
    """The provision that a citation names: sch.X para.Y, s.N, or its lower-case text."""
    text = F.trim(F.regexp_replace(citation, L.AS_INSERTED, " "))
    sched = F.concat(F.lit("sch."), F.lower(F.regexp_extract(text, L.SCHEDULE_REF, 1)), F.lit(" para."), F.lower(F.regexp_extract(text, L.SCHEDULE_REF, 2)))
    sect = F.concat(F.lit("s."), F.lower(F.regexp_extract(text, L.SECTION_REF, 1)))
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.regexp_extract(text, L.SCHEDULE_REF, 2) != "", sched).when(F.regexp_extract(text, L.SECTION_REF, 1) != "", sect).otherwise(plain)


def resolves(citation: Column, available: Column) -> Column:
    return (canonical(citation) != "") & F.array_contains(F.transform(available, canonical), canonical(citation))


def preview(text: Column, width: int = 96) -> Column:
    """White space laid together; cut with an ellipsis beyond the width."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def near(text: Column, left, right, window: int = 80) -> Column:
    """Whether a needle of right lies within the stretch that begins with a needle of left and goes window characters beyond it."""
    verbs = "|".join(sorted(left, key=len, reverse=True))
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?=((?:{verbs}).{{0,{window}}}))"), F.lit(1))
    return any_of(text, left) & any_of(text, right) & F.exists(stretches, lambda s: any_of(s, right))


def instruction_signals(text: Column) -> Column:
    """0 to 4 signals that a text addresses the reader's machine."""
    low = F.lower(text)
    rules = (
        (text.rlike("(?U)" + L.MAILBOX), "names a mailbox"),
        (text.rlike(L.URL), "names a URL"),
        (any_of(low, L.SYSTEM_WORDS), "addresses a responding system"),
        (any_of(low, L.RESPONSE_WORDS), "states how a response must be produced"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def imperative_send(sentence: Column) -> Column:
    """A mailbox and a demand to send, in one sentence."""
    low = F.lower(sentence)
    asks = any_of(low, [m + v for v in L.SEND_VERBS for m in L.IMPERATIVE_MARKERS]) | low.rlike("^(?:" + "|".join(L.SEND_VERBS) + ")")
    return sentence.rlike("(?U)" + L.MAILBOX) & asks


def scan_matches(text: Column) -> Column:
    """Names of the instruction rules that fire, in rule order."""
    low = F.lower(text)
    parts = F.split(F.regexp_replace(text, r"([.;:])\s+", "$1\n"), "\n")
    rules = (
        (near(low, L.OVERRIDE_VERBS, L.OVERRIDE_OBJECTS), "override_instructions"),
        (any_of(low, L.SYSTEM_ADDRESS), "addressed_to_the_system"),
        (near(low, L.EXTRACTION_VERBS, L.EXTRACTION_OBJECTS, 40), "prompt_extraction"),
        (F.exists(parts, imperative_send), "imperative_with_recipient"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def second_person_action(text: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return any_of(low, L.SECOND_PERSON) & any_of(low, (*L.SEND_VERBS, *L.OVERRIDE_VERBS, *L.EXTRACTION_VERBS))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed character windows as structs (offset, chunk); blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got {overlap} and {size}")
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    live = F.filter(starts, lambda o: (o == 0) | (o - stride + size < F.length(text)))
    cut = F.transform(live, lambda o: F.struct(o.cast("long").alias("offset"), F.substring(text, o + 1, F.lit(size)).alias("chunk")))
    return F.filter(cut, lambda c: F.trim(c.chunk) != "")
