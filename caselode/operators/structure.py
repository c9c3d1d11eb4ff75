"""Structured documents: layout lines to a tree of nodes, to leaf and parent rows, by windows over each document's lines.

A line is classified by its own text and its neighbours; what it belongs to is the last container, heading, provision and
subsection before it. Provisions that a document inserts into another one nest below what inserts them; an inserted block
ends with the first subsection set further out. The Act that they go into is the nearest one that their provision names,
or the one named by the section that authorises their schedule. All windows run within one document.

Defined results: null texts have no lines. A document without an enacting formula begins at its first part or schedule
that a subsection follows within 60 lines of the page; one without that has no body and gives no rows. Text outside
provisions and headings with nothing below them are left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.session import checkpointed

# fixed values: line patterns of a layout-preserved statute
PART = r"^\s*PART\s+([0-9]+|[IVXLCDM]+)\s*$"
SCHEDULE = r"^\s*SCHEDULE\s+([0-9]+|[IVXLCDM]+)\s*(?:Sections?\s+([\d(),\sand]+))?\s*$"
SECTION = r"^(\d+[A-Z]*)\s{2,}(\S.*)$"
INSERTED = r"^[\s“”\"']*(\d+[A-Z]+)\s+(\S.*)$"
SUBSECTION = r"^\((\d+)\)\s+(.*)$"
OPENER = r"^(\d+[A-Z]*)\s+\((\d+)\)\s+(\S.*)$"
PARAGRAPH = r"^\(([a-z]{1,3}|[ivxlcdm]{1,6})\)\s+(.*)$"
ENACTING = r"^\s*B\s*E\s+IT\s+ENACTED\b|^\s*Be\s+it\s+enacted\b"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
AUTHORITY = r"^\s*Sections?\s+[\d,\sand]+$"
# fixed values: furniture that every document may have, beside its own title
FURNITURE = (r"^\s*Part\s+[0-9IVXLCDM]+\s*[—–-]", r"^\s*Schedules?\s*$", r"^\s*Schedule\s+\d+\s*[—–-]")
# fixed values: names of Acts, and the phrases by which a provision says which Act it changes
ACT = r"[A-Z][\w'’\-()]*(?:\s+[\w'’\-()]+){0,10}\s+Act\s+\d{4}"
DIRECTIVE = rf"\b(?:[IiOo][nf]|of)\s+the\s+({ACT})|\b(?:The|the)\s+({ACT})\s+is\s+amended"
AMENDS = rf"\bamends\b[^.]*?\bthe\s+({ACT})"
# fixed values: widths, and the ends of lines that are prose, finished or quoted
HEADING_CHARS, CROSS_HEADING_CHARS, INDENT, WINDOW, OUT = 110, 80, 3, 60, 2
PROSE_ENDS = (".", ";", ":", ",", "—", "-", "and", " or")
FINISHED = r"[.;:—–!?”\"']$"
QUOTES = "“”‘’\"'"
# fixed values: words that stay small within a title
SMALL = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with", "without")


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, pos, page, indent and text of every line, and the columns to keep; other line breaks count as line feeds."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|[\u000b\u001c\u001d\u001e\u0085  \r]", "\n")
    pages = docs.select("doc_id", *keep, F.posexplode(F.split(text, "\f")).alias("page", "body"))
    rows = pages.select("doc_id", *keep, "page", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n")) - 1
    return rows.select("doc_id", *keep, pos.cast("long").alias("pos"), (F.col("page") + 1).alias("page"), indent(F.col("line")).alias("indent"), F.rtrim("line").alias("line"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    """Without quotes and white space at the ends, white space within laid together."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^[\s{QUOTES}]+|[\s{QUOTES}]+$", ""), r"(?U)\s+", " ")


def indent(line: Column) -> Column:
    return (F.length(F.rtrim(line)) - F.length(F.ltrim(F.rtrim(line)))).cast("int")


def title_case(text: Column) -> Column:
    words = F.split(F.lower(cleaned(text)), " ")
    large = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL), w).otherwise(large(w))), " ")


def titled(rows: DataFrame) -> DataFrame:
    """rows with the document's title: the first line of its first page that has more than eight characters."""
    t = stripped(F.col("line"))
    first = F.min(F.when((F.col("page") == 1) & (F.length(t) > 8) & ~t.rlike(r"(?U)^\d+$"), F.struct("pos", t.alias("t")))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("document", F.coalesce(first.t, F.lit("Document")))


def body(rows: DataFrame) -> DataFrame:
    """The lines of the body and the document's title: what follows the enacting formula's paragraph, without running headers
    (patterns made from the document's own title), page numbers and authority lines."""
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = titled(rows)
    line, blank = F.col("line"), stripped(F.col("line")) == ""
    marker = line.rlike(PART) | line.rlike(SCHEDULE)
    followed = F.max(stripped(line).rlike(SUBSECTION)).over(page.rowsBetween(0, WINDOW - 1))
    rows = rows.withColumns({"_formula": F.min(F.when(line.rlike(ENACTING), F.struct("page", "pos"))).over(Window.partitionBy("doc_id")), "_marker": marker & followed, "_last": F.lead("pos").over(page).isNull()})
    same = F.col("page") == F.col("_formula.page")
    gap = F.min(F.when(same & (F.col("pos") > F.col("_formula.pos")) & blank, F.col("pos"))).over(Window.partitionBy("doc_id"))
    end = F.max(F.when(same, F.col("pos"))).over(Window.partitionBy("doc_id")) + 1
    start = F.when(F.col("_formula").isNotNull(), F.coalesce(gap, end)).otherwise(F.min(F.when(F.col("_marker"), F.col("pos"))).over(Window.partitionBy("doc_id")))
    quoted = F.concat(F.lit(r"\Q"), F.replace("document", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    own = F.concat(F.lit(r"^\s*\d*\s*"), quoted, F.lit(r"(\s*\(c\.\s*\d+\))?\s*$|^\s*\d+\s+"), quoted)
    furniture = F.rlike(line, own) | line.rlike("|".join((*FURNITURE, PAGE_NUMBER, AUTHORITY)))
    marked = rows.withColumn("_start", start)
    return marked.where((F.col("pos") >= F.col("_start")) & ~furniture & ~(F.col("_last") & (line == ""))).drop("_formula", "_marker", "_last", "_start")


def classified(rows: DataFrame) -> DataFrame:
    """kind, number and title of every line; the first rule that fits wins, text is the rest."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    if "document" not in rows.columns:
        rows = rows.withColumn("document", F.lit("Document"))
    t, heading = F.col("t"), F.col("heading")
    short = (F.length("heading") <= HEADING_CHARS) & ~heading.endswith(".")
    rows = rows.withColumn("t", stripped(F.col("line")))
    inset = t.rlike(INSERTED) & ~t.rlike(SECTION)
    rows = rows.withColumn("heading", stripped(F.when(t.rlike(SECTION), F.regexp_extract(t, SECTION, 2)).when(inset, F.regexp_extract(t, INSERTED, 2)).otherwise("")))
    rows = rows.withColumns({
        "caps": t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]"), "is_part": t.rlike(PART), "is_schedule": t.rlike(SCHEDULE),
        "is_section": (F.col("indent") <= INDENT) & t.rlike(SECTION) & short,
        "is_inserted": (F.col("indent") > 0) & t.rlike(INSERTED) & short & heading.rlike(r"^\p{Lu}") & F.coalesce(F.lag(t).over(order) == "", F.lit(True)),
        "after_blank": F.coalesce(F.lag(t).over(order) == "", F.lit(True)),
    })
    structural = F.col("is_part") | F.col("is_schedule") | t.rlike(OPENER) | F.col("is_section") | F.col("is_inserted") | F.col("caps")
    content = F.when(t != "", F.struct("t", "indent", "caps", "is_part", "is_schedule", "is_section", structural.alias("structural")))
    rows = rows.withColumns({"before": F.last(content, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.last(content, ignorenulls=True).over(back)})
    yes = lambda c: F.coalesce(c, F.lit(False))
    names_part, names_schedule = F.col("caps") & ~F.col("is_schedule"), F.col("caps") & ~F.col("is_part")
    bare = F.regexp_replace(t, rf"^[ {QUOTES}]+|[ {QUOTES}]+$", "")
    prose = F.lit(False)
    for end in PROSE_ENDS:
        prose = prose | bare.endswith(end)
    cross = (F.col("indent") > 0) & (F.length(t) <= CROSS_HEADING_CHARS) & bare.rlike(r"^[\p{Lu}\p{N}]") & ~F.col("bare_caps") & ~prose & ~bare.rlike(SUBSECTION) & ~bare.rlike(PARAGRAPH) & F.col("after_blank") & yes(F.col("after.is_section"))
    wrapped = yes(~F.col("before.t").rlike(FINISHED) & ~F.col("before.structural") & (F.col("indent") > F.col("before.indent")))
    kind = (
        F.when(t == "", "blank")
        .when(yes(F.col("before.is_part") & names_part & ~F.col("is_part")) | yes(F.col("before.is_schedule") & names_schedule & ~F.col("is_schedule")), "title")
        .when(F.col("is_part"), "part")
        .when(F.col("is_schedule"), "schedule")
        .when(F.col("is_section"), "section")
        .when((F.col("indent") <= INDENT) & t.rlike(OPENER), "opener")
        .when(cross, "heading")
        .when(F.col("is_inserted"), "inserted")
        .when((F.col("indent") > 0) & t.rlike(SUBSECTION) & ~wrapped, "subsection")
        .otherwise("text")
    )
    out = rows.withColumn("bare_caps", bare.rlike(r"\p{Lu}") & ~bare.rlike(r"[\p{L}&&[^\p{Lu}]]")).withColumn("kind", kind)
    k, get = F.col("kind"), lambda p, g: F.regexp_extract(t, p, g)
    number = F.when(k == "part", get(PART, 1)).when(k == "schedule", get(SCHEDULE, 1)).when(k == "section", get(SECTION, 1)).when(k == "opener", get(OPENER, 1)).when(k == "inserted", get(INSERTED, 1)).when(k == "subsection", get(SUBSECTION, 1)).otherwise("")
    follows = F.when((k == "part") & yes(F.col("after.caps") & ~F.col("after.is_schedule") & ~F.col("after.is_part")) | (k == "schedule") & yes(F.col("after.caps") & ~F.col("after.is_part") & ~F.col("after.is_schedule")), title_case(F.col("after.t"))).otherwise("")
    title = F.when(k.isin("section", "inserted"), cleaned(heading)).when(k == "heading", cleaned(t)).when(k.isin("part", "schedule"), follows).otherwise("")
    text = F.when(k == "opener", cleaned(get(OPENER, 3))).when(k == "subsection", cleaned(get(SUBSECTION, 2))).when(k == "text", cleaned(t)).otherwise("")
    authority = F.when(k == "schedule", F.regexp_extract(get(SCHEDULE, 2), r"^\s*(\d+[A-Z]*)", 1)).otherwise("")
    return out.select("doc_id", "document", "pos", "page", "indent", "kind", number.alias("number"), title.alias("title"), text.alias("text"), F.when(k == "opener", get(OPENER, 2)).alias("sub"), authority.alias("authority"))


CONTAINERS = ("part", "schedule")
PROVISIONS = ("section", "inserted")


def _gathered(rows: DataFrame) -> DataFrame:
    """One row for each node, in the order in which they open (n), its text lines joined."""
    order = Window.partitionBy("doc_id").orderBy("pos", "step")
    both = F.when(F.col("kind") == "opener", F.array(F.lit("section"), F.lit("subsection"))).otherwise(F.array("kind"))
    rows = rows.where("kind not in ('blank', 'title')").select("*", F.posexplode(both).alias("step", "k"))
    second = (F.col("kind") == "opener") & (F.col("step") == 1)
    rows = rows.select(
        "doc_id", "document", "pos", "step", "page", F.col("k").alias("kind"), F.when(second, F.col("sub")).otherwise(F.col("number")).alias("number"), "title",
        F.when((F.col("kind") == "opener") & (F.col("step") == 0), "").otherwise(F.col("text")).alias("text"), (F.col("indent") + second.cast("int")).alias("indent"), "authority",
    )
    rows = rows.withColumn("n", F.sum((F.col("kind") != "text").cast("int")).over(order)).where("n > 0")
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "step", "text"))))
    first = [F.min_by(c, F.struct("pos", "step")).alias(c) for c in ("document", "kind", "number", "title", "page", "indent", "authority")]
    nodes = rows.groupBy("doc_id", "n").agg(*first, F.array_join(F.transform(parts, lambda x: x.text), " ").alias("text"))
    return nodes.withColumn("text", F.when(F.col("kind").isin("part", "schedule", "heading"), "").otherwise(F.col("text")))


def _placed(nodes: DataFrame) -> DataFrame:
    """nodes with what they stand in: sched, part, head and prov (n of each, null if none), the inserted provision that is open,
    their parent, and the run of provisions inserted one below the other."""
    order = Window.partitionBy("doc_id").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    k, n = F.col("kind"), F.col("n")
    last = lambda kinds, value: F.last(F.when(k.isin(*kinds), value), ignorenulls=True).over(so_far)
    of = lambda kinds, kind: last(kinds, F.when(k == kind, n).otherwise(0))
    some = lambda c: F.nullif(c, F.lit(0))
    above = ("part", "schedule", "heading")
    nodes = nodes.withColumns({
        "sched": last(("schedule",), n), "part": some(of(CONTAINERS, "part")), "head": some(of(above, "heading")),
        "prov": some(of((*above, "section"), "section")), "block": last((*above, "section"), n),
    }).withColumn("block", F.coalesce("block", F.lit(0)))
    inside = Window.partitionBy("doc_id", "block").orderBy("n")
    inside_so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"ins": F.last(F.when(k == "inserted", n), ignorenulls=True).over(inside_so_far), "ins_indent": F.last(F.when(k == "inserted", F.col("indent")), ignorenulls=True).over(inside_so_far)})
    since = Window.partitionBy("doc_id", "block", "ins").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    furthest = F.min(F.when(k == "subsection", F.col("indent"))).over(since)
    nodes = nodes.withColumn("open", F.when(F.col("ins").isNotNull(), F.coalesce(furthest >= F.col("ins_indent") - OUT, F.lit(True))).otherwise(False))
    before = F.lag(F.struct("kind", "n", "open", "ins")).over(inside)
    nodes = nodes.withColumn("before", before).withColumn("by", F.when((k == "inserted") & (F.col("before.kind") == "subsection"), F.col("before.n")))
    linked = F.coalesce(F.col("by").isNotNull() & F.col("before.open"), F.lit(False))
    nodes = nodes.withColumns({"run": F.sum(((k == "inserted") & ~linked).cast("int")).over(inside_so_far), "block_run": F.sum(((k == "inserted") & ~F.coalesce(F.col("before.open"), F.lit(False))).cast("int")).over(inside_so_far)})
    container = F.coalesce("part", "sched", F.lit(0))
    parent = (
        F.when(k == "schedule", 0).when(k == "part", F.coalesce("sched", F.lit(0))).when(k == "heading", container).when(k == "section", F.coalesce("head", container))
        .when(k == "inserted", F.coalesce("by", "prov", container)).otherwise(F.coalesce(F.when(F.col("open"), F.col("ins")), "prov", "head", container))
    )
    return nodes.withColumn("parent", parent)


def _along(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """nodes with an array of value along the path from below the root to each node."""
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("doc_id", "block", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("kind")
    nodes = nodes.withColumn("_v", value)
    nodes = nodes.withColumn("_by", F.lag("_v").over(Window.partitionBy("doc_id", "block").orderBy("n")))
    last = lambda kind, here: F.when(here, F.last(F.when(k == kind, F.col("_v")), ignorenulls=True).over(order))
    pairs = F.collect_list(F.when(k == "inserted", F.array_compact(F.array(F.when(F.col("by").isNotNull(), F.col("_by")), F.col("_v"))))).over(run)
    first_by = F.first(F.when(k == "inserted", F.coalesce("by", F.lit(0))), ignorenulls=True).over(run)
    nodes = nodes.withColumns({"_sched": last("schedule", F.col("sched").isNotNull()), "_part": last("part", F.col("part").isNotNull()), "_head": last("heading", F.col("head").isNotNull()), "_prov": last("section", F.col("prov").isNotNull()), "_pairs": pairs, "_first_by": first_by})
    below = F.when(k == "inserted", F.flatten("_pairs")).when((k == "subsection") & F.col("open"), F.concat(F.flatten("_pairs"), F.array("_v"))).when(k == "subsection", F.array("_v"))
    # a provision inserted where no provision is open hangs on the container, not on its heading
    past_heading = F.col("prov").isNull() & ((k == "inserted") | (k == "subsection") & F.col("open")) & (F.col("_first_by") == 0)
    top = F.array_compact(F.array("_sched", "_part", F.when(~F.coalesce(past_heading, F.lit(False)), F.col("_head")), "_prov"))
    return nodes.withColumn(name, F.concat(top, F.coalesce(below, F.array().cast(f"array<{dict(nodes.dtypes)['_v']}>")))).drop("_v", "_by", "_sched", "_part", "_head", "_prov", "_pairs", "_first_by")


def _act(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    return F.nullif(cleaned(F.concat(*[F.regexp_extract(text, "(?U)" + pattern, g) for g in groups])), F.lit(""))


def _hosted(nodes: DataFrame) -> DataFrame:
    """nodes with host, the Act that an inserted provision goes into ("" if none is named), inserted_by and by_schedule."""
    inside = Window.partitionBy("doc_id", "block").orderBy("n")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("kind")
    nodes = nodes.withColumn("_named", F.when(k.isin("section", "subsection"), _act(F.col("text"), DIRECTIVE, (1, 2)))).withColumn("_titled", F.when(k == "section", _act(F.col("title"), DIRECTIVE, (1, 2))))
    by = F.when(F.col("by").isNotNull(), F.lag("_named").over(inside))
    own = lambda c: F.last(F.when(k == "section", F.col(c)), ignorenulls=True).over(before)
    earlier = F.last(F.when((k == "subsection") & (F.col("parent") == F.col("prov")), F.col("_named")), ignorenulls=True).over(before)
    nodes = nodes.withColumn("_host", F.when(k == "inserted", F.coalesce(by, own("_named"), own("_titled"), earlier)))
    # an inserted provision follows the one before it while that is still open
    chain = Window.partitionBy("doc_id", "block", "block_run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumn("host", F.when(k == "inserted", F.last("_host", ignorenulls=True).over(chain)))
    to = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, c: F.last(F.when(k == kind, F.col(c)), ignorenulls=True).over(to)
    inserted = k == "inserted"
    nodes = nodes.withColumns({
        "inserted_by": F.when(inserted & F.col("prov").isNotNull(), last("section", "number")).otherwise(""),
        "by_schedule": F.when(inserted & F.col("sched").isNotNull(), last("schedule", "number")).otherwise(""),
        "authority": F.when(F.col("sched").isNotNull(), last("schedule", "authority")),
    })
    outside = nodes.where("sched is null and prov is not null and (kind = 'section' or parent = prov)")
    texts = F.array_sort(F.collect_list(F.struct("n", "text")))
    sections = outside.groupBy("doc_id", "prov").agg(F.max(F.when(k == "section", F.col("number"))).alias("authority"), texts.alias("texts"))
    newest = sections.groupBy("doc_id", "authority").agg(F.max_by("texts", "prov").alias("texts"))
    amended = newest.select("doc_id", "authority", _act(F.array_join(F.transform("texts", lambda x: x.text), " "), AMENDS, (1,)).alias("_amended")).where("_amended is not null")
    return nodes.join(amended, ["doc_id", "authority"], "left").withColumn("host", F.when(inserted, F.coalesce("host", "_amended", F.lit(""))).otherwise("")).drop("_named", "_titled", "_host", "_amended", "authority")


def label() -> Column:
    k = F.col("kind")
    joined = lambda *c: F.regexp_replace(F.concat_ws(" ", *c), r"^ +| +$", "")
    host = F.when(F.col("host") != "", F.concat(F.lit(" ["), F.col("host"), F.lit("]"))).otherwise("")
    return (
        F.when(k == "part", joined(F.concat(F.lit("Part "), F.col("number")), F.col("title"))).when(k == "schedule", joined(F.concat(F.lit("Schedule "), F.col("number")), F.col("title")))
        .when(k == "heading", F.col("title")).when(k.isin(*PROVISIONS), joined(F.concat(F.lit("s."), F.col("number"), host), F.col("title"))).otherwise(F.concat(F.lit("("), F.col("number"), F.lit(")")))
    )


def nodes(rows: DataFrame) -> DataFrame:
    """The tree: a row for each node in document order. ordinal (the root, which has no row, is 0), kind, number, title, text, page,
    parent and path (ordinals, from below the root to the node), what it stands in, provision (ordinal of the section or
    inserted provision around it), host, inserted_by, by_schedule, label, breadcrumb and citation."""
    # both are read several times; their lineage would be gone through anew each time
    tree = checkpointed(_hosted(checkpointed(_placed(_gathered(rows)))))
    children = tree.groupBy("doc_id", F.col("parent").alias("n")).agg(F.count(F.lit(1)).alias("children"))
    tree = tree.join(children, ["doc_id", "n"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    tree = tree.where("kind <> 'heading' or children > 0")  # a heading is inferred; one with nothing below it was none
    tree = tree.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    tree = _along(_along(tree.withColumn("label", label()), "labels", F.col("label")), "path", F.col("ordinal"))
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    k, before = F.col("kind"), lambda kind, c: F.last(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True).over(order)
    here = lambda at, c: F.when(F.col(at).isNotNull(), c)
    inside = F.last(F.when(k == "inserted", F.struct("ordinal", "kind", "number", "title", "host", "inserted_by", "by_schedule")), ignorenulls=True).over(Window.partitionBy("doc_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    section = here("prov", before("section", "around"))
    tree = tree.withColumn("around", F.struct("ordinal", "kind", "number", "title", "host", "inserted_by", "by_schedule"))
    around = F.when(k.isin(*CONTAINERS, "heading"), None).when((k == "inserted") | F.col("open"), inside).otherwise(section)
    tree = tree.withColumns({"around": around, "s_number": here("sched", before("schedule", "number")), "c_label": F.coalesce(here("part", before("part", "label")), here("sched", before("schedule", "label")), F.lit("")), "h_title": F.coalesce(here("head", before("heading", "title")), F.lit("")), "p_part": here("part", before("part", "number"))})
    crumb = F.array_join(F.concat(F.array("document"), F.col("labels")), " > ")
    tree = tree.withColumns({"p_kind": F.coalesce("around.kind", F.lit("")), "p_number": F.coalesce("around.number", F.lit("")), "p_title": F.coalesce("around.title", F.lit("")), "provision": F.col("around.ordinal"), "breadcrumb": crumb})
    return tree.withColumn("citation", citation()).select(
        "doc_id", "document", "ordinal", "kind", "number", "title", "text", "page", F.coalesce(F.try_element_at("path", F.lit(-2)), F.lit(0)).alias("parent"), "path", "children", "provision",
        "p_kind", "p_number", "p_title", F.col("c_label").alias("container"), F.col("h_title").alias("heading"), F.col("around.host").alias("host"), F.col("around.inserted_by").alias("inserted_by"), "label", "breadcrumb", "citation",
    )


def citation() -> Column:
    """The citation of a node: containers by their number, provisions by theirs; what is inserted elsewhere by its Act."""
    k, around = F.col("kind"), F.col("around")
    sub = F.when(k == "subsection", F.concat(F.lit("("), F.col("number"), F.lit(")"))).otherwise("")
    by = F.when((around.inserted_by != "") & (around.by_schedule != ""), F.concat(F.lit(" (as inserted by Sch. "), around.by_schedule, F.lit(" para. "), around.inserted_by, F.lit(")"))).when(around.inserted_by != "", F.concat(F.lit(" (as inserted by s."), around.inserted_by, F.lit(")"))).otherwise("")
    host = F.concat(F.when(around.host != "", around.host).otherwise("the host Act"), F.lit(" s."), around.number, sub, by)
    inside = F.when(F.col("s_number").isNotNull(), F.concat(F.lit("Sch. "), F.col("s_number"), F.lit(" para. "), around.number, sub)).otherwise(F.concat(F.lit("s."), around.number, sub))
    container = F.when(F.col("p_part").isNotNull(), F.concat(F.lit("Part "), F.col("p_part"))).when(F.col("s_number").isNotNull(), F.concat(F.lit("Sch. "), F.col("s_number")))
    return (
        F.when(k == "part", F.concat(F.lit("Part "), F.col("number"))).when(k == "schedule", F.concat(F.lit("Sch. "), F.col("number")))
        .when(k == "heading", F.concat_ws(" — ", container, F.col("title"))).when(around.isNull(), k).when(around.kind == "inserted", host).otherwise(inside)
    )


def own_text() -> Column:
    """A node's text, a subsection's after its number."""
    return F.when((F.col("kind") == "subsection") & (F.col("text") != ""), F.concat(F.lit("("), F.col("number"), F.lit(") "), F.col("text"))).otherwise(F.col("text"))


def row_id(letter: str, ordinal: Column, cite: Column) -> Column:
    return F.format_string(f"{letter}%05d::%s", ordinal, cite)


def leaves(tree: DataFrame) -> DataFrame:
    """Searchable rows: subsections with a provision and nothing below them, and provisions without subsections of their own.
    document is what is embedded, the breadcrumb and the text after it."""
    subs = tree.where("kind = 'subsection'").select("doc_id", F.col("parent").alias("ordinal")).distinct().withColumn("has_subs", F.lit(True))
    marked = tree.join(subs, ["doc_id", "ordinal"], "left")
    units = marked.where("kind = 'subsection' and children = 0 and provision is not null or kind in ('section', 'inserted') and has_subs is null")
    around = tree.where("kind in ('section', 'inserted')").select("doc_id", F.col("ordinal").alias("provision"), row_id("p", F.col("ordinal"), F.col("citation")).alias("parent_id"))
    raw = own_text()
    return units.join(around, ["doc_id", "provision"], "left").select(
        "doc_id", row_id("l", F.col("ordinal"), F.col("citation")).alias("id"), "parent_id", "ordinal", "citation", "breadcrumb", "kind", F.col("p_number").alias("section_number"), F.col("p_title").alias("section_title"),
        F.col("container").alias("part"), "heading", "page", F.length(raw).alias("chars"), "text", raw.alias("raw_text"), F.concat_ws("\n", "breadcrumb", raw).alias("document"), "provision",
    )


def full_texts(tree: DataFrame) -> DataFrame:
    """doc_id, ordinal and full_text of every section and inserted provision: its own text and that of all below it, in order.
    Each node's text goes to the provisions on its own path, so that no two nodes of a document are compared."""
    below = tree.select("doc_id", "ordinal", "kind", "label", "text", "title", own_text().alias("own"), F.explode("path").alias("of"))
    heads = tree.where("kind in ('section', 'inserted')").select("doc_id", F.col("ordinal").alias("of"))
    itself = F.col("of") == F.col("ordinal")
    piece = F.when(itself, F.col("text")).when(F.col("own") != "", F.col("own")).when((F.col("kind") != "subsection") & (F.col("title") != ""), F.col("label")).otherwise("")
    rows = below.join(heads, ["doc_id", "of"]).withColumn("piece", piece)
    parts = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("ordinal", "piece"))))
    return rows.groupBy("doc_id", F.col("of").alias("ordinal")).agg(F.array_join(F.transform(parts, lambda x: x.piece), "\n").alias("full_text"))


def parents(tree: DataFrame) -> DataFrame:
    """A row for each provision, inserted ones included, with its full text."""
    rows = tree.where("kind in ('section', 'inserted')").join(full_texts(tree), ["doc_id", "ordinal"])
    return rows.select(
        "doc_id", row_id("p", F.col("ordinal"), F.col("citation")).alias("id"), "ordinal", "citation", "breadcrumb", "kind", F.col("number").alias("section_number"), F.col("title").alias("section_title"), F.col("container").alias("part"), "heading",
        "page", F.length("full_text").alias("chars"), F.col("children").alias("child_count"), F.col("full_text").alias("raw_text"), F.concat_ws("\n", "breadcrumb", "full_text").alias("document"), F.col("host").alias("host_document"), "inserted_by",
    )


def checked(tree: DataFrame, sections: int = 150, subsections: int = 900, parts: int = 5) -> DataFrame:
    """Per document: counts by kind and every quality rule that fails."""
    n = lambda c: F.count_if(c)
    k = F.col("kind")
    counts = tree.groupBy("doc_id").agg(n(k == "part").alias("parts"), n(k.isin("section", "inserted")).alias("provisions"), n(k == "subsection").alias("subsections"), n((k == "subsection") & (F.coalesce("p_number", F.lit("")) == "")).alias("orphans"), n((k == "subsection") & (F.trim("text") == "")).alias("empty"))
    rules = (
        (F.col("provisions") < sections, "too few sections"), (F.col("subsections") < subsections, "too few subsections"), (F.col("parts") < parts, "too few parts"),
        (F.col("orphans") > 0.1 * F.col("subsections"), "too many orphans"), (F.col("empty") > F.greatest(F.lit(5), F.col("subsections") / 100), "too many empty subsections"),
    )
    return counts.withColumn("failures", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])), "; "))
