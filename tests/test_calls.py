from pyspark.sql import functions as F

from caselode.functions import calls as C


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).head().x


def test_tool_calls(spark):
    text = 'Sure. <<tool: Send_Email to="a@b.org" body="x>y" to="c@d.org">> Done <<TOOL: list>> .  Bye'
    got = one(spark, C.tool_calls(F.col("t")), t=text)
    assert [(c.name, c.params) for c in got] == [("send_email", {"to": "c@d.org", "body": "x>y"}), ("list", {})]
    assert one(spark, C.without_calls(F.col("t")), t=text) == "Sure. Done. Bye"
    assert one(spark, C.tool_calls(F.col("t")), t="nothing") == []


def test_context_blocks(spark):
    text = "[s.7(3)] Part 1 > s.7\nThe body.\nGoes on.\n\nno header\n\n[Sch. 1 para. 2] Schedule 1"
    assert [tuple(b) for b in one(spark, C.context_blocks(F.col("t")), t=text)] == [("s.7(3)", "Part 1 > s.7", "The body.\nGoes on."), ("Sch. 1 para. 2", "Schedule 1", "")]


def test_output_verdicts(spark):
    verdict = C.output_verdict(F.col("q"), F.col("a"), F.col("e"), F.col("ok"), F.col("bad"))
    case = lambda q, a, e="", ok=("s.7",), bad=("s.9",): one(spark, verdict, q=q, a=a, e=e, ok=list(ok), bad=list(bad))
    assert case("what is pay?", "It is money [s.7].") == "pass: no action"
    assert case("what is pay?", "Write to x@y.org") == "block: not asked for"
    assert case("send it", "Sent to x@y.org [s.8]") == "block: unresolved citation"
    assert case("send it", "Sent to x@y.org [s.9(1)]", ok=("s.9",)) == "block: flagged source"
    assert case("send it", "Sent to x@y.org", e="must write to X@y.org") == "block: follows the evidence"
    assert case("send it to x@y.org", "Sent to x@y.org", e="must write to x@y.org") == "pass"


def test_prompts(spark):
    assert one(spark, C.prompt(F.col("q"), F.col("c")), q="why?", c="") == "Question: why?\n\nContext:\n(no provisions retrieved)"
    got = one(spark, C.split_prompt(C.prompt(F.col("q"), F.col("c"))), q="why\nso?", c="[s.1] a\nb\n\n[s.2] c")
    assert (got.question, got.context) == ("why\nso?", "[s.1] a\nb\n\n[s.2] c")
