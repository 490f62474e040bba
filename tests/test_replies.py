from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire import config
from quire.functions import protocol as P
from quire.operators import glossary, links, panel, runs


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("reply", "n", "error", "parts"),
    [
        ("anything", 0, None, []),
        ("  alone \n", 1, None, ["alone"]),
        (" ", 1, "empty reply", None),
        ('<segment id="2">b</segment> <SEGMENT ID = \'1\' > a\nc </SEGMENT>', 2, None, ["a\nc", "b"]),
        ('```xml\n<segment id="1">a</segment>\n<segment id="2"></segment>\n```', 2, None, ["a", ""]),
        ('<segment id="1">a</segment>', 2, "wrong number of segments", None),
        ('<segment id="1">a</segment><segment id="1">b</segment>', 2, "repeated ids", None),
        ('<segment id="1">a</segment><segment id="3">b</segment>', 2, "wrong ids", None),
        ('note <segment id="1">a</segment><segment id="2">b</segment>', 2, "text outside tags", None),
        ("a\n\nb", 2, "no segment tags", None),
        ('<segment id="99999999999999999999">a</segment><segment id="2">b</segment>', 2, "wrong ids", None),
    ],
)
def test_tagged_replies(spark, reply, n, error, parts):
    got = one(spark, r=P.split_tagged(F.lit(reply), F.lit(n))).r
    assert (got.error, got.parts) == (error, parts)


def test_delimited_replies(spark):
    for reply, n, parts in (("a\n\n%%\n\nb", 2, ["a", "b"]), ("a\n %% \nb\n%%\n\n\n%% \nc", 3, ["a", "b", "%% \nc"]), ("a %% b", 2, None), ("a\n\n%%\n\n\n\n%%\n\nb", 2, ["a", "b"])):
        assert one(spark, r=P.split_delimited(F.lit(reply), F.lit(n))).r.parts == parts


def test_canonical_json(spark):
    for value in ("plain", 'q"\\', "é😀 ", "\n\t\b\f\r\x01\x7f", ""):
        assert one(spark, j=P.canonical_json(b=F.lit(value), a__raw=F.lit(3), c=F.lit(None))).j == json.dumps({"b": value, "a": 3, "c": None}, sort_keys=True)


def test_glossary_files(spark, tmp_path):
    rows = spark.createDataFrame([("x", i, f"t{i}", "翻", ["critical", "low", None][i % 3], ["fixed", "preferred", None][i % 3], ["a"] if i else [], "no" if i == 2 else "") for i in range(5)], "book string, ord int, term string, translation string, priority string, tier string, alternatives array<string>, negative string")
    glossary.write(rows, str(tmp_path / "g"), "book", 3)
    back = glossary.read(spark, str(tmp_path / "g" / "book=x")).collect()
    assert len(back) == 1 and back[0].error is None and [(t.term, t.tier, t.alternatives) for t in back[0].terms] == [("t0", "fixed", []), ("t1", "preferred", ["a"]), ("t2", None, ["a"])]
    block = glossary.blocks(rows, "book").first().block
    assert block == f"{P.FIXED_HEADING}\n  • t0 → 翻\n  • t3 → 翻\n  • t2 → 翻（no）\n\n{P.PREFERRED_HEADING}\n  • t1 → 翻（也可：a）\n  • t4 → 翻（也可：a）"
    assert glossary.urgent(rows, "medium").count() == 3
    usage = spark.createDataFrame([(True, "fixed"), (False, "preferred"), (False, None)], "consistent boolean, tier string")
    assert tuple(glossary.usage_summary(usage, F.col("tier")).first()) == (3, 1, 1)
    assert glossary.parse(spark.createDataFrame([("```json\n{}\n```",)], "reply string"), fenced=False).first().error == "not JSON"


def test_panel_without_judges(spark):
    named = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "id long, term string")
    proposed = spark.createDataFrame([(1, "v", 0, 0, "甲", "high", " 不译 "), (2, "v", 0, 1, "乙", None, "not 乙")], "id long, vendor string, vendor_ord int, prop_ord int, translation string, priority string, negative_constraint string")
    votes = spark.createDataFrame([], "id long, judge string, judge_ord int, keep boolean, translation string, enforce string, duplicate_of long")
    judges = spark.createDataFrame([], "judge string, judge_ord int")
    got = {r.id: r for r in panel.decide(named, proposed, votes, judges, 0).collect()}
    assert [(r.kept, r.translation, r.tier, r.priority, r.negative) for r in (got[1], got[2])] == [(True, "甲", None, "high", "不译"), (True, "乙", None, "medium", "")]
    assert got[1].reason == "Term Panel: nominated by v."


def test_runs(spark):
    requests = spark.createDataFrame([("r", 2, "m", 5, None), ("r", 1, "m", 3, 4)], "run string, ord int, model string, input_tokens int, output_tokens int")
    told = json.loads(runs.audit(requests).first().json)
    assert [x["ord"] for x in told["requests"]] == [1, 2] and told["summary"] == {"requests": 2, "input_tokens": 8}
    logs = spark.createDataFrame([("a\nb\r\n",), ("",), (None,), ("\n".join(map(str, range(30))),)], "t string")
    assert [r.tail for r in runs.log_tail(logs, "t").collect()][:3] == [["a", "b"], [], []]
    with pytest.raises(ValueError):
        runs.verdict({"a": F.lit(1)}, {}, ())


def test_links(spark):
    text = "[a](b.md) ![i](<c d.png>) [u](https://x.y/z) [h](#top)\n~~~\n[no](gone.md)\n~~~\n[f](file:///x) [p](sub/../b.md?x#y) [l](b.md:3-4) [q](%2e%2e/out.md) [e](b%23.md)"
    files = spark.createDataFrame([("d/a.md", text), ("d/b.md", ""), ("d/c d.png", ""), ("d", "")], "path string, text string")
    found = links.links(files)
    assert found.filter("path = 'd/a.md'").count() == 9
    got = {(r.line, r.target, r.reason) for r in links.broken(found, files).collect()}
    assert got == {(5, "file:///x", "machine-specific"), (5, "../out.md", "missing"), (5, "b#.md", "missing")}
    kept = [one(spark, m=links.maintained(F.lit(p))).m for p in ("a.md", "a.txt", "docs/_archive/README.md", "docs/_archive/x/README.md", "docs/_archive/x/y.md", "docs/_archive/x/y/README.md")]
    assert kept == [True, False, True, True, False, False]


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1, "c": "Yes"}, "n": "x"}')
    (tmp_path / "b.json").write_text('{"a": {"b": 2.0}, "l": [1]}')
    c = config.layers(str(tmp_path / "a.json"), str(tmp_path / "none.json"), str(tmp_path / "b.json"))
    assert (c.whole("a.b"), c.flag("a.c"), c.text("n"), c.at("a.x.y", 7), c.whole("n", 5), c.flag("n")) == (2, True, "x", 7, 5, None)
    schema = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"a": {"type": "object"}, "n": {"type": "string", "minLength": 2}, "l": {"type": "array", "minItems": 2, "items": {"type": "integer", "minimum": 2}}}}
    assert config.problems(c.data, schema) == ["$: q is missing", "$.n: needs 2 characters", "$.l: needs 2 items", "$.l[0]: minimum is 2"]
    assert config.problems(True, {"type": "integer"}) == ["$: must be integer"]
