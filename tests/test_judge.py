"""Judge verdict parsing edge cases (J1-J6) and the stored-report golden means (V3)."""

import pytest
from pyspark.sql import functions as F

from ragtide.operators import evaluate as EV
from ragtide.operators import judge as J

FULL = '{"faithfulness": 8, "relevance": 9, "completeness": 6, "citation": 10, "feedback": "ok {x}"}'


def _parse(spark, raws, digits=2):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    return {r["id"]: r for r in J.parse_verdicts(df, "raw", digits).collect()}


def test_forms(spark):
    raws = [
        FULL,                                          # 0 bare
        "```json\n" + FULL + "\n```",                  # 1 fenced
        FULL[:25],                                     # 2 truncated
        "  " + FULL + " Hope this helps.",             # 3 trailing text
        FULL.replace('"citation": 10, ', ""),          # 4 missing mark
        FULL.replace('"faithfulness": 8', '"faithfulness": "8"'),  # 5 quoted mark
        "I cannot evaluate this answer.",              # 6 not JSON
        "",                                            # 7 empty
        '{"faithfulness": 8, "relevance": 9, "completeness": 6, "citation": 10,}',  # 8 trailing comma
        '{"faithfulness": 08, "relevance": 9, "completeness": 6, "citation": 10}',  # 9 leading zero
        "\n\t" + FULL + "\n",                          # 10 surrounding whitespace
    ]
    out = _parse(spark, raws)
    ok = {i for i, r in out.items() if r["judge_ok"]}
    assert ok == {0, 1, 10}
    assert out[0]["overall"] == 8.25 and out[0]["feedback"] == "ok {x}"
    assert out[0]["completeness_missing"] == "N/A" and out[0]["faithfulness_issues"] == "N/A"
    for i in set(out) - ok:
        r = out[i]
        assert (r["faithfulness"], r["relevance"], r["completeness"], r["citation"], r["overall"]) == (0, 0, 0, 0, 0)
        assert r["feedback"] == "Parse error: " + raws[i][:100]


def test_overall_half_even(spark):
    # (2 + 2 + 3 + 2) / 4 = 2.25 -> 2.2 with one digit (Python round), not 2.3
    raw = '{"faithfulness": 2, "relevance": 2, "completeness": 3, "citation": 2, "feedback": "x"}'
    assert _parse(spark, [raw], digits=1)[0]["overall"] == 2.2
    raw = '{"faithfulness": 2.5, "relevance": 2.5, "completeness": 2.5, "citation": 2.52, "feedback": "x"}'
    assert _parse(spark, [raw], digits=2)[0]["overall"] == 2.5  # 2.505 -> 2.5 (binary value below the half)


def test_optional_fields_kept(spark):
    raw = ('{"faithfulness": 10, "relevance": 10, "completeness": 9, "citation": 10, "overall": 1,'
           ' "completeness_missing": "dose", "faithfulness_issues": "none", "feedback": "a } brace"}')
    r = _parse(spark, [raw])[0]
    assert r["judge_ok"] and r["overall"] == 9.75  # the model's own overall is replaced
    assert r["completeness_missing"] == "dose" and r["feedback"] == "a } brace"


def test_verdict_band(spark):
    df = spark.createDataFrame([(7.0,), (6.99,), (4.0,), (3.99,)], "m double")
    assert [r[0] for r in df.select(J.verdict_band("m")).collect()] == ["high", "mid", "mid", "low"]


def test_stored_report_golden_means(spark):
    # The five per-question marks of the stored evaluation report
    # (faithfulness, relevance, completeness, citation, overall); their means are 8.8 / 9.4 / 8.4 / 10.0 / 9.15.
    rows = [(10.0, 10.0, 10.0, 10.0, 10.0), (7.0, 8.0, 5.0, 10.0, 7.5), (10.0, 10.0, 9.0, 10.0, 9.75),
            (7.0, 9.0, 8.0, 10.0, 8.5), (10.0, 10.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "faithfulness double, relevance double, completeness double, "
                                     "citation double, overall double").withColumn("keyword_hit_rate", F.lit(1.0))
    m = EV.metric_averages(df).first()
    assert [round(m[c], 6) for c in EV.METRICS] == [8.8, 9.4, 8.4, 10.0, 9.15]


def test_answer_checks(spark):
    df = spark.createDataFrame(
        [("Dose 20 mg on day 3 [src1] [srcX]. Confidence: 85 %", "day 3 and 20 mg", ["src1", "src2"])],
        "answer string, context string, sources array<string>")
    r = df.select(J.ungrounded_numbers("answer", "context").alias("u"),
                  J.cited_sources("answer", "sources").alias("c"),
                  J.unknown_citations("answer", "sources").alias("k"),
                  J.confidence("answer").alias("conf")).first()
    assert r["u"] == ["1", "85"] and r["c"] == ["src1"] and r["k"] == ["srcX"] and r["conf"] == 85


def test_render_single_pass(spark):
    df = spark.createDataFrame([("what is {context}?", "ctx")], "q string, c string")
    r = df.select(J.render("Q: {question} C: {context}", question="q", context="c").alias("p")).first()["p"]
    assert r == "Q: what is {context}? C: ctx"


def test_long_and_nested_replies(spark):
    marks = '"faithfulness": 8, "relevance": 9, "completeness": 6, "citation": 10'
    raws = [
        "{" + marks + ', "feedback": "' + "x" * 1_000_000 + '"}',
        "{" + marks + ', "feedback": "' + "\\n" * 100_000 + '"}',
        "{" + marks + ', "faithfulness_issues": ["a, b", {"k": [1, 2.5e3, null]}, []]}',
        "{" + marks + ', "extra": {"a": {"b": [true, false]}}, "feedback": "q \\" ] }"}',
        "{" + marks + ', "faithfulness_issues": ["a" "b"]}',
        "{" + marks + ', "faithfulness_issues": [1, 2}',
        "{" + marks + ', "x": truefalse}',
        "[" + "{" + marks + "}" + "]",
    ]
    out = _parse(spark, raws)
    assert {i for i, r in out.items() if r["judge_ok"]} == {0, 1, 2, 3}
    assert len(out[0]["feedback"]) == 1_000_000 and out[2]["faithfulness_issues"].startswith("[")


def test_failed_calls(spark):
    df = spark.createDataFrame([(1, "timeout"), (2, None)], "id int, error string")
    rows = {r["id"]: r for r in J.failed_verdicts(df).collect()}
    assert rows[1]["feedback"] == "Eval error: timeout" and rows[2]["feedback"] == "Eval error: "
    assert rows[1]["overall"] == 0 and not rows[1]["judge_ok"]


def _nested(depth, kind):
    return ("[" * depth + "]" * depth) if kind == "list" else '{"a":' * depth + "1" + "}" * depth


def test_validity_is_that_of_a_parser(spark):
    """Any depth, width and non-finite number, against Python's parser."""
    import json

    extra = [_nested(n, kind) for n in (1, 8, 9, 50, 900) for kind in ("list", "object")]
    extra += ["NaN", "-Infinity", "nan", "[1,]", "[[1]", '[{"a":[1,{"b":[]}]},[[],[2]]]', "[" + ",".join(["[1]"] * 2000) + "]", "1 2", '"a" "b"']
    raws = [FULL[:-1] + ', "x": ' + x + "}" for x in extra] + ["　 " + FULL + " \x85"]
    out = _parse(spark, raws)
    for i, raw in enumerate(raws):
        try:
            json.loads(raw.strip())
            valid = True
        except ValueError:
            valid = False
        assert out[i]["judge_ok"] == valid, raw[:200]


def test_marks_that_no_mean_survives(spark):
    out = _parse(spark, [FULL.replace("10", "NaN")])
    assert not out[0]["judge_ok"] and out[0]["overall"] == 0


def test_isotonic_fit_is_the_nearest_nondecreasing_curve(spark):
    """Against the min-max formula: max over starts, min over ends, of the mean in between."""
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(0, 101, 7), rng.choice([0.0, 1 / 3, 2 / 3, 1.0])) for _ in range(300)] + [(None, 1.0), (5, None)]
    df = spark.createDataFrame(rows, "confidence bigint, outcome double")
    got = {r.confidence: r for r in J.isotonic_fit(df).collect()}
    values = sorted({c for c, o in rows if c is not None and o is not None})
    by = {v: [o for c, o in rows if c == v and o is not None] for v in values}
    mean = lambda part: sum(sum(by[v]) for v in part) / sum(len(by[v]) for v in part)
    for i, v in enumerate(values):
        want = max(min(mean(values[a:b + 1]) for b in range(i, len(values))) for a in range(i + 1))
        assert abs(got[v].calibrated - want) < 1e-6 and got[v].n == len(by[v])
    assert len(got) == len(values)
    assert J.isotonic_fit(df.limit(0)).count() == 0 and J.calibration_summary(df.limit(0)).first().n is None
