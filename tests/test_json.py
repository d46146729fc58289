"""F12/F13/F18 response parsing."""

from pyspark.sql import functions as F

from parlance.functions.json import extract_json, response_text
from parlance.functions.text import strip_boilerplate


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_extract_cases(spark):
    assert one(spark, extract_json, 'pre {"a": {"b": "}"}, "c": "\\"{"} post {"z":1}') == '{"a": {"b": "}"}, "c": "\\"{"}'
    assert one(spark, extract_json, "no object here") is None
    assert one(spark, extract_json, '{"a": [1, 2') is None
    assert one(spark, extract_json, '```json\n{"k": "v"}\n```') == '{"k": "v"}'
    assert one(spark, extract_json, 'héllo 😀 {"e": "😀 }"} tail') == '{"e": "😀 }"}'


def test_strip(spark):
    assert one(spark, strip_boilerplate, '<think>\n{x}\n</think>\n```json\n{"a":1}\n```\n') == '{"a":1}'


def test_response_text(spark):
    assert one(spark, response_text, '{"model": "m", "response": "  hi  "}') == "hi"
    assert one(spark, response_text, '{"response": "a"}\n{"response": "b"}\n') == "ab"
    assert one(spark, response_text, '{"model": "m"}') is None
    assert one(spark, response_text, "plain text") is None


def test_label_contract_types(spark):
    from parlance.operators.label import apply_label_responses
    from parlance.sources import fixtures as X
    bodies = {
        1: '{"categories": ["german", "x"], "tags": [], "summary": "s", "key_facts": [], "relevance_score": "0.4"}',
        2: '{"categories": "german", "summary": "s"}',
        3: '{"categories": ["german"], "summary": 5}',
        4: '{"categories": null, "summary": null, "tags": null}',
        5: '{"tags": {"a": 1}}',
    }
    prompts = spark.createDataFrame([(f"label:{k}", k) for k in bodies], "prompt_id string, conv_id long")
    responses = spark.createDataFrame([(f"label:{k}", v, None) for k, v in bodies.items()], "prompt_id string, response string, error string")
    out = {r.conv_id: r for r in apply_label_responses(prompts, responses, X.categories(spark)).collect()}
    assert out[1].status == "ok" and list(out[1].categories) == ["german"] and out[1].relevance_score == 0.4
    assert out[2].status == "error" and out[3].status == "error" and out[5].status == "error"
    assert out[4].status == "ok" and list(out[4].categories) == ["other"] and out[4].summary == ""


def test_float_cast_of_scores(spark):
    from pyspark.sql import functions as F

    from parlance.operators.label import float_value
    cases = {"0.7": 0.7, "1": 1.0, '"high"': 0.0, '"0.4 or so"': 0.4, '" .5e1x"': 5.0, "true": 1.0, "false": 0.0, "null": None, "[]": 0.0, "[1]": 1.0, "{}": 0.0, '{"a": 1}': 1.0}
    df = spark.createDataFrame([(k, '{"relevance_score": ' + k + "}") for k in cases] + [("none", "{}")], "k string, j string")
    got = {r.k: r.v for r in df.select("k", float_value(F.parse_json("j"), "$.relevance_score").alias("v")).collect()}
    assert got == cases | {"none": None}
