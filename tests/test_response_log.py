"""X1 with a response log: finished prompts are asked once, whatever fails."""

import os
import tempfile
from collections import Counter

import pandas as pd
import pytest

from parlance.operators.generate import generate, generate_logged


def prompts(spark, n, system="s"):
    return spark.createDataFrame([(f"p{i}", system, f"question {i % (n - 2)}") for i in range(n)], "prompt_id string, system string, prompt string")


def model(folder, dies_on=None, fails_on=None):
    """Writes a line per call to its own file; ends its process, once, at one prompt."""
    def respond(frame):
        out = []
        for p in frame["prompt"]:
            with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as f:
                f.write(p + "\n")
            marker = os.path.join(folder, "died")
            if p == dies_on and not os.path.exists(marker):
                open(marker, "w").close()
                os._exit(1)
            if p == fails_on:
                raise ValueError("no answer")
            out.append("A: " + p)
        return pd.Series(out, index=frame.index)
    return respond


def calls(folder):
    return Counter(line.strip() for f in os.listdir(folder) if f.startswith("calls-") for line in open(os.path.join(folder, f)))


def test_a_failed_run_goes_on_where_it_stopped(spark):
    folder, log = tempfile.mkdtemp(), os.path.join(tempfile.mkdtemp(), "log")
    df, fn = prompts(spark, 42), model(folder, dies_on="question 17")
    with pytest.raises(Exception):
        generate_logged(df, fn, log, per_task=2, per_wave=8)
    before = calls(folder)
    done = {r["response"][3:] for r in spark.read.parquet(*[os.path.join(log, b) for b in os.listdir(log)]).collect()} if os.path.exists(log) else set()
    out = {r["prompt_id"]: r for r in generate_logged(df, fn, log, per_task=2, per_wave=8).collect()}
    assert {k: r["response"] for k, r in out.items()} == {f"p{i}": f"A: question {i % 40}" for i in range(42)} and all(r["error"] is None for r in out.values())
    after = calls(folder)
    assert sum(before.values()) > 0 and done < set(after)
    # What the log holds was asked once; at most the wave at work was asked again.
    assert all(after[p] == 1 for p in done) and sum(after.values()) - 40 <= 8 + 8
    # All of it is logged now.
    generate_logged(df, fn, log).collect()
    assert calls(folder) == after


def test_logged_equals_plain_and_retries_failures(spark):
    folder, log = tempfile.mkdtemp(), os.path.join(tempfile.mkdtemp(), "log")
    df = prompts(spark, 12)
    fn = model(folder, fails_on="question 3")
    plain = sorted(map(tuple, generate(df, fn).collect()))
    assert sorted(map(tuple, generate_logged(df, fn, log, per_task=3, per_wave=4).collect())) == plain
    first = calls(folder)["question 3"]
    well = {r["prompt_id"]: r["response"] for r in generate_logged(df, model(folder), log).collect()}
    assert well["p3"] == "A: question 3" and calls(folder)["question 3"] == first + 1
    # Another system prompt is another prompt.
    generate_logged(prompts(spark, 12, "t"), model(folder), log).collect()
    assert calls(folder)["question 5"] == 3
    assert generate_logged(df.limit(0), fn, log).count() == 0 == generate_logged(df.limit(0), fn, log + "2").count()
