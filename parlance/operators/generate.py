"""The model step (X1) and the shared response parsing around it.

The language model is a user function over a batch of prompts:
``fn(prompts: pandas.DataFrame) -> pandas.Series`` of response strings.
It runs inside ``mapInPandas`` (Arrow batches on the executors), so
parallelism equals the number of prompt partitions and no prompt passes
through the driver. One failing prompt never fails the job: when a batch
raises, its rows are retried one by one and the exception text is kept
in ``error``.

A task that Spark runs again (a lost executor, speculation) asks for all its
prompts again. ``generate_logged`` bounds that and lets a failed run be
resumed: finished prompts are kept in a response log and are not asked twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.json import extract_json
from parlance.functions.text import php_trim, strip_boilerplate

RESPONSE_SCHEMA = "prompt_id string, response string, error string"
#: Prompts of a task, and of a wave, of a logged model step.
PER_TASK, PER_WAVE = 32, 10_000


def generate(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series],
             columns: tuple[str, ...] = ("prompt_id", "system", "prompt")) -> DataFrame:
    """responses(prompt_id, response, error) for every prompt row."""
    cols = list(dict.fromkeys(["prompt_id", *columns]))

    def run(batches):
        for pdf in batches:
            try:
                out = pd.Series(fn(pdf), index=pdf.index).astype(object)
                err = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            except Exception:  # noqa: BLE001 - retry row by row to isolate failures
                vals, errs = [], []
                for i in range(len(pdf)):
                    try:
                        vals.append(pd.Series(fn(pdf.iloc[[i]])).iloc[0])
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001
                        vals.append(None)
                        errs.append(f"{type(e).__name__}: {e}")
                out = pd.Series(vals, index=pdf.index, dtype=object)
                err = pd.Series(errs, index=pdf.index, dtype=object)
            yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "response": out, "error": err})

    return prompts.select(*cols).mapInPandas(run, RESPONSE_SCHEMA)


def generate_logged(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], log_path: str,
                    per_task: int = PER_TASK, per_wave: int = PER_WAVE) -> DataFrame:
    """X1 with a response log: responses(prompt_id, response, error) as
    ``generate`` gives them.

    The log is keyed by the hash of (system, prompt). Prompts it holds are
    answered from it; of the others each distinct one is asked once, in waves
    of about ``per_wave``, and a wave's responses are appended before the
    next begins. So a run that fails loses the wave at work alone, and one
    that is started again goes on from there; a task that fails asks again
    for its own ``per_task`` prompts or so. Failed prompts are not logged:
    the next run retries them."""
    from parlance.plans.materialize import materialize
    from parlance.sources.tables import KeyedTable

    log = KeyedTable(prompts.sparkSession, log_path, "prompt_key")
    key = F.sha2(F.concat_ws("\u0000", F.coalesce("system", F.lit("")), F.coalesce("prompt", F.lit(""))).cast("binary"), 256)
    keyed = materialize(prompts.select("prompt_id", "system", "prompt", key.alias("prompt_key")), "keyed-prompts")
    todo = keyed.dropDuplicates(["prompt_key"])
    have = log.read()
    if have is not None:
        todo = todo.join(have.select("prompt_key"), "prompt_key", "left_anti")
    todo = materialize(todo.select(F.col("prompt_key").alias("prompt_id"), "system", "prompt"), "open-prompts")
    n, failed = todo.count(), []
    waves = -(-n // per_wave)
    for wave in range(waves):
        part = todo.where(F.pmod(F.xxhash64("prompt_id"), F.lit(waves)) == wave).repartition(max(1, -(-n // (waves * per_task))), "prompt_id")
        got = materialize(generate(part, fn), "wave").withColumnRenamed("prompt_id", "prompt_key")
        log.upsert(got.where("error IS NULL"))
        failed.append(got.where("error IS NOT NULL"))
    answers = reduce(DataFrame.unionByName, [a for a in [log.read(), *failed] if a is not None], prompts.sparkSession.createDataFrame([], "prompt_key string, response string, error string"))
    return keyed.join(answers, "prompt_key", "left").select("prompt_id", "response", "error")


def parsed_json(response) -> F.Column:
    """F12 -> F13 -> F14: boilerplate stripped, first object extracted and
    parsed; NULL when any step fails (the reference throws)."""
    return F.try_parse_json(extract_json(strip_boilerplate(response)))


def cleaned_text(response) -> F.Column:
    """Plain-text response: boilerplate stripped and trimmed."""
    return php_trim(strip_boilerplate(response))


def join_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach responses to their prompts; a missing response is an error."""
    r = responses.select("prompt_id", "response", F.col("error").alias("_err"))
    j = prompts.join(r, "prompt_id", "left")
    err = F.when(F.col("response").isNull() & F.col("_err").isNull(), F.lit("no response")).otherwise(F.col("_err"))
    return j.withColumn("error", err).drop("_err")
