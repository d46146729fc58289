"""A deterministic stand-in for the language model, used by tests."""

import json
import re

import pandas as pd


def stub_model(pdf: pd.DataFrame) -> pd.Series:
    out = []
    for pid, prompt in zip(pdf["prompt_id"], pdf["prompt"]):
        kind = pid.split(":")[0]
        if kind == "pairs":
            idx = re.findall(r"<item (\d+)>", prompt)
            out.append(json.dumps({"summaries": [{"pair_index": int(i), "one_liner": f"line {i}"} for i in idx]}))
        elif kind == "flag":
            out.append('```json\n{"flagged": [{"start": 0, "end": 1}, {"start": "x", "end": 2}]}\n```')
        elif kind == "expand":
            out.append("  Detailed notes.  ")
        elif kind == "propose":
            out.append('{"summary": "New summary", "key_facts": ["fact"], "tags": ["tag"]}')
        elif kind == "label":
            out.append('<think>hmm</think>{"categories": ["english", "nope"], "tags": ["t"], "summary": "s", '
                       '"key_facts": ["k"], "relevance_score": 1.4}')
        elif kind == "explore":
            out.append('{"suggestions": [{"slug": "topic-a", "name": "Topic A", "description": "d", "sample_titles": ["t"]}]}')
        else:
            out.append(f"answer for {pid}")
    return pd.Series(out)


CALLS: list = []


def flaky_label_model(pdf: pd.DataFrame) -> pd.Series:
    """Label stand-in that fails (raises) for every 10th conversation id."""
    out = []
    for pid in pdf["prompt_id"]:
        cid = int(pid.split(":")[1])
        if cid % 10 == 3:
            raise RuntimeError(f"timeout {pid}")
        out.append(json.dumps({"categories": ["english"], "tags": [f"t{cid}"], "summary": f"s{cid}",
                               "key_facts": [], "relevance_score": (cid % 10) / 10}))
    return pd.Series(out)


def good_label_model(pdf: pd.DataFrame) -> pd.Series:
    out = []
    for pid in pdf["prompt_id"]:
        cid = int(pid.split(":")[1])
        out.append(json.dumps({"categories": ["english"], "tags": [f"t{cid}"], "summary": f"s{cid}",
                               "key_facts": [], "relevance_score": (cid % 10) / 10}))
    return pd.Series(out)
