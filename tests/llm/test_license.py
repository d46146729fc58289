import random
import re

from parlance.llm.license_scan import NOTICES, PHRASES, scan_licenses
from parlance.llm.license_scan import TEXTS as TEMPLATES

from .rows import TEXTS, documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w = words(t)
    places = sorted((i, label) for label, phrase, _ in PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))


def test_base_places_like_brute_force(spark):
    texts = TEXTS + [
        (20, "Released under the MIT License. under THE mit\nlicense"), (21, "CC-BY-NC cc by nc cc by, nc!"), (22, "apache license version 2.0 under the mit license"),
        (23, "under the m\u212at license"), (24, "under the mit \u0130 license"), (25, "cc by"), (26, "nc cc by nc by nc"), (20, "Released under the MIT License. under THE mit\nlicense"),
        (27, "x " * 3000 + "under the mit license " * 500), (28, "UNDER THE \u212aMIT LICENSE"),
    ]
    rows = scan_licenses(documents(spark, texts), "doc_id", "text").collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in rows)
    want = sorted((str(i), n, b, str(f), str(l), s) for i, t in texts for n, b, f, l, s in [base(t)])
    assert got == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_notices_with_changes(spark):
    mit = next(t for label, t, _ in NOTICES if label == "mit").split()
    changed = mit[:9] + ["really", "quite"] + mit[9:14] + mit[15:]
    texts = [(1, " ".join(mit)), (2, "intro " + " ".join(changed) + " end"), (3, " ".join(mit[:6])), (4, " ".join(reversed(mit))),
             (5, "Copyright x. " + " ".join(mit) + " filler " * 50 + " ".join(mit))]
    rows = {r["doc_id"]: r for r in scan_licenses(documents(spark, texts), "doc_id", "text").collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["score"] == 1 and rows[1]["n_base"] == 0 and rows[1]["base_labels"] == ""
    assert rows[2]["labels"] == "mit" and 0.6 <= rows[2]["score"] < 1 and rows[2]["spans"][0]["first"] == 1
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0 and rows[4]["labels"] == ""
    assert [s["first"] for s in rows[5]["spans"]] == [2, 2 + len(mit) + 50]


def brute_spans(t, templates, k=3, gap=3, coverage=0.6):
    """Verified spans of the templates that are not exact: votes by plain loops."""
    w, out = words(t), []
    for label, text, exact in templates:
        tw = text.split()
        grams = len(tw) - k + 1
        votes = {}
        for p in range(len(w) - k + 1):
            for q in range(grams):
                if w[p:p + k] == tw[q:q + k]:
                    votes.setdefault(p - q, set()).add(q)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= gap:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in () if exact else groups:
            score = len(set().union(*(votes[d] for d in g))) / grams
            if score >= coverage:
                out.append((min(d + min(votes[d]) for d in g), max(d + max(votes[d]) + k - 1 for d in g), label, score))
    return sorted(out)


def test_method_labels_like_brute_force(spark):
    rng = random.Random(3)
    every = NOTICES + TEMPLATES
    texts = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            ws = rng.choice(every)[1].split()
            ws = ws[rng.randrange(1 + len(ws) // 4):]
            for _ in range(rng.randrange(len(ws) // 6 + 1)):  # words lost, added and changed
                at = rng.randrange(len(ws))
                ws[at:at + rng.randrange(2)] = rng.choice([[], ["other"], ["the", "of"]])
            parts.append(" ".join(rng.choice([w, w.upper(), w + ","]) for w in ws))
        texts.append((i, (" filler " * rng.randrange(9)).join(parts)))
    rows = {r["doc_id"]: r for r in scan_licenses(documents(spark, texts), "doc_id", "text").collect()}
    some = 0
    for i, t in texts:
        want = brute_spans(t, PHRASES + every)
        got = sorted((s["first"], s["last"], s["label"], s["score"]) for s in rows[i]["spans"] if not s["exact"])
        assert got == want
        places = base(t)
        assert rows[i]["labels"] == ",".join(sorted({s[2] for s in want} | set(filter(None, places[4].split(",")))))
        assert rows[i]["score"] == (1 if places[1] else max((s[3] for s in want), default=0))
        some += len(want) > 0
    assert some > 20


def test_whole_license_is_one_span(spark):
    for label, text, _ in TEMPLATES:
        row = scan_licenses(documents(spark, [(1, "Copyright (c) 2020 Ann\n\n" + text.upper() + ".\nint main")]), "doc_id", "text").first()
        assert label in row["labels"].split(",") and row["score"] == 1
        assert any(s["first"] == 4 and s["last"] == 3 + len(text.split()) and s["score"] == 1 for s in row["spans"])


def test_native_plan(spark):
    plan = scan_licenses(documents(spark), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert scan_licenses(documents(spark, []), "doc_id", "text").count() == 0
