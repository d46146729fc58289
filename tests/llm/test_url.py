import math
import random
import re
from collections import Counter

from parlance.llm.queries import URL_RULES
from parlance.llm.url_filter import ALPHABET, BEGIN, END, gram_scores, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule(host, path):
    fits = [(len(h + p), h + p, d) for h, p, d in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, "h", "p", 0.5, "t") for i, u in enumerate(urls)], "page_id bigint, url string, n int, host string, path string, score double, text string")


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://Ex.ORG", "http://ex.org/", "http://ex.org?q=/x", "http://a.example.org/es/1", "http://example.org/en/15#x",
            "http://a.com/fr/x://y", "http://xcom/fr/", "http://com/fr/", "http://Ä.COM/de/Ä?x", "http://a.com/FR/", "http://notexample.org/es/", "a\nb://h\n/p\n?", "http://ex.net/fr/1"] * 3
    rows = sorted(judge_urls(pages(spark, urls), "page_id", "url", URL_RULES).collect(), key=lambda r: r["page_id"])
    assert len(rows) == len(urls)
    for u, r in zip(urls, rows, strict=True):
        host, path = split(u)
        name, decision = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name), u
        assert r["verdict"] == decision if decision else r["verdict"] in ("allow", "block")


def test_ratio_like_brute_force(spark):
    rng = random.Random(4)
    order = 2
    grams = [("".join(rng.choice("ab" + BEGIN) for _ in range(order)) + rng.choice("abc" + END), rng.random() < 0.5) for _ in range(120)]
    counts = {g: {True: Counter(), False: Counter()} for g in (0, 1, 2)}
    for text, good in grams:
        for k in range(order + 1):
            counts[k][good][text[order - k:]] += 1

    def p(gram, good):
        value = 1 / ALPHABET
        for k in range(order + 1):
            hc = gram[order - k:]
            same = {s: n for s, n in counts[k][good].items() if s[:-1] == hc[:-1]}
            total, kinds = sum(same.values()), len(same)
            if total:
                value = (same.get(hc, 0) + kinds * value) / (total + kinds)
        return value

    asked = sorted({g for g, _ in grams} | {"zzz", "abz", BEGIN * 2 + "b"})
    training = spark.createDataFrame([(g, good, 1) for g, good in grams], "gram string, good boolean, n bigint")
    got = {r["gram"]: r["ratio"] for r in gram_scores(training, spark.createDataFrame([(g,) for g in asked], "gram string"), order).collect()}
    assert got.keys() == set(asked)
    for g in asked:
        assert math.isclose(got[g], math.log(p(g, True)) - math.log(p(g, False)), abs_tol=1e-9)


def test_models_tell_hosts_apart(spark):
    good = [f"http://news{i % 9}.example.org/fr/{i}" for i in range(60)]
    bad = [f"http://casino{i % 9}.example.org/es/{i}" for i in range(60)]
    rows = judge_urls(pages(spark, [*good, *bad, "http://news3.example.net/fr/7", "http://casino4.example.net/es/9"]), "page_id", "url", URL_RULES).collect()
    by = {r["page_id"]: r for r in rows}
    assert by[120]["verdict"] == "allow" and by[121]["verdict"] == "block" and by[120]["score"] > 0 > by[121]["score"]


def test_empty_and_one_sided(spark):
    assert judge_urls(pages(spark, []), "page_id", "url", URL_RULES).count() == 0
    rows = judge_urls(pages(spark, ["http://a.net/", None]), "page_id", "url", URL_RULES).collect()
    assert {(r["verdict"], r["score"]) for r in rows} == {("allow", 0.0)}
