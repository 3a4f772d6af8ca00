"""URL rules against a plain reading, and the language models."""

import math
import random
import re

import numpy as np

from quinhao.llm import url_filter as uf
from quinhao.llm.queries import URL_RULES

HOSTS = ["a.org", "example.org", "x.example.org", "b.com", "badexample.org", "ORG", "a.net", "É.Org",
         "a.org:80", "com", "x.com.", ""]
PATHS = ["", "/", "/fr/1", "/de/2", "/es/3", "/en/1", "/en/12", "/en/2", "/fr", "/es/"]
TAILS = ["", "?q=http://b.com/de/", "#top", "?a/b#c"]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), verdict, rule))
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    rows = [(k, u, "own host", 1.5) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, host string, score double")


def test_hosts_paths_and_rules(spark):
    urls = [f"http{s}://{h}{p}{t}" for s in ("", "s") for h in HOSTS for p in PATHS for t in TAILS]
    urls += [None, "", "no scheme/", "x\n://a.org/\n1", "://", "://a.org/", "a://b://c.org/fr/", "HTTP://A.ORG/X"]
    urls += urls[:50]
    got = uf.judge_urls(pages(spark, urls), URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = plain(urls[r.page_id])
        verdict, rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_learns_what_rules_accept(spark):
    rnd = random.Random(1)
    urls, want = [], {}
    for k in range(3000):
        good = rnd.random() < 0.5
        name = rnd.choice(["news", "school", "museum"] if good else ["casino", "bets", "xxl"])
        path = f"/{name}/{rnd.randrange(1000)}"
        if rnd.random() < 0.7:
            urls.append(f"http://{'a.org' if good else 'b.com/de'}{path}")
        else:
            urls.append(f"http://site{rnd.randrange(50)}.net{path}")
            want[k] = "allow" if good else "block"
    got = uf.judge_urls(pages(spark, urls), URL_RULES).collect()
    right = [r.verdict == want[r.page_id] for r in got if r.page_id in want]
    assert len(right) > 500 and np.mean(right) > 0.95


def test_ratio_equals_plain_markov_models(spark):
    """Against counts in dictionaries."""
    rnd = random.Random(2)
    rows = [(f"{rnd.choice(['ab', 'ba'])}{'x' * rnd.randrange(4)}é{k % 9}", k % 3 == 0) for k in range(200)]
    counts = uf.count_grams(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3))
    seen = [{}, {}]
    for url, accepted in rows:
        data = b"\0" * 5 + url.encode()
        for at in range(5, len(data)):
            for order in range(uf.ORDERS):
                context = data[at - order : at]
                own = seen[accepted]
                own[context, order] = own.get((context, order), 0) + 1
                own[context, order, data[at]] = own.get((context, order, data[at]), 0) + 1

    def log(own, url):
        total, data = 0.0, b"\0" * 5 + url.encode()
        for at in range(5, len(data)):
            p = 1 / 256
            for order in range(uf.ORDERS):
                context = data[at - order : at]
                n, hits = own.get((context, order), 0), own.get((context, order, data[at]), 0)
                p = (hits + uf.LEAN * p) / (n + uf.LEAN)
            total += math.log(p)
        return total

    urls = ["abx", "baxé1", "zzz", "", "é", None, "abx", "ab" * 50_000]
    rows = spark.createDataFrame(list(enumerate(urls)), "k bigint, url string").repartition(2)
    got = {r.k: r.score for r in uf.with_scores(rows, counts, "k").collect()}
    texts = [u or "" for u in urls]
    want = [(log(seen[1], u) - log(seen[0], u)) / max(1, len(u.encode())) for u in texts]
    assert np.allclose([got[k] for k in range(len(urls))], want, atol=1e-9)


def test_counts_are_exact_however_many_strings(spark):
    """No two strings share a counter: a large corpus of other URLs changes nothing for these."""
    rnd = random.Random(4)
    rows = [("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789/") for _ in range(40)), k % 2 == 0)
            for k in range(8000)]
    counts = uf.count_grams(spark.createDataFrame(rows, "url string, accepted boolean"))
    want = {}
    for url, accepted in rows:
        data = b"\0" * 5 + url.encode()
        for at in range(5, len(data)):
            key = int.from_bytes(data[at - 5 : at + 1], "big"), accepted
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in counts.collect():
        got |= {(r.gram, False): r.n_0} if r.n_0 else {}
        got |= {(r.gram, True): r.n_1} if r.n_1 else {}
    assert got == want and len(want) > 250_000


def test_verdicts_stay_when_the_labelled_set_grows_tenfold(spark):
    """The same URLs ten times over: same shares, so the models' contexts weigh alike."""
    rnd = random.Random(6)
    labelled = [
        f"http://{'a.org' if good else 'b.com/de'}/{rnd.choice(['news', 'art'] if good else ['bet', 'xxl'])}"
        f"/{rnd.randrange(100)}"
        for good in [rnd.random() < 0.5 for _ in range(1500)]
    ]
    others = [f"http://s{k}.net/{w}/{k}" for k in range(60) for w in ("news", "art", "bet", "xxl")]

    def verdicts(times):
        got = uf.judge_urls(pages(spark, others + labelled * times), URL_RULES).collect()
        return [r.verdict for r in sorted(got, key=lambda r: r.page_id)[: len(others)]]

    once = verdicts(1)
    assert set(once) == {"allow", "block"} and verdicts(10) == once


def test_odd_rows(spark):
    """Clashing columns, repeated rows, ties, very long URLs and missing ids."""
    urls = [None, "", "x", "http://a.org/" + "y" * 300_000, "http://q.net/1", "http://q.net/1",
            "http://b.com/de/1", "http://a.org/1"]
    rows = [(None if k == 4 else k // 2, u, "own", "own", "own") for k, u in enumerate(urls)]
    df = spark.createDataFrame(
        rows, "page_id bigint, url string, verdict string, _held string, gram string"
    )
    df = df.union(df)
    got = uf.judge_urls(df, URL_RULES).collect()
    assert sorted((r.page_id, r.host, r.path) for r in got if r.page_id is not None) == sorted(
        (r[0], *plain(r[1])) for r in rows * 2 if r[0] is not None
    )
    assert sum(r.page_id is None for r in got) == 2
    scores = {}
    for r in got:
        scores.setdefault((r.host, r.path), set()).add((r.verdict, r.score))
    assert all(len(s) == 1 for key, s in scores.items() if key[0])


def test_threshold_is_the_best_on_the_grid(spark):
    rnd = random.Random(3)
    rows = [(rnd.gauss(0.5 if k % 3 else -0.5, 0.6), bool(k % 3)) for k in range(400)]
    rows += [(99.0, True), (-99.0, False)]
    t = uf.calibrate(spark.createDataFrame(rows, "score double, accepted boolean"))

    def balanced(t):
        good, bad = ([s >= t for s, a in rows if a == want] for want in (True, False))
        return np.mean(good) + 1 - np.mean(bad)

    assert balanced(t) >= max(balanced(k / 100) for k in range(-300, 300)) - 1e-9


def test_no_labels_null_urls_and_empty(spark):
    got = uf.judge_urls(pages(spark, ["http://a.net/1", None, ""]), URL_RULES).collect()
    assert {(r.verdict, r.score) for r in got} == {("allow", 0.0)}
    assert uf.judge_urls(pages(spark, ["x"]).where("false"), URL_RULES).count() == 0
