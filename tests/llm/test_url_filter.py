import random

import pandas as pd
from pyspark.sql import functions as F

from shelfmark.llm.url_filter import CLASSES, RULES, filter_urls, learn_templates, merge_branches, shape_of

URLS = [None, "", "nohost", "http://", "HTTP://EX.Org", "http://a.ORG/", "http://example.org/es/x", "http://www.example.org/es/", "http://notexample.org/es/1", "http://example.org/en/12?x#y", "http://example.org/en/21", "http://org/", "http://com/fr/1", "https://x.com/de/9#z", "http://x.com?/de/", "http://x.com#://y.org/", "ftp://u:p@x.com:80/de/a b", "http://x.net/a/b/c/d/e/f/g/h/i/j/k", "a://b\n://c.org/x", "http://é.com/fr/é"]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None)))


def test_rules_match_brute_force(spark):
    rng = random.Random(1)
    urls = URLS + ["".join(rng.choice(["http://", "/", "?", "#", "org", ".", "example", "com", "es", "fr", "de", "en/1", "A"]) for _ in range(rng.randrange(9))) for _ in range(500)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, url_verdict int").repartition(3)
    out = filter_urls(pages, rules=RULES)
    assert out.columns == [*pages.columns, "url_verdict_"]
    rows = out.collect()
    assert len(rows) == len(urls)
    for r in rows:
        v = r.url_verdict_
        host, path, rule, verdict = brute(r.url)
        assert (v.host, v.path, v.rule) == (host, path, rule), r.url
        assert v.verdict == (verdict or ("block" if v.purity >= 0.7 else "allow"))


def test_variable_segments_become_wildcards_and_like_branches_merge(spark):
    rows = [("h.net", f"/item/name{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}", None) for i in range(300)]
    rows += [("h.net", f"/{lang}/{i}", 0) for lang in ("en", "fr") for i in range(60)] + [("h.net", f"/spam/{i}", 1) for i in range(60)]
    urls = spark.createDataFrame(rows, "host string, path string, label int")
    got = {r.template: r for r in learn_templates(urls).collect()}
    assert set(got) == {"/item/*/{num}", "/{en|fr}/{num}", "/spam/{num}"}
    assert got["/spam/{num}"].purity > 0.9 and got["/{en|fr}/{num}"].purity < 0.1 < got["/item/*/{num}"].purity < 0.9


def test_rare_segments_with_a_block_rate_of_their_own_stay_out_of_the_wildcard(spark):
    rows = [("h.net", f"/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/{k}", 0) for i in range(150) for k in range(12)]
    rows += [("h.net", f"/u/bad{c}/{k}", 1 if k < 10 else None) for c in "xyz" for k in range(20)]
    rows += [("h.net", f"/u/few{c}/{k}", 1) for c in "xyz" for k in range(2)]
    urls = spark.createDataFrame(rows, "host string, path string, label int")
    got = {r.template: r for r in learn_templates(urls).collect()}
    assert set(got) == {"/u/*/{num}", "/u/badx/{num}", "/u/bady/{num}", "/u/badz/{num}"}
    assert got["/u/*/{num}"].purity < 0.1 and all(got[f"/u/bad{c}/{{num}}"].purity > 0.7 for c in "xyz")


def test_learned_templates_decide_where_no_rule_fits(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 3 == 0 else 'good'}/{i}", (1 if i % 3 == 0 else 0) if i % 2 else None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    out = filter_urls(pages, label=F.col("label")).select("page_id", "url_verdict.verdict").collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in out)


def test_hosts_without_labels_are_judged_by_what_their_paths_mean_elsewhere(spark):
    rows = [(f"h{k}.org", f"/{lang}/{i}", int(lang == "es")) for k in range(4) for lang in ("es", "en", "fr") for i in range(10)]
    rows += [("new.net", f"/{lang}/{i}", None) for lang in ("es", "en", "xx") for i in range(5)]
    urls = spark.createDataFrame(rows, "host string, path string, label int")
    got = {(r.host, r.shape): r.purity for r in learn_templates(urls).collect()}
    assert got["new.net", "/es/{num}"] > 0.7 > 0.3 > got["new.net", "/en/{num}"]
    assert 0.1 < got["new.net", "/xx/{num}"] < 0.7


def test_shapes_and_odd_urls(spark):
    paths = ["/a/some-long_slug-here.html", "/" + "x" * 40, "/2024/05/06/x", "/deadbeef-0123-4567-89ab/", "/short-one/7", "/" + "a/" * 5000, ""]
    got = [r.s for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(shape_of(F.col("p")).alias("s")).collect()]
    assert got == ["/a/{slug}", "/{slug}", "/{date}/x", "/{hex}/", "/short-one/{num}", paths[5], ""]
    pages = spark.createDataFrame([(i, "http://h.org" + paths[i % len(paths)], i) for i in range(70)], "page_id long, url string, salt int")
    out = filter_urls(pages, rules=RULES)
    assert out.count() == 70 and out.columns == ["page_id", "url", "salt", "url_verdict"]


def test_merging_needs_like_rates_and_like_children():
    row = lambda s, labelled, blocked, **kinds: {"segment": s, "n": 100, "labelled": labelled, "blocked": blocked, "hoped": 50.0, **dict.fromkeys(CLASSES, 0), **kinds}
    frame = pd.DataFrame([row("a", 50, 0, number=100), row("b", 50, 1, number=100), row("c", 50, 50, number=100), row("d", 50, 0, file=100), row("e", 0, 0, number=100)])
    assert dict(merge_branches(frame).values) == {"a": "{a|b}", "b": "{a|b}", "c": "c", "d": "d", "e": "e"}


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules=RULES).count() == 0
