import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from shelfmark.llm.secrets import SPAN, _rendered, drop_live_secrets, free_of, running, scan_secrets

KEYWORD = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
PATTERNS = [re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def scan(docs, **options):
    return scan_secrets(docs, repo=F.col("lang"), owner=F.col("source"), keep=["doc_id", "text", "n_words"], **options)


def test_base_spans_match_brute_force(documents):
    rows = scan(documents).select("text", _rendered(F.col("base")).alias("spans")).collect()
    assert len(rows) == documents.count()
    assert any(r.spans for r in rows)
    for r in rows:
        assert r.spans == brute(r.text)


def test_owned_tokens_are_told_from_examples(spark):
    live, shared = "Zq8fLk2MnP4rTx9VbW7y", "Aa1Bb2Cc3Dd4Ee5Ff6Gg"
    rows = [(1, f"é {live} x", "s1"), (2, f"key {shared}", "s1"), (3, f"key {shared}", "s2"), (4, f"{shared} again", "s3"), (5, "EXAMPLEa1b2c3d4e5f6g7", "s1"), (6, "abcdefghijklmnopqrstuvwxyz", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_words": F.lit("x")})
    got = {r.doc_id: r.spans for r in scan(docs).select("doc_id", _rendered(F.col("owned")).alias("spans")).collect()}
    assert got == {1: "owned:2:22", 2: "", 3: "", 4: "", 5: "", 6: ""}


def test_a_hot_value_is_counted_whole(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("password=abcdefgh99").alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.lit("en").alias("lang"), F.lit("x").alias("n_words"))
    out = scan(docs)
    assert out.where("n_example = 1 and n_live = 0").count() == 3000


def test_repositories_of_one_owner_count_too(spark):
    rows = [(i, "password=copied4099" if i < 8 else "password=onlyhere77", "s", f"repo{i % 4}") for i in range(9)] + [(9, "nothing", "s", "repo0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_words", F.lit("x"))
    by_repo = {r.doc_id: r for r in scan(docs).collect()}
    assert [(by_repo[i].n_live, by_repo[i].n_example) for i in (0, 7, 8, 9)] == [(0, 1), (0, 1), (1, 0), (0, 0)]
    assert [(j.n_owners, j.n_repos, j.n_uses, j.live) for i in (0, 8) for j in by_repo[i].judged] == [(1, 4, 8, False), (1, 1, 1, True)] and by_repo[9].judged == []
    by_owner = {r.doc_id: r.n_live for r in scan(docs, example_repos=5).collect()}
    assert [by_owner[i] for i in range(10)] == [1] * 9 + [0]
    kept = drop_live_secrets(docs, repo=F.col("lang"), owner=F.col("source"))
    assert {r.doc_id for r in kept.collect()} == {*range(8), 9}


def test_many_candidates_in_one_text_take_no_longer_for_each(spark):
    text = "\n".join(f"{i:032x}" if i % 2 else f"password = Zq8fLk2MnP4rTx9Vb{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text, "en", "s", "x")], "doc_id long, text string, lang string, source string, n_words string")
    began = time.monotonic()
    row = scan(docs).select(_rendered(F.col("base")).alias("spans")).first()
    assert row.spans == brute(text)
    assert time.monotonic() - began < 60


def test_running_and_overlaps_match_brute_force(spark):
    rng = random.Random(4)
    sizes = [0, 1, 2, 3, 7, 8, 9, 100]
    rows = [([rng.randrange(9) for _ in range(n)],) for n in sizes]
    got = spark.createDataFrame(rows, "a array<int>").select("a", running(F.col("a"), lambda x, y: x + y).alias("s")).collect()
    assert all(r.s == list(itertools.accumulate(r.a)) for r in got)
    span = lambda rank: [(a, rank, a + rng.randrange(1, 6), "h", False) for a in rng.sample(range(60), rng.randrange(8))]
    rows = [(i, span(3), span(rng.randrange(3))) for i in range(300)]
    got = spark.createDataFrame(rows, f"i int, wide array<{SPAN}>, base array<{SPAN}>").select("i", free_of(F.col("wide"), F.col("base")).alias("free")).collect()
    for r in got:
        wide, base = rows[r.i][1:]
        assert sorted(tuple(x) for x in r.free) == sorted(o for o in wide if not any(b[0] < o[2] and o[0] < b[2] for b in base))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "password=hunter2hunter2", "en", "s", 5, 6, 7)], "base long, text string, lang string, source string, hex int, kept int, row_no int")
    out = scan_secrets(docs, repo=F.col("lang"), owner=F.col("source"), keep=["base", "hex", "kept", "row_no"])
    assert out.columns == ["base", "hex", "kept", "row_no", "base_", "owned", "n_live", "n_example", "judged"]
    assert out.select("base", "hex", "kept", "row_no", "n_live").first() == (1, 5, 6, 7, 1)


def test_filter_keeps_columns_and_clean_rows(documents):
    kept = drop_live_secrets(documents, repo=F.col("lang"), owner=F.col("source"))
    assert kept.dtypes == documents.dtypes
    gone = {r.doc_id for r in documents.exceptAll(kept).collect()}
    assert gone == {5, 6, 7}
    assert kept.where("doc_id = 3").count() == 3


def test_empty_table(documents):
    assert scan(documents.where("false")).count() == 0


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
