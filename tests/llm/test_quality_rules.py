import random
import re

from pyspark.sql import functions as F

from shelfmark.llm.quality_rules import FEATURES, Rule, decision, fit_rules, learn_rules, with_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(documents):
    rows = with_statistics(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
        assert all(r[f] is not None for f in FEATURES)


def test_columns_with_names_of_its_own_stay(spark):
    rows = with_statistics(spark.createDataFrame([("a\na\nb", 7, "x")], "text string, _lines int, _words string")).collect()
    assert rows[0]["_lines"] == 7 and rows[0]["_words"] == "x" and rows[0].n_dup_lines == 1 and rows[0].dup_line_share == 1 / 3


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n\t*\x0b") for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = with_statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text


def test_covering_finds_a_planted_conjunction(spark):
    rng = random.Random(1)
    rows = [{f: rng.random() for f in FEATURES} for _ in range(600)]
    bad = [r["symbol_share"] > 0.7 and r["upper_share"] > 0.5 or r["repeat_share"] > 0.9 for r in rows]
    rules = learn_rules(rows, bad)
    assert 2 <= len(rules) <= 6
    told = [any(rule.covers(r) for rule in rules) for r in rows]
    assert sum(a != b for a, b in zip(told, bad)) < 20
    df = spark.createDataFrame([tuple(r[f] for f in FEATURES) for r in rows], ", ".join(f"{f} double" for f in FEATURES))
    by_spark = [r.rule for r in df.select(decision(rules).alias("rule")).collect()]
    assert by_spark == [next((i for i, rule in enumerate(rules, 1) if rule.covers(r)), None) for r in rows]


def test_no_labels_no_rules(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rules(documents, none) == []
    assert documents.select(decision([]).alias("rule")).where("rule is not null").count() == 0
    assert learn_rules([], []) == []


def test_fit_on_labelled_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() + "***" * (i % 4 == 0) for _ in range(60)), int(i % 4 != 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = fit_rules(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    judged = with_statistics(docs).select("quality", decision(rules).isNotNull().alias("bad"))
    assert judged.where((F.col("quality") == 0) != F.col("bad")).count() <= 2


def test_rule_text():
    assert Rule((("n_words", "<=", 3.0),)).covers({"n_words": 2})
