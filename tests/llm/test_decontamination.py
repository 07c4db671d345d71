import math
import random

import pytest

from shelfmark.llm.decontamination import ItemIndex, blocks, drop_leaks, find_leaks
from shelfmark.llm.shingles import words_of


def brute(doc, item):
    d, i = words_of(doc), words_of(item)
    width = min(5, len(i))
    own = {tuple(i[k : k + width]) for k in range(len(i) - width + 1)} if i else set()
    all_ = {tuple(d[k : k + width]) for k in range(len(d) - width + 1)}
    return (len(own & all_), len(own)) if own and 100 * len(own & all_) >= 75 * len(own) else None


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 60])))) for i in range(60)] + [(60, None), (61, " "), (0, "twice the Same item here ok")]
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.choice([0, 3, 40, 400, 3000]))]
        if i % 2:
            own = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "CHANGED"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, ("\n" if i % 3 else "  ").join(words).upper() if i % 5 == 0 else " ".join(words)))
    return docs + [(3, docs[3][1]), (None, docs[5][1]), (7, None)], items


@pytest.mark.parametrize("most_bytes", [10**7, 300])
def test_matches_brute_force(spark, corpus, most_bytes):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(a), b, *m) for a, x in docs for b, y in items if (m := brute(x, y)))
    rows = find_leaks(d, t, most_bytes=most_bytes).collect()
    assert sorted((str(r.doc_id), r.item_id, r.shared, r.item_shingles) for r in rows) == want
    assert len(want) > 50
    kept = drop_leaks(d, t, most_bytes=most_bytes).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(a) for a, x in docs if not any(brute(x, y) for _, y in items))


def test_sketches_are_the_smallest_hashes():
    index = ItemIndex([(1, " ".join(map(str, range(44))))], 0.75)
    assert len(index.parts[0].values) == 40 - math.ceil(30) + 1


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("d", "alpha beta gamma"), ("e", "no")], "doc_id string, text string")
    for kind, value in (("int", 7), ("string", "x"), ("smallint", 3)):
        items = spark.createDataFrame([(value, "alpha beta")], f"item_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()] == [("d", value)]


def test_blocks_are_bounded(spark):
    t = spark.createDataFrame([(i, "x" * 40) for i in range(10)], "item_id long, text string")
    assert [len(b) for b in blocks(t, "item_id", "text", 100)] == [2] * 5


def test_empty_tables_and_clashing_names(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents, none).count() == 0
    assert drop_leaks(documents, none).count() == documents.count()
    one = spark.createDataFrame([(1, "alpha beta", 3)], "doc_id long, text string, lang int")
    assert find_leaks(documents, one, item_col="doc_id").columns == ["doc_id", "doc_id_item", "shared", "item_shingles", "containment"]
    assert find_leaks(documents.where("false"), one, item_col="doc_id").count() == 0
    assert drop_leaks(documents, one).columns == documents.columns
