import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch
from shelfmark.llm.jaccard_join import Bitmap, components, keep_one, link_documents
from shelfmark.llm.shingles import words_of


def shingle_words(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[find(i)])) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    while len(rows) < 420:
        words = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 80, 200]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages).split()
        for _ in range(rng.choice([1, 1, 1, 2, 5, 40])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), rng.choice([" ", "\n"]).join(own)))
            if rng.random() < 0.2:
                words = own  # chains of changes
    # Documents that are little but passages many share.
    rows += [(len(rows) + i, " ".join(rng.sample(passages, 3)) + " " + word()) for i in range(40)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(ids[i], t) for i, (_, t) in enumerate(rows)]
    return rows + [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, ""), rows[5], rows[6], (None, rows[7][1]), (None, "only me here")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"frequent_above": 2, "list_rows": 6, "block_rows": 3}), (3, {"frequent_above": 10**6, "block_rows": 1})])
def test_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in link_documents(docs, **options).collect())
    assert got == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert link_documents(docs).select("component_id").distinct().collect()[0][0] == 0
    assert [r.doc_id for r in keep_one(docs).collect()] == [0]


def test_keep_one_keeps_columns_and_lone_rows(documents):
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == set(range(14)) | {None}
    assert ids.count(3) == 1


def test_rows_without_words_or_ids_all_stay(spark):
    rows = [(1, ""), (1, ""), (2, None), (2, None), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "a b c")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", ""), ("1", ""), ("2", "None"), ("2", "None"), ("3", "a b c"), ("None", "a b c")]


def test_empty_table(documents):
    assert link_documents(documents.where("false")).count() == 0
    assert keep_one(documents.where("false")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_bitmap_holds_what_it_was_built_from(spark):
    ids = spark.range(0, 90_000, 3)
    bitmap = Bitmap(ids, "id")
    held = spark.range(90_000).where(bitmap.may_hold(F.col("id")))
    assert held.where("id % 3 = 0").count() == 30_000
    assert held.count() < 36_000


def test_bitmap_positions_are_the_same_outside_of_spark(spark):
    ids = [bytes([i] * 16) for i in range(200)]
    bitmap = Bitmap(spark.createDataFrame([(x,) for x in ids], "a binary"), "a")
    assert all(bitmap.held.value[(at := bitmap.position_of(x)) >> 3] >> (at & 7) & 1 for x in ids)


def test_sets_are_moved_once_to_a_part_and_in_rounds_where_pairs_are_many(spark, tmp_path):
    from shelfmark.llm import jaccard_join as j
    from shelfmark.llm.common import Scratch
    from shelfmark.llm.shingles import shingle_set, words_of

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(base) if rng.random() < 0.02 * (i % 5) else w for w in base) for i in range(14)]
    sets = {j._node(s): set(s.tolist()) for s in (shingle_set(words_of(t)) for t in texts)}
    nodes = sorted(sets)
    hub = nodes[0]
    star = spark.createDataFrame([(hub, n) for n in nodes[1:]], "a binary, b binary")
    assert j._groups(star, 256).select("part").distinct().count() == 1
    clique = [(x, y) for x in nodes for y in nodes if x < y]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for size in (1, 256):  # every pair a part of its own, in rounds; all of them one part
        scratch = Scratch(spark)
        got = j._compared(spark.createDataFrame(clique, "a binary, b binary"), docs, "text", 75, scratch, group_pairs=size).collect()
        want = {(x, y): len(sets[x] & sets[y]) for x, y in clique}
        assert {(bytes(r.a), bytes(r.b)): r.shared for r in got} == want and len(got) == len(clique)
        assert all(r.linked == (100 * r.shared >= 75 * len(sets[bytes(r.a)] | sets[bytes(r.b)])) for r in got)
        assert (len(scratch.paths) > 1) == (size == 1)


def test_the_driver_is_collected_after_each_table(spark):
    collectors = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(c for c in collectors if "Old" in c.getName() or "MarkSweep" in c.getName())
    before, scratch = full.getCollectionCount(), Scratch(spark)
    scratch.write(spark.range(3), "test-collected")
    assert full.getCollectionCount() > before
