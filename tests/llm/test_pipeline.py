import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import common, jaccard_join, queries
from shelfmark.llm.decontamination import ItemIndex

TOXIC = ["vilefoo", "grubble", "zonkhead"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables with toxic documents, near copies, leaks, live and copied secrets, nulls and repeated rows."""
    rng = random.Random(11)
    syllables = "an er th in ou re st ha ti on".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(5)]
    docs, labels = [], []
    for i in range(500):
        words = prose(rng.randint(80, 200))
        if i % 6 == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(TOXIC)
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, " ".join(words), "en", f"src{i % 5}", 0))
    clean = [d for d in docs if d[0] % 6]
    extra = []
    for k, d in enumerate(clean[:30]):
        words = d[1].split()
        words[3] = f"changed{k}"
        extra.append((1000 + k, " ".join(words), "en", "src1", 0))
    extra += [(2000 + k, f"{' '.join(prose(50))} {items[k % 5]} {' '.join(prose(50))}", "en", "src2", 0) for k in range(10)]
    extra += [(3000 + k, " ".join([*prose(60), f"password=Zq8fLk2MnP4r{k}", *prose(20)]), "en", "src3", 0) for k in range(8)]
    extra += [(4000 + k, " ".join([*prose(60), "password=SharedExample99", *prose(20)]), "en", f"src{k % 5}", 0) for k in range(10)]
    extra += [(5000, None, "en", "src1", 0), (5001, "", None, None, None), (5002, "short", "en", "src1", 0), (5003, clean[0][1], "en", "src4", 0), docs[1]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """Ids and texts after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.dtypes == docs.dtypes, name
        after.write.parquet(f"{sf_dir}/after-{name}.parquet")
        docs = spark.read.parquet(f"{sf_dir}/after-{name}.parquet")
        out.append(docs.collect())
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(kept):
    gone = ids(kept[0]) - ids(kept[1])
    toxic = {i for i in range(0, 500, 6)}
    assert len(gone & toxic) > 0.9 * len(toxic)
    assert len(gone - toxic) < 0.03 * len(kept[0])


def test_one_of_each_group_stays(kept):
    before, after = ids(kept[1]), ids(kept[2])
    for k in range(30):
        original = [i for i in range(500) if i % 6][k]
        if {original, 1000 + k} <= before:
            assert original in after and 1000 + k not in after
    assert {5000, 5001, 5002} & before <= after and 5003 not in after
    lone = {i for i in before if 2000 <= i < 5000}
    assert lone <= after


def test_leaks_go_and_nothing_else(spark, kept, sf_dir):
    index = ItemIndex([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], 0.75)
    want = {r.doc_id for r in kept[2] if not index.matches(r.text)}
    assert ids(kept[3]) == want and not want & set(range(2000, 2010))


def test_live_secrets_go_and_copied_examples_stay(kept):
    before, after = ids(kept[3]), ids(kept[4])
    assert before - after == before & set(range(3000, 3008))


def test_run_packs_every_token_of_what_was_kept(spark, sf_dir, kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in kept[-1]}
    got: dict = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.token_bytes, "<u4").tolist()
    assert {d: [t for s in sorted(p) for t in p[s]] for d, p in got.items()} == want


def test_every_query_takes_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_secret_scan", "op5_compression_toxicity", "op6_attention_quality", "op8_pii_deobfuscation", "op9_jaccard_join", "op10_quality_rules"):
        assert queries.queries()[name](spark, sf_dir).count() == n, name
    rows = queries.queries()["op5_compression_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    packed = queries.queries()["op1_harmonic_packing"](spark, sf_dir)
    assert packed.groupBy("doc_id", "start").count().where("count > 1").select("doc_id").distinct().count() == 1  # the repeated row
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_names_and_sql():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def collections(spark):
    return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_tasks_collect_the_heap_they_run_in(spark):
    """A task for each executor collects; here, tasks run in the driver's own process."""
    before = collections(spark)
    common.collect_executors(spark, 2)
    assert collections(spark) > before


def test_executors_are_collected_before_each_stage_and_in_the_join(spark, sf_dir, monkeypatch):
    """What one stage left in the heaps once took the next one, which needs little, beyond an executor's memory."""
    class Reached(Exception):
        pass

    def reached(*_):
        raise Reached

    monkeypatch.setattr(corpus_pipeline, "collect_executors", reached)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Reached):
            stage(spark, docs, sf_dir)
    calls = []
    monkeypatch.setattr(jaccard_join, "collect_executors", calls.append)
    assert jaccard_join.link_documents(docs).count() == docs.count()
    assert len(calls) >= 3  # after the counts, the index and each comparison
