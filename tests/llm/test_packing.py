import random
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfmark.llm.packing import Encoder, HarmonicPacker, pack_documents


def check(pieces, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, text in texts.items():
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        got, at = [], 0
        for p in sorted(docs[doc], key=lambda p: p.start):
            assert p.start == at and p.length == len(p.token_bytes) // 4 > 0 and p.doc_tokens == len(want)
            got += np.frombuffer(p.token_bytes, "<u4").tolist()
            at += p.length
        assert got == want
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_round_trip_and_padding(spark, documents):
    unique = documents.where("doc_id != 3 and doc_id is not null")
    texts = {r.doc_id: r.text for r in unique.collect()}
    for capacity in (64, 2048):
        assert check(pack_documents(unique, capacity=capacity).collect(), texts, capacity) == 0


def plain(texts):
    """The ids that the vocabulary's own library gives."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def ids(texts, **options):
    encode = Encoder("byte_bpe_50k.json", **options)
    return [np.frombuffer(x, "<u4").tolist() for _ in range(2) for x in encode(texts)][len(texts) :]


def test_special_tokens_in_a_text(spark):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>", 3: "<|endoftext|", 4: " <|ENDOFTEXT|>\n<|endoftext|>\n"}
    assert check(pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts, 2048) == 0
    assert ids(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_ids_are_those_of_the_library_over_a_whole_table():
    texts = [t or "" for t in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").df()["text"]]
    want = plain(texts)
    assert ids(texts) == want
    assert ids(texts, most=100, longest=5) == want


def test_ids_of_odd_texts():
    rng = random.Random(3)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "\t " * 50_000, "word " * 100_000, "a" * 20_000, "", " ", "it's  we'll 'S"]
    texts += ["".join(points[i : i + 5000]) for i in range(0, len(points), 5000)]
    texts += ["".join(rng.choice([*blanks, "a", "7", "é", "'", "'ll", "!", " "]) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += [bytes(rng.randrange(256) for _ in range(500)).decode("latin-1") for _ in range(200)]
    texts += [bytes(rng.randrange(256) for _ in range(500)).decode("utf-8", "replace") for _ in range(200)]
    assert ids(texts) == plain(texts)


def test_the_vocabulary_is_merged_by_rank_and_remembers_nothing():
    encode = Encoder("byte_bpe_50k.json")
    texts = ["Some  words\n\n and 'll 12a", "x" + " " * 300_000 + "y", "ab" * 100_000, "日本" * 30_000]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == plain(texts)
    assert encode.ranked and not encode.known
    assert ids(texts, by_rank=False) == ids(texts, by_rank=False, most=3, longest=2) == plain(texts)


def test_ids_that_are_no_ranks_are_encoded_by_pieces():
    import json

    from shelfmark.llm.packing import _ranked

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    assert _ranked(model)
    assert not _ranked(model | {"merges": [*model["merges"][1:], model["merges"][0]]})
    assert not _ranked(model | {"ignore_merges": True})


def test_other_vocabularies_are_encoded_whole():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some  Words here", " and\nmore "]
    encode = Encoder("word_bpe_49k.json")
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_clashing_names(spark):
    out = pack_documents(spark.createDataFrame([(7, "a b"), (8, None)], "start long, text string"), id_col="start")
    assert out.columns == ["start", "start_", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"]
    assert {(r.start, r.doc_tokens) for r in out.collect()} == {(7, 3), (8, 1)}


def test_repeated_and_null_ids_are_packed_once_each(documents):
    rows = pack_documents(documents).collect()
    assert sum(r.doc_id == 3 and r.start == 0 for r in rows) == 3
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 1


def test_empty_table(documents):
    out = pack_documents(documents.where("doc_id < 0"))
    assert out.columns == ["doc_id", "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"]
    assert out.count() == 0


def test_classes_hold_a_fixed_count_of_documents():
    packer = HarmonicPacker(100, 8)
    for doc, size in enumerate([40, 45, 60, 30, 5, 3, 7, 33, 28, 90, 4, 4, 2]):
        packer.add(doc, np.arange(size, dtype="<u4"))
    done = packer.take()
    assert all(sum(len(p[2]) for p in s) == 100 for s in done)
    assert {0, 1} <= {p[0] for p in done[0]}  # 40 and 45 share the class of two
    packer.flush()
    done += packer.take()
    assert sum(len(p[2]) for s in done for p in s) == 351
    assert all((n := sum(len(p[2]) for p in s)) == 100 or n & (n - 1) == 0 for s in done)
