"""Sharding, tokens, packing, the quality classifier and nearest neighbours."""
import functools
import random
import zlib

import numpy as np
import pytest

from scholargraph.llm import bpe, quality
from scholargraph.llm.neighbours import nearest
from scholargraph.llm.packing import Plan, cut, pack_documents, place_pieces, sequences, tokenised_pieces
from scholargraph.llm.sharding import shard_by_bytes
from tests.llm.fixtures import documents, odd_texts, prose

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PACK = dict(ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, special={"<|endoftext|>": 50256}, end_id=2)


def test_shards_are_contiguous_balanced_and_whole(spark):
    texts = odd_texts() + [(100 + i, prose(i, 20 + i)) for i in range(80)] + [(300 + i, "copy of a hot text") for i in range(60)]
    rows = shard_by_bytes(documents(spark, texts), 5).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    target, largest = sum(size(t) for _, t in texts) / 5, max(size(t) for _, t in texts)
    for s in range(5):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - target) <= largest
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"copy of a hot text")}) == 1
    assert shard_by_bytes(documents(spark, []), 3).collect() == []


def test_tokens_equal_the_library(spark):
    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    rnd = random.Random(1)
    texts = [t or "" for _, t in odd_texts()] + ["".join(rnd.choice("abcehinorst'é ") for _ in range(300)) for _ in range(40)]
    texts += ["".join(rnd.choice(["th", "in", "an", "ing", "é"]) for _ in range(200)) for _ in range(40)] + ["a" * 5000, "ab" * 3000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decoder.text(ids) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_documents(documents(spark, odd_texts()), path).collect()
    assert [list(r["ids"]) for r in rows] == [library.encode(t or "", add_special_tokens=False).ids for _, t in odd_texts()]
    assert bpe.encode_documents(documents(spark, []), path, digest=True).collect() == []


def test_packing_stands_long_runs_of_one_character(spark):
    """The pattern of the fast encoder gives up on these; the library does not."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [(0, " " * 1_000_000 + "x"), (1, "a" * 200_000), (2, "!" * 200_000), (3, "\n" * 300_000 + "end"), (4, "plain words")]
    rows = tokenised_pieces(documents(spark, texts), capacity=1024, keep_ids=True, library_path=P.path("byte_bpe_50k.json"), **PACK).collect()
    for i, t in texts:
        ids = [x for r in sorted((r for r in rows if r["_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids == library.encode(t, add_special_tokens=False).ids + [2], i


def test_long_words_stream_with_bounded_state():
    own = bpe.Encoder(P.path("word_bpe_49k.json"))
    given = 0

    def symbols(n):
        nonlocal given
        for i in range(n):
            given += 1
            yield own.inner[b"theinan"[i % 7]]

    tokens = own.merges.stream(symbols(5000))
    first = next(tokens)
    assert first in own.merges.parts and given < 200  # emitted long before the word ends


def test_byte_level_decoder_is_incremental():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = {i: t for t, i in library.get_vocab().items()}
    decoder = bpe.Decoder(tokens, {"type": "ByteLevel"})
    text = "naïve \U0001f600 ça va"
    ids = library.encode(text, add_special_tokens=False).ids
    assert decoder.text(ids) == text and "".join(decoder.feed(iter(ids))) == text


def test_packing(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = odd_texts() + [(100 + i, prose(i, 5 + 3 * i)) for i in range(90)]
    texts = [(i, t) for k, (i, t) in enumerate(texts) if i != 9 or k % 2 == 1]
    rows = pack_documents(documents(spark, texts), capacity=128, **PACK).collect()
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == cut(len(ids), 128)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 128
    assert len(bins) <= 1.02 * sum(bins.values()) / 128 + 1
    assert pack_documents(documents(spark, []), capacity=128, **PACK).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(i, prose(i, 10 + 7 * i)) for i in range(30)])
    pieces = tokenised_pieces(docs, capacity=64, keep_ids=True, **PACK).cache()
    placed = place_pieces(pieces, 64, ["_id", "piece"])
    rows = sequences(placed.select("sequence_id", "offset", "ids")).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(r["length"] for r in pieces.collect())
    assert all(len(r["ids"]) <= 64 for r in rows)


def test_plan_pairs_large_items_and_fills_gaps():
    plan = Plan({60: 2, 40: 2, 34: 1, 20: 3, 5: 4}, 100)
    bins = {}
    for n, _, count, first, offset in plan.runs:
        for b in range(first, first + count):
            bins.setdefault(b, []).append((offset, n))
    assert all(sum(n for _, n in items) <= 100 and sum(n > 33 for _, n in items) <= 2 for items in bins.values())
    assert sum(n for items in bins.values() for _, n in items) == 60 * 2 + 40 * 2 + 34 + 60 + 20
    assert plan.n_bins == 4 == len(bins)


def test_quality_rules(spark):
    good = [(i, prose(i, 60)) for i in range(150)]
    bad = [(1000 + i, "| ".join(prose(5000 + i, 30).split())) for i in range(150)]
    odd = [(2000, None), (2001, ""), (2002, "|||")]
    docs = documents(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out()), trees=5)
    assert model.rules
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(rows) == len(good) + len(bad) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert all(rows[i]["predicted"] == 1 for i, _ in good) and all(rows[i]["predicted"] == 0 for i, _ in bad)
    assert rows[0]["size"] == 7 and rows[0]["text"] == good[0][1]
    held = spark.range(100).withColumnRenamed("id", "doc_id").where(quality.held_out()).collect()
    assert {r[0] for r in held} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_quality_without_usable_labels(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, ones)).collect()} == {1.0}
    assert quality.score(documents(spark, []), quality.fit(docs, ones)).collect() == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((600, 16)).astype(np.float32)
    vectors[100:300] = vectors[100]  # a vector that a third of the rows have
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    rows += [(700, None, "x"), (701, [0.0] * 16, "x"), (702, [float("nan")] * 16, "x"), (703, [None] + [1.0] * 15, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=10, leaf_rows=32, trees=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    # one component after the other, so that equal vectors have equal scores on every machine
    exact = lambda q, i: functools.reduce(lambda s, ab: s + float(ab[0]) * float(ab[1]), zip(vectors[q], vectors[i]), 0.0)
    for q, found in got.items():
        scores = [exact(q, i) for i in range(600)]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert [rank for rank, _, _ in sorted(found)] == list(range(1, 11))
        assert [i for _, i, _ in sorted(found)] == order  # a small table is searched whole
        assert all(s == scores[i] for _, i, s in found)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, score string")
    assert len(nearest(few, few, k=10).collect()) == 6
    assert nearest(few.limit(0), few, k=10).collect() == []


def test_approximate_search_reaches_its_recall(spark):
    """Clustered vectors, no floor: a small share of the rows is looked at."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24)) * 3
    vectors = (centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 24)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0"), k=20, leaf_rows=64, trees=8, share=0.5, least_rows=0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = 0
    for q in range(0, 6000, 100):
        scores = exact[q].copy()
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 60
