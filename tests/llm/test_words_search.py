"""Spelling variants, syncmer fingerprints and ranked search against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scholargraph.llm import lexical, runs, spelling
from scholargraph.llm.lexical import ranked_search
from scholargraph.llm.spelling import near_in_group, spelling_variants, vocabulary
from scholargraph.llm.syncmers import Syncmers, fingerprints, likeness, packed, unpacked
from tests.llm.fixtures import documents, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(texts, least_length, least_count, ratio, damage):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if damage and i is not None and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(near), n[form[w]] if form[w] else None)
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], *out[w]) for w in n}


def variant_texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abÀé") for _ in range(rnd.randint(4, 8))) for _ in range(150)]
    many = [w for i, w in enumerate(words) for _ in range(1 + 400 // (i + 1))]
    rnd.shuffle(many)
    texts = [(1000 + i, " ".join(many[i::40])) for i in range(40)]
    # one prefix that a third of all words have, ÷ and ×, runs longer than 64 bytes
    texts += [(2000 + i, " ".join(f"common{a}{b}" for a in "abcdefgh" for b in "abcdefgh")) for i in range(6)]
    texts += [(3000 + i, "a÷×b÷×a " + "long" * 30 + " " + "long" * 30 + "x") for i in range(7)]
    return texts + odd_texts()


def test_variants_equal_brute_force(spark, monkeypatch):
    texts = variant_texts()
    for group, damage in ((20_000, 7), (10, 0)):
        monkeypatch.setattr(spelling, "TASK_GROUP", group)  # large groups are cut before they reach a task
        got = spelling_variants(documents(spark, texts), 4, 2, 3, damage=damage)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == brute_variants(texts, 4, 2, 3, damage)
    assert spelling_variants(documents(spark, []), damage=199).collect() == []


def test_groups_are_cut_without_losing_or_repeating_pairs(monkeypatch):
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.choice((7, 8)))) for _ in range(400)})
    brute = {(x, y) for x in words for y in words if x < y and is_near(x, y) and min(len(x), len(y)) == 7}
    for size in (2, 48, 10_000):
        monkeypatch.setattr(spelling, "SCAN_GROUP", size)
        got = [tuple(sorted((words[i], words[j]))) for i, j in near_in_group(words, 7, 0, 0, 8)]
        assert len(got) == len(set(got)) and set(got) == brute


def test_runs_do_not_depend_on_pieces(monkeypatch):
    texts = ["Ab cd", "", "ef" * 40, "x é-ÿ÷ü 12 İ", "y", "-" * 50, "a" * 100 + " b"] * 3
    found = []
    for piece in (7, 64, 1 << 20):
        monkeypatch.setattr(runs, "PIECE", piece)
        got = []
        for r in runs.hashed_runs(pa.array(["cut off", *texts])[1:], runs.terms):
            got += zip(r.texts.tolist(), [r.data[s:e].tobytes().decode() for s, e in zip(r.starts, r.ends)], r.hashes.tolist())
        found.append(got)
    assert found[0] == found[1] == found[2]
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    assert [(i, w) for i, w, _ in found[0]] == [(i, w) for i, t in enumerate(texts) for w in pattern.findall(t.translate(LOWER))]
    assert len({w for _, w, _ in found[0]}) == len({h for *_, h in found[0]})


def test_words_are_counted_whole(spark):
    texts = [(i, "thing " * 500 + "Thing") for i in range(20)]
    assert [tuple(r) for r in vocabulary(documents(spark, texts), 5, 1).collect()] == [("thing", 20 * 501)]


def test_closed_syncmers_by_their_definition():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abc") for _ in range(400)) + "é\U0001f600" * 30
    k, s = 12, 5
    own = Syncmers(k, s)
    inner = {}  # the hash of an inner substring, from a text that is one
    for i in range(len(text) - s + 1):
        from scholargraph.llm.syncmers import _substrings, mix

        codes = np.frombuffer(text[i : i + s].encode("utf-32-le"), np.uint32)
        inner[i] = int(mix(_substrings(codes, s))[0])
    expected = []
    for i in range(len(text) - k + 1):
        window = [inner[j] for j in range(i, i + k - s + 1)]
        if min(window) in (window[0], window[-1]):
            expected.append(i)
    hashes, places = own.anchors(text)
    assert places.tolist() == expected
    assert max(np.diff(places)) <= k - s  # no long stretch without an anchor
    by_text = {}
    for h, p in zip(hashes.tolist(), places.tolist()):
        assert by_text.setdefault(text[p : p + k], h) == h
    # free of context: an anchor stays one wherever its text stands
    moved = own.anchors("zz" + text[37:90])
    assert {int(p) + 35 for p in moved[1] if p >= 2} == {p for p in expected if 37 <= p <= 90 - k}
    assert unpacked(packed((hashes, places)))[0].tolist() == hashes.tolist()
    assert (unpacked(packed((hashes, places)))[1] + places[0]).tolist() == places.tolist()


def test_likeness():
    own = Syncmers()
    a, b = prose(1, 600), prose(2, 600)
    assert likeness(own.anchors(a), own.anchors(a)) == 1.0
    assert likeness(own.anchors(a), own.anchors(b)) < 0.02
    assert 0.4 < likeness(own.anchors(a), own.anchors(a[: len(a) // 2] + b[: len(b) // 2])) < 0.6
    assert 0.4 < likeness(own.anchors(a + b), own.anchors(b + a)) < 0.6  # only one order counts
    assert likeness(own.anchors(""), own.anchors("")) == 1.0 and likeness(own.anchors(""), own.anchors(a)) == 0.0


def test_fingerprints_meet_the_next_document(spark):
    texts = odd_texts() + [(100 + i, prose(i % 9, 30 + i % 9)) for i in range(60)] + [(-5, "first of all " * 20)]
    random.Random(3).shuffle(texts)
    rows = fingerprints(documents(spark, texts)).collect()
    listed = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    own, expected = Syncmers(), []
    for (i, t), (_, following) in zip(listed, listed[1:] + listed[:1]):
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        f = [own.anchors(x) for x in (t, edited, following)]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(t), digest, packed(f[0]), packed(f[1]), likeness(f[0], f[1]), likeness(f[0], f[2])))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints(documents(spark, [])).collect() == []
    one = fingerprints(documents(spark, [(3, "alone")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(3, 1.0)]


def brute_search(texts, items, k):
    found = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    docs = [(i, Counter(found(t))) for i, t in texts if i is not None and found(t)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(found(t))
    out = {}
    for item, terms in wanted.items():
        scores = []
        for i, c in docs:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if s > 0:
                scores.append((-s, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return {i: v for i, v in out.items() if v}


def search_cases():
    texts = odd_texts() + [(100 + i, prose(i % 50, 20 + 7 * (i % 13))) for i in range(400)]
    texts += [(1000 + i, "the the common words " + prose(900 + i, 6)) for i in range(200)]
    items = [(i, prose(i, 25)) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, "the"), (23, "THE common"), (23, "words the")]
    return texts, items + [(24, prose(2, 4000))]


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    texts, items = search_cases()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, term int, doc_id int")
    for terms in (200_000, 40):
        monkeypatch.setattr(lexical, "PASS_TERMS", terms)
        got = {}
        for r in ranked_search(documents(spark, texts), frame, k=7).collect():
            got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
        assert {i: sorted(v) for i, v in got.items()} == brute_search(texts, items, 7)
    assert ranked_search(documents(spark, []), frame).collect() == []
    assert ranked_search(documents(spark, texts), frame.limit(0)).collect() == []


def test_blocks_are_bounded_and_strata_cut_the_visit(monkeypatch):
    """Small blocks give the same best documents, and a bound that is too low
    for a stratum keeps its documents from being scored."""
    rnd = np.random.default_rng(1)
    rows = [(int(m), i, [1, 2 + i % 3], [int(t), 1]) for i, (m, t) in enumerate(zip(np.sort(rnd.integers(10, 40, 500)), rnd.integers(1, 9, 500)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["m", "id", "terms", "tfs"])
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    blocks = list(lexical._inverted(iter([batch])))
    assert [len(set(b.column(5)[0].as_py())) for b in blocks] == [64] * 7 + [52]
    wanted, weights = np.array([1, 3, 99]), np.array([50, 3000, 1])
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    scored = 0
    for b in blocks:
        block = lexical.Block(tuple(c[0].values.to_numpy() for c in b.columns))
        more = block.search(wanted, weights, 5, int(best[1][-1]) if len(best[1]) == 5 else 0)
        scored += len(more[0])
        best = lexical._best(np.append(best[0], more[0]), np.append(best[1], more[1]), 5)
    exact = []
    for m, i, ts, fs in rows:
        exact.append((-sum({1: 50, 3: 3000}.get(t, 0) * ((10**9 * f) // (1000 * f + 8 * m)) for t, f in zip(ts, fs)), i))
    assert list(zip((-best[1]).tolist(), best[0].tolist())) == sorted(exact)[:5]
    assert scored < 250


def test_tasks_pass_on_few_rows_however_many_there_are():
    """With a leaf a task, far fewer rows are passed on than 21 a leaf, and none of the best is lost."""
    import numpy as np
    import pyarrow as pa

    from scholargraph.llm import neighbours as N

    rng = np.random.default_rng(3)
    rows = rng.standard_normal((3000, 16)).astype(np.float32)
    queries, k = rows[::100].astype(np.float64), 20
    forest = N.Forest(rows.astype(np.float64), float(np.linalg.norm(rows, axis=1).max()), 4, 5)
    leaves = forest.leaves(rows.astype(np.float64))
    counts = np.stack([np.bincount(leaves[:, t], minlength=32) for t in range(4)])
    vectors = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(len(queries))), vectors(queries)], ["id", "vector"])
    visits = next(N._visit(forest, counts, 10000, rows[:1000].astype(np.float64), k)(iter([asked])))
    passed = []
    for t in range(4):
        for leaf in range(32):
            held = np.flatnonzero(leaves[:, t] == leaf)
            of = [v for v in visits.to_pylist() if (v["tree"], v["leaf"]) == (t, leaf)]
            parts = [(held, rows[held], 0, np.zeros(len(held))),
                     (np.array([v["id"] for v in of], np.int64), np.array([v["vector"] for v in of], np.float32).reshape(-1, 16), 1, np.array([v["least"] for v in of]))]
            batches = [pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), t, np.int32)), pa.array(np.full(len(ids), leaf, np.int32)), pa.array(np.full(len(ids), is_query, np.int32)),
                 pa.array(ids), vectors(vec), pa.array(least, pa.float64())],
                ["tree", "leaf", "is_query", "id", "vector", "least"]) for ids, vec, is_query, least in parts]
            passed += [r for b in N._rerank(k)(iter(batches)) for r in b.to_pylist()]
    assert len(passed) < 0.2 * k * visits.num_rows
    exact = queries @ rows.T.astype(np.float64)
    for q in range(len(queries)):
        found = {r["cls"]: r["score"] for r in passed if r["qid"] == q}
        best = sorted(found, key=lambda c: (-found[c], c))[:k]
        assert best == sorted(range(len(rows)), key=lambda c: (-exact[q, c], c))[:k]
