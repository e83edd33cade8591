"""Exact, near, line, substring and passage dedup against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

from scholargraph.llm import line_dedup, passages, substrings
from scholargraph.llm.common import joined_spans, merged_spans
from scholargraph.llm.components import components
from scholargraph.llm.exact_dedup import exact_dedup
from scholargraph.llm.minhash import near_duplicates
from tests.llm.fixtures import documents, odd_texts, prose

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def variants(seed, n, words_each, changes):
    """n texts that differ from one another in a few words."""
    rnd, base = random.Random(seed), prose(seed, words_each).split(" ")
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(changes):
            t[rnd.randrange(len(t))] = "w%d" % rnd.randrange(10**6)
        out.append(" ".join(t))
    return out


def test_exact_dedup(spark):
    texts = odd_texts() + [(20, "o ne"), (21, " one ")]
    got = exact_dedup(documents(spark, texts), digest=True).collect()
    assert len(got) == len(texts)
    groups = defaultdict(list)
    for i, t in texts:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((i, len(t or "")))
    for r in got:
        rows = groups[r["text_sha256"]]
        assert r["group_size"] == len(rows)
        best = min((-n, -1 if i is None else i) for i, n in rows)[1]
        assert r["keep_id"] == (None if best == -1 else best)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup(documents(spark, [])).collect() == []


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        ws = words(t)
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    texts = [t for t in odd_texts() if t[0] is not None]
    # a chain of variants, a hot group of near copies, and many just below the threshold
    for g, (n, changes) in enumerate([(30, 1), (25, 3), (25, 6)]):
        texts += [(100 * (g + 1) + i, t) for i, t in enumerate(variants(50 + g, n, 150, changes))]
    got = near_duplicates(documents(spark, texts), k=4, percent=80).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    null = near_duplicates(documents(spark, [(None, "a b c d e"), (1, "a b c d e")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in null} == {(None, None, True), (1, 1, True)}
    assert near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_lines(texts):
    seen, index, out = [], defaultdict(list), defaultdict(set)
    for i, t in sorted(texts):
        for k, line in enumerate((t or "").split("\n")):
            ws = set(words(line))
            if not ws:
                continue
            shared = Counter(j for w in ws for j in index[w])
            if any(100 * n >= 80 * (len(ws) + len(seen[j]) - n) for j, n in shared.items()):
                out[i].add(k)
            for w in ws:
                index[w].append(len(seen))
            seen.append(ws)
    return {i: sorted(s) for i, s in out.items()}


def test_repeated_lines_equal_brute_force(spark):
    rnd = random.Random(3)
    lines = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 14))) for _ in range(300)]
    lines += ["the common line of all documents"] * 60 + ["The common line of all the documents now"] * 40
    rnd.shuffle(lines)
    texts = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(40)] + [(99, None), (98, ""), (97, "\n \n")]
    texts.append((96, " ".join("t%d" % i for i in range(6000)) + "\n" + " ".join("t%d" % i for i in range(5500))))
    docs = documents(spark, texts)
    removed = line_dedup.repeated_lines(docs)
    got = {r["doc_id"]: r["removed"] for r in removed.collect()}
    expected = brute_lines(texts)
    assert got == expected
    cut = line_dedup.without_lines(docs, removed).collect()
    by_id = {r["doc_id"]: r["text"] for r in cut}
    for i, t in texts:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in expected.get(i, ())]
        if i in expected and not any(words(x) for x in left):
            assert i not in by_id
        else:
            assert by_id[i] == (t if i not in expected else "\n".join(left))
    assert cut[0].asDict().keys() == docs.first().asDict().keys()
    odd = [t for t in odd_texts() if t[0] not in (None, 9)]
    assert {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(documents(spark, odd)).collect()} == brute_lines(odd)
    assert line_dedup.repeated_lines(documents(spark, [])).collect() == []


def brute_strings(texts, length):
    at = defaultdict(list)
    data = {i: (t or "").encode() for i, t in texts}
    for i, b in data.items():
        for p in range(len(b) - length + 1):
            at[b[p : p + length]].append((i, p))
    marks = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p : p + length] = True
    return {i: (len(b), int(marks[i].sum()), bytes(np.frombuffer(b, np.uint8)[~marks[i]])) for i, b in data.items()}


def test_repeated_strings_equal_brute_force(spark, monkeypatch):
    texts = [t for t in odd_texts() if t[0] is not None and t[0] != 9]
    passage = prose(60, 40).replace("\n", " ")
    texts += [(30 + i, prose(70 + i, 30) + passage + prose(90 + i, 20)) for i in range(12)]
    texts += [(50 + i, "x" * i + "shared beginning of a context that goes on differently " * 2 + prose(200 + i, 40)) for i in range(12)]
    docs, expected = documents(spark, texts), brute_strings(texts, 100)
    for most in (4096, 3):  # by index, and string by string
        monkeypatch.setattr(substrings, "_MAX_CONTEXTS", most)
        out = substrings.without_spans(docs, substrings.repeated_spans(docs, length=100, k=24)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out} == expected
    assert substrings.repeated_spans(documents(spark, [])).collect() == []


def test_run_length_index_statistics():
    rnd = random.Random(5)
    contexts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(12, 60))) for _ in range(40)]
    index = substrings.RunLengthIndex(contexts, 12)
    text, ends = b"".join(contexts), np.cumsum([len(c) for c in contexts])

    def shared(a, b):
        room, n = min(ends[np.searchsorted(ends, a, side="right")] - a, ends[np.searchsorted(ends, b, side="right")] - b), 0
        while n < room and text[a + n] == text[b + n]:
            n += 1
        return n

    starts = index.starts.tolist()
    assert index.statistics().tolist() == [max(shared(a, b) for b in starts if b != a) for a in starts]
    assert index.counts.sum() == len(starts)
    repetitive = substrings.RunLengthIndex([contexts[0] + b"c"] * 50, 12)
    assert len(repetitive.symbols) < len(repetitive.starts) / 10


def test_passages_that_repeat_are_found(spark):
    passage = prose(7, 80).split()
    near = list(passage)
    for i in range(9, 80, 12):
        near[i] = "other%d" % i
    texts = [(i, None if i == 3 else prose(300 + i, 60)) for i in range(12)]
    texts[2] = (2, texts[2][1] + " " + " ".join(passage) + " " + prose(400, 30))
    texts[5] = (5, prose(401, 90) + "\n" + " ".join(passage))
    texts[8] = (8, " ".join(near) + " " + prose(402, 70))
    texts[9] = (9, " ".join(passage[:30]) + " " + prose(403, 70))
    texts += [(20, prose(20, 200)), (21, prose(20, 200)), (22, "short copy"), (23, "short copy"), (24, "The " * 400), (25, "")]
    docs = documents(spark, texts)
    spans = merged_spans(passages.repeated_passages(docs))
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in spans.collect()}
    assert set(got) == {5, 8, 21}
    assert got[5] == [(90, 170)] and got[21] == [(0, 200)]
    (start, end), = got[8]
    assert start <= 2 and 75 <= end <= 82
    out = {r["doc_id"]: r["text"] for r in passages.without_passages(docs, spans).collect()}
    assert 21 not in out and out[20] == prose(20, 200) and out[3] is None and out[25] == ""
    assert words(out[5]) == words(prose(401, 90)) and out[9] == texts[9][1]
    assert passages.repeated_passages(documents(spark, [])).collect() == []
    odd = [t for t in odd_texts() if t[0] not in (None, 9)]
    assert {r["doc"] for r in merged_spans(passages.repeated_passages(documents(spark, odd))).collect()} == {4, 5, 6}


def test_spans_and_edits():
    starts, ends = joined_spans(np.array([5, 0, 9, 2]), np.array([7, 3, 10, 5]))
    assert starts.tolist() == [0, 9] and ends.tolist() == [7, 10]
    a = np.array([1, 2, 3, 4, 5])
    assert passages.edits(a, np.array([1, 2, 9, 4, 5])) == 1
    assert passages.edits(a, np.array([1, 3, 4, 5, 6])) == 2
    assert passages.edits(a, np.array([], int)) == 5


def test_steps_between_equal_words_are_told_apart():
    doc = np.arange(60)
    src = np.concatenate((doc[:20], [99], doc[21:40], [98], doc[40:]))
    pos, spos = np.array([0, 3, 10, 24, 30, 42, 50]), np.array([0, 3, 10, 24, 30, 43, 51])
    # a changed word lies in the third step, an added one in the fifth
    assert passages._unlike_steps(doc, src, pos, spos, 4) == [3, 5]
    assert passages._unlike_steps(doc, doc, pos, pos, 4) == []
    assert passages.align(doc, src, pos, spos, 4, 50, 80) == [(0, 60, 0, 61)]


def found_words(docs, **more):
    spans = merged_spans(passages.repeated_passages(docs, **more)).collect()
    return {(r["doc"], w) for r in spans for s in r["spans"] for w in range(s["start"], s["end"])}


def test_passages_quoted_in_part_by_other_documents_are_found(spark):
    """Against brute force over all runs of 50 words, with partial quotes of
    every passage before and after several whole copies."""
    rnd, texts = random.Random(5), []
    for g in range(12):
        whole = prose(500 + g, 80).split()
        cut = 40 + rnd.randrange(-8, 9)
        parts = [whole[:cut], whole[80 - cut :], whole, whole, whole, whole, whole[:cut], whole[80 - cut :]]
        for i, part in enumerate(parts):
            texts.append((100 * i + g, " ".join([prose(1000 + 10 * g + i, 30), *part, prose(2000 + 10 * g + i, 30)])))
    texts.append((900, texts[2][1] + " " + texts[3][1]))
    first, expected = {}, set()
    for i, t in sorted(texts):
        ws = words(t)
        for j in range(len(ws) - 49):
            if first.setdefault(tuple(ws[j : j + 50]), i) < i:
                expected |= {(i, w) for w in range(j, j + 50)}
    assert len(expected) > 12 * 3 * 80
    got = found_words(documents(spark, texts))
    assert expected <= got
    # what is more must be near repeats at the ends of those
    assert len(got - expected) < 0.02 * len(expected)


def test_a_passage_of_frequent_seeds_is_found_whatever_holds_them(spark):
    """The only partner is neither the first nor among the last that have the
    passage's seeds; the others have half of it."""
    whole = prose(77, 60).split()
    near = ["w%d" % j if j in (12, 29, 47) else w for j, w in enumerate(whole)]
    halves = whole[:30], whole[30:]
    texts = [(i, " ".join([prose(5000 + i, 20), *halves[i % 2], prose(6000 + i, 20)])) for i in range(60) if i != 20]
    texts.append((20, " ".join([prose(5020, 20), *whole, prose(6020, 20)])))
    texts.append((70, " ".join([prose(5070, 20), *near, prose(6070, 20)])))
    assert found_words(documents(spark, texts)) == {(70, 20 + w) for w in range(60)}


def test_a_common_phrase_is_not_matched_with_every_other_place_of_it(spark, monkeypatch):
    """Only where the same two documents have another run of equal words near
    it; the matches of all places of a phrase grew with their square."""
    made, write = [], passages.written

    def spied(df, name):
        out = write(df, name)
        if name == "matches":
            made.append(out.where("kind < 64").count())
        return out

    monkeypatch.setattr(passages, "written", spied)
    phrase = " ".join(prose(91, 24).split()[:24])
    texts = [(i, " ".join([prose(20_000 + i, 40), phrase, prose(30_000 + i, 40)])) for i in range(300)]
    near = " ".join(prose(92, 40).split()[:40])
    texts += [(i, " ".join([prose(40_000 + i, 30), phrase, "w%d" % i, near, prose(50_000 + i, 30)])) for i in (400, 401)]
    got = found_words(documents(spark, texts))
    assert sum(made) < 3000
    start = len(words(prose(40_401, 30)))
    assert got == {(401, start + w) for w in range(24 + 1 + 40)}


def test_passages_of_common_phrases_alone_are_found(spark):
    """Phrases that hundreds of documents have make a passage only where two
    documents have them one after the other."""
    phrases = [" ".join(prose(93 + i, 20).split()[:18]) for i in range(4)]
    texts = []
    for i in range(600):
        texts.append((i, " ".join([prose(60_000 + i, 25), phrases[i % 4], prose(70_000 + i, 25)])))
    for i in (700, 701, 702):
        order = phrases if i != 701 else phrases[::-1]
        parts = [x for n, p in enumerate(order) for x in (p, "w%d_%d" % (n, i))]
        texts.append((i, " ".join([prose(80_000 + i, 25), *parts, prose(90_000 + i, 25)])))
    start = len(words(prose(80_702, 25)))
    assert found_words(documents(spark, texts)) == {(702, start + w) for w in range(4 * 18 + 3)}


def test_matches_made_anew_are_those_of_both_texts():
    """With words added, changed and left out; nothing shorter than a passage."""
    rnd = random.Random(4)
    mine = np.array([rnd.randrange(1 << 31) for _ in range(90)], np.int32)
    its = np.concatenate(([5, 6], mine[10:30], [7], mine[31:50], mine[52:85], [8, 9])).astype(np.int32)
    chain, = passages._rematched(mine, its, 0, -64, 64, 4, 7, 50)
    at = dict(zip(*(c.tolist() for c in chain)))
    assert min(at) == 10 and max(at) == 81 and all((mine[a : a + 4] == its[b : b + 4]).all() for a, b in at.items())
    assert {a - b for a, b in at.items()} == {8, 10}
    assert list(passages._rematched(mine, its[:40], 0, -64, 64, 4, 7, 50)) == []
    assert list(passages._rematched(mine, its, 0, 30, 64, 4, 7, 50)) == []


def test_matches_are_all_pairs_thinned_out_in_runs():
    """Every pair's runs of equal words come back from the matches made,
    however few are made at a time."""
    rnd = random.Random(3)
    line = [rnd.randrange(1 << 40) for _ in range(30)]
    docs = [[rnd.randrange(1 << 40) for _ in range(i % 5)] + line[: 20 + i % 11] + [rnd.randrange(1 << 40)] for i in range(40)]
    rows = []
    for d, ws in enumerate(docs):
        for p in range(len(ws) - 3):
            flank = (ws[p - 1] % (1 << 31) if p else 0) << 32 | (ws[p + 4] % (1 << 32) if p + 4 < len(ws) else 0)
            rows.append((hash(tuple(ws[p : p + 4])), 0, d, p << 32, flank))
    cols = [np.array(c, np.int64) for c in zip(*sorted(rows, key=lambda r: (r[0], r[2], r[3])))]
    parts = list(passages.matches(*cols, 8, 50))
    assert max(len(p[0]) for p in parts) < 200
    made = set(zip(*(np.concatenate(c).tolist() for c in zip(*parts))))
    assert sum(len(p[0]) for p in parts) == len(made)
    expected = set()
    for d, ws in enumerate(docs):
        for e in range(d):
            n = min(20 + d % 11, 20 + e % 11)
            for j in range(n - 3):
                p, on = d % 5 + j, passages._GOES_ON if j < n - 4 else 0
                start = j == 0 and (d % 5 or e % 5)
                if start or not on or p % 8 == 0:
                    expected.add((d, e, p, e % 5 + j, on))
    assert made == expected


def test_short_chains_that_go_have_nothing_to_add(spark, monkeypatch):
    """The same words are found if no chain goes for being short; among them
    those of short near lines beside a copied passage."""
    copied, line = prose(81, 60).split(), prose(82, 30).split()
    near = ["w%d" % j if j in (3, 17) else w for j, w in enumerate(line)]
    texts = [(0, " ".join(copied))]
    for i in range(1, 26):
        parts = [near if i % 2 else line, copied] if i % 3 else [copied[:15], line]
        texts.append((i, " ".join([prose(7000 + i, 20), *sum(parts, []), prose(8000 + i, 20)])))
    got = found_words(documents(spark, texts))
    assert {i for i, _ in got} == {i for i in range(1, 26) if i % 3}
    assert {(25, 20 + w) for w in range(90)} <= got and (25, 19) not in got
    monkeypatch.setattr(passages, "bits", lambda *_: np.ones(1 << 23, dtype=bool))
    assert found_words(documents(spark, texts)) == got


def test_passages_of_documents_cut_in_slices(spark, monkeypatch):
    """A document whose chains are dealt out in slices gives the same rows, with
    texts hashed many at a time or one by one."""
    whole = prose(31, 120).split()
    texts = [(0, " ".join(whole))]
    for i in range(1, 20):
        near = ["w%d" % j if j % 11 == i % 11 else w for j, w in enumerate(whole)]
        texts.append((i, " ".join([prose(3000 + i, 20), *near, prose(4000 + i, 20)])))
    texts += [(30, None), (31, ""), (32, "three short words")]
    docs = documents(spark, texts)
    rows = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    assert {r[0] for r in rows} == set(range(1, 20))
    monkeypatch.setattr(passages, "_SLICE", 3)
    assert sorted(tuple(r) for r in passages.repeated_passages(docs).collect()) == rows
    one = [x.tolist() for t in texts for x in passages._narrow(passages.pa.array([(t[1] or "").encode()]))]
    assert [x.tolist() for x in passages._narrow(passages.pa.array([(t or "").encode() for _, t in texts]))] == one


def alike(same):
    """Places in stretches of 50 or more of which every beginning and every end
    agrees in 80 % or more."""
    score, out = np.concatenate(([0], np.cumsum(np.where(same, 1, -4)))), set()
    for a in range(len(same) - 49):
        for b in range(a + 50, len(same) + 1):
            part = score[a : b + 1]
            if part.min() == part[0] and part.max() == part[-1]:
                out |= set(range(a, b))
    return out


def test_near_passages_against_brute_force(spark):
    """Copies with changes at even steps and at random, 80 to 90 % alike."""
    rnd, texts, truth = random.Random(8), [], {}
    cells = [(percent, n, even) for percent in (80, 85, 90) for n in (50, 60, 80, 120) for even in (True, False)]
    for c, (percent, n, even) in enumerate(cells):
        for i in range(6):
            seed = 10_000 + 100 * c + 4 * i
            whole = prose(seed, n).split()
            changes = n * (100 - percent) // 100
            step = n / changes
            at = [int(step * j + step / 2) for j in range(changes)] if even else rnd.sample(range(n), changes)
            near = ["w%d" % j if j in set(at) else w for j, w in enumerate(whole)]
            head = [prose(seed + j, 40) for j in (1, 2, 3)]
            texts.append((1000 * c + 2 * i, " ".join([head[0], *whole, head[1]])))
            texts.append((1000 * c + 2 * i + 1, " ".join([head[2], *near, head[0][::-1]])))
            same = np.array([j not in set(at) for j in range(n)])
            truth[1000 * c + 2 * i + 1] = (c, {40 + w for w in alike(same)})
    got = found_words(documents(spark, texts))
    have, all_words = Counter(), Counter()
    for doc, (c, expected) in truth.items():
        key = cells[c][0]
        all_words[key] += len(expected)
        have[key] += sum((doc, w) in got for w in expected)
    recall = {key: have[key] / all_words[key] for key in all_words}
    print(recall)
    assert min(recall.values()) >= 0.98
    assert {doc for doc, _ in got} <= set(truth)


def test_line_dedup_lets_its_shuffles_go(spark, monkeypatch):
    """What a step has shuffled does not lie on disk beside the next step's."""
    from scholargraph.llm import line_dedup

    key, seen, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], line_dedup.written
    before = spark.conf.get(key, None)
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (seen.append(spark.conf.get(key)), write(df, name))[1])
    df = spark.createDataFrame([(1, "a b c d e f\nx y"), (2, "a b c d e f\nz")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.repeated_lines(df).collect()] == [(2, [0])]
    assert seen and set(seen) == {"true"}
    assert spark.conf.get(key, None) == before


def test_prefix_tokens_of_lines_are_dealt_out_once(spark, monkeypatch):
    """op8: they were shuffled once for each side of a self-join."""
    plans, write = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    df = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f g")])
    assert [tuple(r) for r in line_dedup.repeated_lines(df).collect()] == [(2, [0])]
    assert sum(p.count("posexplode(prefix") for p in plans) == 1


def test_tokens_that_too_many_lines_share_are_joined(spark, monkeypatch):
    """Rows of a token above a task's share go on to a join; nothing is lost."""
    rnd = random.Random(5)
    texts = []
    for i in range(90):
        line = ["w%d" % j for j in range(i % 3 * 4, i % 3 * 4 + 12)]
        for _ in range(rnd.randint(0, 3)):
            line[rnd.randrange(12)] = "x%d" % rnd.randrange(20)
        texts.append((i, " ".join(line) + "\nalone %d %d %d" % (i, i * i, -i)))
    monkeypatch.setattr(line_dedup, "_HUBS", 0)
    expected = brute_lines(texts)
    for most in (1, 7, 1 << 16):
        monkeypatch.setattr(line_dedup, "_MOST", most)
        found = line_dedup.repeated_lines(documents(spark, texts)).collect()
        assert {r["doc_id"]: r["removed"] for r in found} == expected
