import json
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from vertexloom.llm import ann, chat, decontaminate, jaccard, licenses, linededup, packing, pii, toxicity, urlfilter
from vertexloom.llm.shared import components

BASE = [f"word{i} other{i * 7 % 31} thing{i * 5 % 17}" for i in range(40)]


def docs(spark, texts):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def sets(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus():
    long = " ".join(BASE)
    near = long.replace("word7 ", "changed ").replace("word30 ", "changed ")
    return [long, near, near.replace("word15 ", "new "), long, None, "", "a b", "A b", "x y z " * 300, "\n".join(["same line of six words here"] * 3), "same line of six words here\nbut this line has nothing in common"]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and all(got[k] == 500 for k in range(500, 560))


def test_components_of_few_links_take_few_jobs(spark):
    rng = np.random.default_rng(29)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (200, 2)) * 2**50] + [(i + 1, i) for i in range(40)] + [(None, 3), (3, None), (9, 9)]
    links = spark.createDataFrame(pairs, "a long, b long")
    up = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in up:
        for a, b in pairs:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(local):
        sc.setJobGroup(f"components {local}", "")
        got = components(spark, links, local=local).collect()
        sc.setJobGroup("", "")
        assert len(got) == len(up) and {r.node: r.component for r in got} == up
        return len(tracker.getJobIdsForGroup(f"components {local}"))

    # The first way is the only one for more links than a broadcast may have.
    assert jobs(0) > 12 >= jobs(200_000)
    assert components(spark, links.where("false")).count() == 0
    assert {tuple(r) for r in components(spark, spark.createDataFrame([("b", "a")], "a string, b string")).collect()} == {("a", "a"), ("b", "a")}


def test_jaccard_is_brute_force(spark, corpus):
    s = [sets(t) for t in corpus]
    up = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    got = jaccard.jaccard_components(docs(spark, corpus)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == up and [r.n_shingles for r in got] == [len(x) for x in s]
    assert jaccard.jaccard_components(docs(spark, corpus).where("false")).count() == 0


def test_decontaminate(spark, corpus):
    items = spark.createDataFrame([(1, " ".join(BASE[:6])), (10, "same line of six"), (2, None), (None, "a b"), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, corpus).selectExpr("*", "1 AS ws", "2 AS pos", "3 AS term"), items).collect()}
    assert got[0].n_hit == 18 and got[0].n_items == 1 and got[0].contaminated and got[0].n_words == 120
    assert got[9].n_hit == 12 and got[6].n_hit == 2 and got[6].n_items == 0 and got[4].n_words == 0 and not got[4].contaminated
    near = decontaminate.proximity_matches(docs(spark, corpus), spark.createDataFrame([(5, "here same")], "item_id long, text string"))
    assert {r.doc_id for r in near.collect()} == {9, 10}


def test_posting_lists_of_equal_members_meet_once(spark):
    rng = np.random.default_rng(17)
    word = lambda: f"w{rng.integers(100000)}"
    passage = [word() for _ in range(80)]
    texts = [" ".join([word() for _ in range(40)] + passage[: 50 + 5 * (k % 7)] + [word() for _ in range(20)]) for k in range(12)]
    texts += [texts[0].replace(passage[9], "new"), " ".join(texts[1].split()[:-12])]
    lists = jaccard.shared(jaccard.postings(docs(spark, texts), spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint8))), 75, 100))
    whole = {}
    for r in lists.collect():
        whole.setdefault(r.token, set()).add(r.sig)
    met = {}
    for r in jaccard.alike(lists).collect():
        met.setdefault(r.token, (r.w, set()))[1].add(r.sig)
    assert len(met) == len({frozenset(x) for x in whole.values()}) < len(whole) and sum(w for w, _ in met.values()) == len(whole)
    shares = lambda x: sorted((a, b) for a in x for b in x if a < b)
    assert sorted(p for x in whole.values() for p in shares(x)) == sorted(p for w, x in met.values() for p in shares(x) for _ in range(w))
    s = [sets(t) for t in texts]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    near = {(i, j) for j in range(len(s)) for i in range(j) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])}
    assert {(0, 12), (1, 13)} <= near and all(got[i] == got[j] for i, j in near)


def test_unlike_documents_of_common_tokens_seldom_meet(spark):
    rng = np.random.default_rng(23)
    base = [f"w{k}" for k in rng.integers(0, 100000, 300)]

    def edited(words, n):
        at = set(rng.choice(len(words), n, replace=False).tolist())
        return [f"new{rng.integers(100000)}" if k in at else w for k, w in enumerate(words)]

    texts = [edited(base, 6) for _ in range(30)]
    texts = [" ".join(t) for t in texts + [edited(t, 1) for t in texts[:6]] + [t[:-30] for t in texts[6:12]]]
    few = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    lists = jaccard.shared(jaccard.postings(docs(spark, texts), few, 75, 100)).withColumn("g", F.col("sig"))
    classes = jaccard.survey(docs(spark, texts)).where("n > 0")
    rows = [(r.a, r.b) for r in jaccard.meetings(lists, classes, 75, 100).collect()]
    s, of = [sets(t) for t in texts], {r.doc_id: r.s1 for r in classes.collect()}
    pairs = {tuple(sorted((of[i], of[j]))): 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]) for j in range(len(s)) for i in range(j)}
    near = {p for p in pairs if pairs[p]}
    # They met in 4,839 lists when every token of a pair counted.
    assert len(near) >= 12 and near <= set(rows) and len(rows) <= 3 * len(pairs)


def test_line_dedup(spark):
    line = " ".join(f"sentence{i}" for i in range(30))
    texts = [f"{line}\nshort", f"Other text stands in this line here\n{line.upper()}!", line.replace("sentence3 ", "sentence4 "), None, "", "short\nshort"]
    got = linededup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in got[:2]] == [texts[0], "Other text stands in this line here"]
    assert got[3].text is None and got[4].text == "" and got[5].text == "short\nshort" and got[1].n_removed == 1 and got[1].n_chars == 35
    twice = docs(spark, texts[:1]).union(docs(spark, texts[:1]))
    assert [r.text for r in linededup.dedup_lines(twice).collect()] == texts[:1] * 2
    assert linededup.dedup_lines(docs(spark, texts).where("false")).count() == 0


def test_short_lines_are_deduplicated_exactly(spark):
    got = linededup.dedup_lines(docs(spark, ["Two words\nThree more words", "two  words!\nthree other words\nA b c d", "a B c d\n\n\nalone\nalone"])).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["Two words\nThree more words", "three other words\nA b c d", "\n\nalone\nalone"]


def test_every_class_of_lines_is_compared(spark):
    rng = np.random.default_rng(7)
    long = " ".join(f"word{k}" for k in rng.integers(0, 5000, 17000))
    pairs = [
        ("seven words are compared by characters here", "seven words are compared by charakters here"),
        ("nine words with one gone are ten words less", "nine words with one gone are ten words less one"),
        (" ".join("a bc d ef".split() * 5), " ".join("a bc d ef".split() * 4 + "a bc d no".split())),
        (long, long.replace("word7 ", "new ")),
    ]
    got = linededup.dedup_lines(docs(spark, [t for p in pairs for t in p] + ["five words unlike the rest"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 1] * len(pairs) + [0]


def test_short_lines_are_brute_force(spark):
    rng = np.random.default_rng(9)
    lines = []
    for _ in range(25):
        base = " ".join("".join(rng.choice(list("abcdeist"), rng.integers(2, 9))) for _ in range(rng.integers(5, 10)))
        for n_edits in (0, 1, len(base) // 10, len(base) // 10 + 1):
            w = list(base)
            for k in sorted(rng.choice(np.flatnonzero([c != " " for c in w]), n_edits, replace=False).tolist(), reverse=True):
                kind = rng.integers(3)
                w[k : k + (kind > 0)] = [] if kind == 2 else ["x"]
            lines.append(" ".join("".join(w).split()))
    lines = [t for t in dict.fromkeys(lines) if 5 <= len(t.split()) <= 10]
    df = spark.createDataFrame([(0, i, 0, t, i, i) for i, t in enumerate(lines)], "doc_id long, rid long, pos int, norm string, h1 long, h2 long")
    units = linededup.compared(df, 5).where("by_chars")
    links = linededup.similar_lines(units, linededup.simhashes(units), 0.9)
    got = {~r.node: r.component for r in components(spark, links).collect()}
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) * 0.1 + 1e-9}
    assert len(similar) > 40 and all(got.get(i, -1) == got.get(j, -2) for i, j in similar)


def test_short_unlike_lines_seldom_share_keys(spark):
    rng = np.random.default_rng(11)
    parts = "the on ing er and tion ha re th an in es of en".split()
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    lines = list(dict.fromkeys(" ".join(word() for _ in range(rng.integers(5, 11))) for _ in range(600)))
    df = spark.createDataFrame([(0, i, 0, t, i, i) for i, t in enumerate(lines)], "doc_id long, rid long, pos int, norm string, h1 long, h2 long")
    units = linededup.compared(df, 5).where("by_chars")
    # Common runs of five characters make nearly every line of this kind a candidate for most others.
    m = [r["count"] for r in linededup.shared_keys(units, 0.9).groupBy("key").count().collect()]
    assert sum(x * (x - 1) // 2 for x in m) < 600


def test_segments_are_brute_force(spark):
    rng = np.random.default_rng(13)
    lines = []
    for size in [10, 19, 20, 33, 59, 60, 90, 108, 109, 118, 120, 121, 126, 133, 140] * 4:
        base = "".join(rng.choice(list("abc"), size))
        for _ in range(3):
            w, left = list(base), size // 10
            while left > 0:
                run = int(rng.integers(1, left + 1))
                at, kind = int(rng.integers(0, len(w))), rng.integers(3)
                w[at : at + run * (kind < 2)] = list(rng.choice(list("abc"), run)) if kind else []
                left -= run
            lines += [base, "".join(w)]
    lines = [t for t in dict.fromkeys(lines) if len(t) > 5]
    df = spark.createDataFrame([(i, " ".join(t), True) for i, t in enumerate(lines)], "h1 long, norm string, by_chars boolean")
    own = {}
    for r in linededup.shared_keys(df, 0.9).collect():
        own.setdefault(r.key, []).append((r.h1, r.own))
    met = {(min(a, b), max(a, b)) for rows in own.values() for a, x in rows for b, y in rows if a != b and (x or y)}
    near = [(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= max(len(lines[i]), len(lines[j])) // 10]
    similar = {(i, j) for i, j in near if word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) // 10}
    assert len(similar) > 150 and similar <= met


def test_simhash_is_brute_force(spark):
    lines = ["alpha beta gamma delta", "alpha beta gamma omega of to", "one only three four five six seven"]
    df = spark.createDataFrame([(0, i, 0, t, i, i) for i, t in enumerate(lines)], "doc_id long, rid long, pos int, norm string, h1 long, h2 long")
    got = {r.h1: r.code & (2**64 - 1) for r in linededup.simhashes(df).collect()}
    words = sorted({w for t in lines for w in t.split()})
    h = {w: x.h & (2**64 - 1) for w, x in zip(words, spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").orderBy("w").collect())}
    for i, t in enumerate(lines):
        own = [h[w] for w in t.split() if len(w) >= 4]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


def word_edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def test_line_bounds_lose_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    lines = []
    for size in (10, 11, 25, 60):
        base = [f"w{rng.integers(900)}ord"[: rng.integers(3, 8)] for _ in range(size)]
        for n_edits in (0, 1, 1, 2, 3, 5, 6, 7):
            w = list(base)
            for _ in range(n_edits):
                k = int(rng.integers(len(w)))
                kind = rng.integers(3)
                w[k : k + (kind > 0)] = [] if kind == 2 else [f"new{rng.integers(99)}"]
            lines.append(w)
    df = spark.createDataFrame([(0, i, 0, " ".join(w), i, i) for i, w in enumerate(lines)], "doc_id long, rid long, pos int, norm string, h1 long, h2 long")
    codes = linededup.simhashes(df)
    got = {r.h1: r for r in codes.collect()}
    assert all(got[i].words == len(w) for i, w in enumerate(lines) if i in got) and len(got) > 25
    texts = linededup.spelled(df, df.selectExpr("h1 AS a", "h1 AS b"))
    codes = codes.join(linededup.wide_parity(texts), "h1")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pairs = codes.alias("a").crossJoin(codes.alias("b")).where("a.h1 < b.h1").where(linededup._close(a, b, 64, 0.9))
    narrow = pairs.count()
    pairs = pairs.where(linededup._close_in_words(a, b, 0.9))
    assert pairs.count() < narrow
    kept = {(r[0], r[1]) for r in pairs.selectExpr("a.h1", "b.h1").collect()}
    similar = {(i, j) for i in got for j in got if i < j and word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) * 0.1 + 1e-9}
    assert len(similar) > 10 and similar <= kept and len(kept) < len(got) * (len(got) - 1) / 4


def test_similar_lines_are_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = [["left", "right"] * 10, ["left", "right"] * 9 + ["left", "none"], ["x", "y"] * 10, ["x", "y"] * 9 + ["x", "z"]]
    for size in (10, 15, 19, 25, 39, 60, 100):
        for _ in range(3):
            base = [f"word{rng.integers(300)}" for _ in range(size)]
            for n_edits in (0, 1, size // 10, size // 10, size // 10 + 1):
                w = list(base)
                for k in sorted(rng.choice(size, n_edits, replace=False).tolist(), reverse=True):
                    kind = rng.integers(3)
                    w[k : k + (kind > 0)] = [] if kind == 2 else [f"new{rng.integers(99)}"]
                if len(w) >= 10:
                    lines.append(w)
    lines = [t.split() for t in dict.fromkeys(" ".join(w) for w in lines)]
    df = spark.createDataFrame([(0, i, 0, " ".join(w), i, i) for i, w in enumerate(lines)], "doc_id long, rid long, pos int, norm string, h1 long, h2 long")
    links = linededup.similar_lines(df, linededup.simhashes(df), 0.9)
    got = {r.node: r.component for r in components(spark, links).collect()}
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) * 0.1 + 1e-9}
    assert len(similar) > 60 and all(got.get(i, -1) == got.get(j, -2) for i, j in similar)
    assert {(min(r), max(r)) for r in links.collect()} <= similar


def test_parity_of_characters_tells_anagrams_apart(spark):
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcdefghij_"), 60)) for _ in range(6)]
    for base in list(lines):
        lines.append("".join(rng.permutation(list(base))))
        for n_edits in (1, 3, 6):
            w = list(base)
            for _ in range(n_edits):
                k, kind = int(rng.integers(len(w))), rng.integers(3)
                w[k : k + (kind > 0)] = [] if kind == 2 else ["z"]
            lines.append("".join(w))
    df = spark.createDataFrame([(i, t, len(t), True) for i, t in enumerate(lines)], "h1 long, t string, words int, by_chars boolean")
    c = linededup.wide_parity(df).join(df, "h1")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    kept = {tuple(r) for r in c.alias("a").crossJoin(c.alias("b")).where("a.h1 < b.h1").where(linededup._close_in_words(a, b, 0.9)).select("a.h1", "b.h1").collect()}
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) // 10}
    anagrams = {(i, 6 + 4 * i) for i in range(6)}
    assert len(similar) > 12 and similar <= kept and not anagrams & kept


def test_large_group_of_near_copies_is_not_paired_out(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [f"word{i}" for i in range(60)]
    lines = []
    for n_edits in [3] * 110 + [4] * 30:
        w = list(base)
        for k in rng.choice(60, n_edits, replace=False).tolist():
            w[k] = f"new{rng.integers(10**6)}"
        lines.append(w)
    seen, real = [], linededup.verified
    monkeypatch.setattr(linededup, "verified", lambda texts, pairs, similarity: seen.append(pairs.count()) or real(texts, pairs, similarity))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "h1 long, norm string")
    got = {r.node: r.component for r in components(spark, linededup.similar_lines(df, None, 0.9)).collect()}
    similar = [(i, j) for j in range(len(lines)) for i in range(j) if sum(x != y for x, y in zip(lines[i], lines[j])) <= 6]
    assert len(similar) > 5000 and all(got[i] == got[j] for i, j in similar)
    assert seen[-1] < 2 * len(lines)


def test_packing_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["hello world", None, "", "é ñ ß ​ 日本", "abc " * 5000, "x", "x"]
    rows = packing.pack(docs(spark, texts), keep_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids and all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == sum(q.length for q in own[: r.piece]) for r in own)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_solver_uses_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 2049, 3000), return_counts=True))}
    used: dict[int, int] = {}
    sequences = 0
    for lengths, times in packing.solve(counts):
        assert sum(lengths) <= 2048
        sequences += times
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts and sequences <= -(-sum(k * v for k, v in counts.items()) // 2048) * 1.05 + 1


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, block=100).toPandas()
    w, found = v.astype(float), 0
    for q in range(0, 400, 20):
        s = sum(w[q, j] * w[:, j] for j in range(16))
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert (mine.score.to_numpy() == s[mine.vec_id.to_numpy()]).all()
        found += len(set(want) & set(mine.vec_id))
    assert set(got.query_id) == set(range(0, 400, 20)) and found >= 0.9 * 400
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_pseudonyms(spark):
    texts = ["pay 4111111111111111 or 4111111111111112 from 10.0.0.1 on 2024-02-29, +1 (415) 555-1234", "4111111111111111", None, "", "no 999.1.1.1 1.2.3.4.5 2023-02-30"]
    df = docs(spark, texts)
    made = pii.pseudonymise(df)
    got = made.orderBy("doc_id").collect()
    assert [r.n_pii for r in got] == [4, 1, 0, 0, 0] and got[4].text == texts[4] and got[2].text is None
    assert got[1].text in got[0].text and "4111111111111112" in got[0].text and "10.0.0.1" not in got[0].text
    digits = [int(c) for c in got[1].text][::-1]
    assert len(digits) == 16 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert [r.text for r in pii.pseudonymise(made.select(df.columns), inverse=True).orderBy("doc_id").collect()] == texts


def test_urls(spark):
    page = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.org/x", page.format("http://b.net/es/1")), (2, "http://b.net/es/1", None), (3, "http://www.example.com/en/1", page.format("http://b.net/es/1")),
        (4, "HTTP://M.Example.COM/en/?q", None), (5, None, None), (6, "mailto:x", ""), (7, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'), (8, "http://d.org", None),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), urlfilter.RULES).collect()}
    assert got == {1: (None, "block"), 2: ("net/es/", "block"), 3: ("www.example.com/en/", "allow"), 4: ("example.com/en/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow")}


def test_chats(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("b", "calculate", {"expression": {"$ref": "a"}}), ("a", "search", {"query": 5}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": 2})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": 2})), (1, 4, "assistant", "{broken"), (1, 5, None, None),
        (2, 0, "assistant", call(("p", "x", {"v": {"$ref": "q"}}), ("q", "x", {"v": {"$ref": "p"}}))),
    ]
    got = {(r.conv_id, r.turn, r.item): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.SCHEMAS).collect()}
    assert got[1, 1, 0].status == "linked" and got[1, 1, 0].depth > got[1, 1, 1].depth and got[1, 2, 0].anchor_turn == 1 and got[1, 2, 0].depth > got[1, 1, 0].depth
    assert got[1, 1, 1].error == "$.query: not of type string" and got[1, 1, 1].status == "open" and got[1, 3, 0].status == "orphan" and got[1, 4, 0].kind == "message"
    assert got[2, 0, 0].status == got[2, 0, 1].status == "circular" and got[1, 0, 0].json == '{"content":"hi","role":"user"}'


def test_licenses(spark):
    permission = licenses.TEMPLATES["MIT"][1]
    texts = [f"some words before it. {permission} and after", "Code Licensed under CC BY-NC 4.0. and more", "nothing here", None, "", "w " * 5000 + "Released under the MIT License."]
    got = [(r.doc_id, r.license, r.word) for r in licenses.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(0, "MIT", 4), (1, "CC-BY-NC-4.0", 1), (5, "MIT", 5000)]


def test_toxicity_restores(spark):
    d = "/root/testdata/sf0.01"
    lm = toxicity.language_model(spark.read.parquet(f"{d}/documents.parquet"))
    for disguise, word in {"1d10t": "idiot", "m0r0n": "moron", "stuuupid": "stupid", "i.d.i.o.t": "idiot", "l0$er": "loser"}.items():
        assert word in toxicity.restored(disguise, lm)
    assert toxicity.restore("i d i o t", lm) == "idiot"


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    from vertexloom.llm.toxicity import op4_toxicity

    got = op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    none = toxicity.toxicity(docs(spark, [None, "", "text"]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.predicted for r in none] == [0, 0, 0]
