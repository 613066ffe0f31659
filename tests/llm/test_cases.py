"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and brute-force versions of what small rows don't hold."""

import json
import zlib

import numpy as np
import pytest

from vertexloom.llm import ann, chat, decontaminate, jaccard, licenses, linededup, packing, pii, toxicity, urlfilter


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_special_tokens_are_those_of_the_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>é 日本 <|endoftext", "plain", "<|endoftext|>" * 3000]
    rows = packing.pack(docs(spark, texts), keep_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == t.encode(text, add_special_tokens=False).ids + [0]
    assert packing.pack(docs(spark, texts).where("false")).count() == 0


def test_chats_that_are_odd(spark):
    call = lambda *c: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), x)) for x in c]})
    ref = lambda i: {"$ref": i}
    deep = '{"tool_calls":[{"id":"d","name":"search","arguments":' + "[" * 3000 + "]" * 3000 + "}]}"
    rows = [
        (1, 0, "assistant", call(("n", ["x"], {}))), (1, 1, "assistant", '{"tool_calls":[{"id":"s","name":"search","arguments":{"query":"\\ud800"}}]}'),
        (1, 2, "assistant", deep), (1, 3, "assistant", '{"tool_calls":[{"id":"q","name":"x","arguments":NaN}]}'), (1, 4, "tool", "[1]"), (1, 5, "assistant", "{}"),
        (2, 0, "assistant", call(("a", "x", ref("b")), ("b", "x", ref("a")), ("w", "x", ref("a")), ("v", "x", ref("w")))),
        (None, 0, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS item", "'z' AS kind", "2 AS depth")
    got = {(r.conv_id, r.turn, r.item): r for r in chat.format_chats(df, chat.SCHEMAS).collect()}
    assert got[1, 0, 0].error == "unknown tool" and "\\ud800" in got[1, 1, 0].json
    assert all(got[1, t, 0].kind == "message" for t in (2, 3, 4, 5)) and json.loads(got[1, 2, 0].json)["content"] == deep
    assert [got[2, 0, k].status for k in range(4)] == ["circular", "circular", "open", "open"] and got[None, 0, 0].status == "orphan"
    assert chat.format_chats(df.where("false"), chat.SCHEMAS).count() == 0


def test_chats_are_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, calls = [], {}
    for conv in range(6):
        for k in range(12):
            use = [{"$ref": f"c{j}"} for j in rng.integers(0, 14, rng.integers(0, 3)) if j != k and (j < k or conv % 2)]
            calls[conv, k] = [int(u["$ref"][1:]) for u in use]
            rows.append((conv, 2 * k, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "x", "arguments": use}]})))
            if rng.random() < 0.5:
                rows.append((conv, 2 * k + 1, "tool", json.dumps({"tool_call_id": f"c{k}", "content": "r"})))
    answered = {(c, json.loads(t)["tool_call_id"]) for c, _, role, t in rows if role == "tool"}
    got = {(r.conv_id, r.call_id): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()}

    def reach(conv, k):
        seen, todo = set(), list(calls[conv, k])
        while todo:
            j = todo.pop()
            if j < 12 and j not in seen:
                seen.add(j)
                todo += calls[conv, j]
        return seen

    for (conv, k), use in calls.items():
        mine, up = got[conv, f"c{k}"], reach(conv, k)
        rings = {j for j in range(12) if j in reach(conv, j)}
        # In a circle, or on the way from one circle to another.
        circular = k in rings or bool(up & rings and any(k in reach(conv, j) for j in rings))
        assert mine.status == ("circular" if circular else "linked" if (conv, f"c{k}") in answered else "open")
        if not up & rings and k not in rings:
            assert all(got[conv, f"c{j}"].depth < mine.depth for j in use if j < 12)


def test_licenses_by_row(spark):
    text = "Released under the MIT License. " + "w " * 20000 + "Licensed under CC BY-NC 4.0"
    df = docs(spark, [text, text, None, text, ""], [1, 1, 2, None, 3]).selectExpr("*", "1 AS license", "2 AS word")
    got = licenses.scan_licenses(df, summary=True).collect()
    assert sorted((str(r.doc_id), r.n_matches, r.licenses) for r in got) == sorted([("1", 2, "CC-BY-NC-4.0,MIT")] * 2 + [("2", 0, ""), ("None", 2, "CC-BY-NC-4.0,MIT"), ("3", 0, "")])
    assert licenses.scan_licenses(df.where("false"), summary=True).count() == 0


def test_licenses_are_brute_force(spark):
    rng = np.random.default_rng(6)
    wanted = {n: [t for t in ts if len(t.split()) > 8] for n, ts in licenses.TEMPLATES.items()}
    texts = []
    for _ in range(60):
        w = [f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 40))]
        for _ in range(rng.integers(0, 3)):
            name = rng.choice([n for n in wanted if wanted[n]])
            t = wanted[name][0].split()
            for k in rng.integers(0, len(t), rng.integers(0, 3)):
                t[k] = "other"
            w += t + [f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 40))]
        texts.append(" ".join(w))
    grams = lambda t: {tuple(x) for w in [[y.strip(licenses.TRIM) for y in t.lower().split()]] for x in zip(*(w[k:] for k in range(5)))}
    want = {(i, n) for i, t in enumerate(texts) for n, ts in wanted.items() for x in ts if len(grams(x) & grams(t)) >= 0.75 * len(grams(x))}
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs(spark, texts), wanted).collect()}
    assert got == want and len(got) > 20


def test_viterbi_in_both_forms():
    rng = np.random.default_rng(4)
    lm = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    for token in ("1d10t", "sstuupid", "l0$er", "i.d-i o_t", "h3ll0|", "", "ж", "a" * 40):
        assert toxicity.restore(token, lm) == toxicity.restore_by_arrays(token, lm)
    short = toxicity.restore_by_arrays("b*d", lm)
    every = [("b" + c + "d", lm[0, 0, 2] + lm[0, 2, k] + lm[2, k, 4] + lm[k, 4, 0] - toxicity.WILD) for k, c in enumerate(toxicity.ALPHABET) if "a" <= c <= "z"]
    none = ("bd", lm[0, 0, 2] + lm[0, 2, 4] + lm[2, 4, 0] - toxicity.DROP_SEPARATOR)
    assert short == max([*every, none], key=lambda x: x[1])[0]
    long = "ab" * 3000
    assert toxicity.restore(long, lm) == long


def test_nearest_with_repeats(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((90, 70)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (40, v[41].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS block", "3 AS q")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 3, block=30).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((i, r) for i in (0, 20, 40, 40, 60, 80) for r in (1, 2, 3))
    every = np.concatenate([v, v[[20, 41]]])
    ids = np.array([r[0] for r in rows])
    for q in (0, 60, 80):
        s = sum(v[q, j] * every[:, j] for j in range(70))
        s[ids == q] = -np.inf
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == ids[np.lexsort((ids, -s))[:3]].tolist()


def test_jaccard_nulls_and_repeats(spark):
    base = [f"word{i}" for i in range(60)]
    near = [*base[:58], "new", "words"]
    texts = [" ".join(base), " ".join(near), " ".join(near), " ".join(base), None, "", "only three words", "only three words"]
    df = docs(spark, texts, [5, None, None, 5, 6, 7, None, None]).selectExpr("*", "1 AS n", "2 AS sig", "3 AS key")
    got = jaccard.jaccard_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("5", 56, "5")] * 2 + [("None", 56, "5")] * 2 + [("6", 0, "6"), ("7", 0, "7")] + [("None", 1, "None")] * 2)


def test_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = []
    for size in (20, 60, 200):
        base = [f"v{k}" for k in rng.integers(0, 5000, size)]
        for edits in rng.integers(0, size // 12, 40):
            w = list(base)
            for k in rng.integers(0, size, edits):
                w[k] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{i}x{k}" for k in range(25 + i)) for i in range(30)]
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    got = jaccard.jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == up


def test_links_of_pages(spark):
    base = "http://a.org/d/x?k=1#f"
    # References and what RFC 3986 makes of them on this page.
    want = {
        "y.html": "http://a.org/d/y.html", "/r?u=http://b.net/es/1": "http://a.org/r?u=http://b.net/es/1", "//B.net/es/": "http://B.net/es/", "?q=2": "http://a.org/d/x?q=2",
        "../up": "http://a.org/up", "./a/../b/./c": "http://a.org/d/b/c", "../../..": "http://a.org/", ".": "http://a.org/d/", "https://c.org/z?a=1&amp;b=2": "https://c.org/z?a=1&b=2", "#part": None, "mailto:x@y": "mailto:x@y",
    }
    rows = [(i, base, f"<LINK href='{to}' rel=canonical>") for i, to in enumerate(want)]
    got = {r.url + str(i): r for i, r in enumerate(urlfilter.links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())}
    assert sorted(r.to for r in got.values()) == sorted(x for x in want.values() if x)
    two = '<link rel="canonical" href="http://A.org/one"><link rel="canonical" href="/two"><meta http-equiv="refresh" content="0;url=three">'
    pages = [(1, "http://a.ORG/x", two), (2, "HTTP://a.org/one#top", None), (3, "http://a.org/two", ""), (4, "http://a.org/three", "x" * 300000), (5, "http://a.org/fr", None), (6, None, two), (6, None, two)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS to")
    rules = [("a.org", "/three", "block"), ("a.org", "/two", "allow")]
    got = [(r.page_id, r.verdict) for r in urlfilter.judge(df, rules).orderBy("page_id").collect()]
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (6, "allow")]
    assert urlfilter.judge(df.where("false"), rules).count() == 0


def test_aliases_are_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 60
    url = [f"http://h{i % 7}.{'net' if i % 5 == 0 else 'org'}/p{i}" for i in range(n)]
    to = {i: sorted(set(rng.integers(0, n, rng.integers(0, 3)).tolist())) for i in range(n)}
    rows = [(i, url[i], "".join(f'<link rel="canonical" href="{url[j]}">' for j in to[i])) for i in range(n)]
    group = list(range(n))
    for i, js in to.items():
        for j in js:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    rules = [("net", "/", "block"), ("h3.net", "/", "allow"), ("h2.org", "/", "allow")]
    ruled = [next((v for h, _, v in sorted(rules, key=lambda r: -len(r[0])) if f".{u.split('/')[2]}".endswith("." + h)), None) for u in url]
    bad = {group[i] for i in range(n) if ruled[i] == "block"}
    want = {i: ruled[i] or ("block" if group[i] in bad else "allow") for i in range(n)}
    assert {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()} == want


def test_pseudonyms_of_odd_tables(spark):
    df = docs(spark, ["4111111111111111 " + "x " * 50000, None, ""], [1, None, 1])
    got = pii.pseudonymise(df).orderBy("n_chars").collect()
    assert len(got) == 3 and max(r.n_pii for r in got) == 1 and pii.pseudonymise(df.where("false")).count() == 0


def test_pseudonyms_keep_columns_of_clashing_names(spark):
    rows = [(1, "on 2020-02-03", "a", "b", "c", 9), (2, "nothing", None, "e", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__old` string, `__OLD1` string, `__new` string, N_PII long")
    got = pii.pseudonymise(df).orderBy("doc_id")
    plain = pii.pseudonymise(df.select("doc_id", "text")).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "__old", "__OLD1", "__new", "n_pii"]
    assert [tuple(r)[2:5] for r in got.collect()] == [r[2:5] for r in rows]
    assert got.select("doc_id", "text", "n_pii").collect() == plain.collect()


def test_contamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20))), (2, "c1 c2 c3")], "item_id long, text string")
    long = "w " * 30000 + " ".join(f"b{k}" for k in range(3, 18))
    df = docs(spark, [long, long, None, "c1 c2 c3", ""], [1, 1, None, None, 4])
    got = decontaminate.decontaminate(df, items).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.contaminated, r.holds_window) for r in got) == sorted(
        [("1", 15, False, True)] * 2 + [("None", 3, True, False), ("None", 3, True, False), ("4", 0, False, False)])
    assert decontaminate.decontaminate(df.where("false"), items).count() == 0
    assert decontaminate.decontaminate(df, items.where("false")).where("n_hit > 0").count() == 0


def test_lines_keep_other_columns(spark):
    line = "this is a line of some nine words here"
    df = docs(spark, [line, line, None]).selectExpr("*", "1 AS key", "'x' AS gone", "2 AS rid", "3 AS some", "99 AS n_removed")
    got = linededup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.key, r.gone, r.rid, r.some, r.n_removed, r.n_lines) for r in got] == [(line, 1, "x", 2, 3, 0, 1), ("", 1, "x", 2, 3, 1, 1), (None, 1, "x", 2, 3, 0, 0)]


def test_crc_of_pieces(spark):
    rows = packing.pack(docs(spark, ["some text", "some text"], [3, 3]), keep_ids=True).collect()
    assert len(rows) == 2 and all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows) and {r.offset for r in rows} == {0, len(rows[0].ids)}
