"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index stores posting lists (term, doc_id, pos) with the words around each
posting. A phrase search takes the two rarest terms of every test window, reads
only their lists, shifts each posting by the term's place in the window and
keeps the starts on which both lists agree; the stored words then prove the
match. A proximity search intersects the lists of all of a query's terms within
a slop around its rarest term.

Defined results: a null or empty text has no words; an item without words
matches nothing; an item with a null item_id can contaminate but is not
counted or listed; rows that share a doc_id share their hits; columns other
than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm.shared import ascii_lower, sized, stored, table

#: Separators: ASCII but for digits and letters. Listed one by one, Java looks them up in a table; as ranges it tests range after range, 20 times slower.
SEPARATORS = "".join(rf"\x{c:02x}" for c in range(128) if not chr(c).isalnum())
WINDOW = 13


def words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), f"[{SEPARATORS}]+"), "")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of terms(term) occurs in all texts: (term, freq)."""
    n = terms.count()
    found = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return found.join(sized(terms, n), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))


def build_postings(docs: DataFrame, terms: DataFrame | None = None, reach: int = WINDOW - 1) -> DataFrame:
    """Posting lists (term, doc_id, pos, ctx_from, ctx): ctx holds the words from pos - reach to pos + reach.

    With terms(term), the lists of these terms alone: the others would never be read.
    """
    ws = docs.select("doc_id", words(F.col("text")).alias("ws"))
    at = ws.select("doc_id", "ws", F.posexplode("ws").alias("pos", "term"))
    if terms is not None:
        at = at.join(sized(terms, terms.count()), "term", "left_semi")
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    return at.select("term", "doc_id", "pos", start.alias("ctx_from"), F.slice("ws", start + 1, F.col("pos") - start + 1 + reach).alias("ctx"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, iid, ws, s, m): every window of m words from s; an item shorter than size is one window."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    ws = ws.select("item_id", F.xxhash64("item_id", "ws").alias("iid"), "ws").dropDuplicates(["iid"])
    m = F.least(F.size("ws"), F.lit(size))
    return ws.select("item_id", "iid", "ws", m.alias("m"), F.explode(F.sequence(F.lit(0), F.size("ws") - m)).alias("s"))


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every occurrence of an item's window in a document: (doc_id, item_id, start, m), start counted in words."""
    win = stored(windows(items, size))
    ids = win.select("item_id", "iid", "ws").dropDuplicates(["iid"])
    terms = win.select(F.explode("ws").alias("term")).distinct()
    freq = stored(term_counts(docs, stored(terms)))
    each = win.select("iid", "s", "m", F.posexplode(F.slice("ws", F.col("s") + 1, F.col("m"))).alias("k", "term"))
    each = each.join(freq, "term", "left").withColumn("apos", F.col("s") + F.col("k"))
    # The terms of a window by rarity; a window with a term that no document has is out.
    rank = F.row_number().over(Window.partitionBy("iid", "s").orderBy("freq", "term", "apos"))
    rare = each.withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("rank", rank)
    two = rare.where("rank <= 2").groupBy("iid", "s", "m").agg(
        F.min("freq").alias("least"), *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("apos", "term")]
    )
    two = stored(two.where("least > 0").withColumn("apos2", F.coalesce("apos2", "apos1")).withColumn("term2", F.coalesce("term2", "term1")))
    first = two.groupBy(F.col("term1").alias("term"), "iid", F.col("apos1").alias("apos")).agg(F.collect_list(F.struct("s", "m", "apos2")).alias("wins"))
    second = two.select(F.col("term2").alias("term"), "iid", F.col("apos2").alias("apos"), F.array().cast("array<struct<s:int,m:int,apos2:int>>").alias("wins"))
    anchors = stored(first.unionByName(second))
    n = anchors.count()
    lists = stored(build_postings(docs, anchors.select("term").distinct(), size - 1))
    # Shifted by the term's place in the item, postings of one occurrence agree.
    found = lists.join(sized(anchors, n), "term").select(
        "doc_id", "iid", (F.col("pos") - F.col("apos")).alias("delta"), "apos", F.struct("ctx_from", "ctx", "wins").alias("of"))
    agree = found.groupBy("doc_id", "iid", "delta").agg(F.collect_set("apos").alias("held"), F.collect_list(F.when(F.size("of.wins") > 0, F.col("of"))).alias("ofs"))
    starts = agree.select("doc_id", "iid", "delta", "held", F.explode("ofs").alias("of")).select("doc_id", "iid", "delta", "held", "of.ctx_from", "of.ctx", F.explode("of.wins").alias("w"))
    starts = starts.where("array_contains(held, w.apos2) AND delta + w.s >= ctx_from")
    same = F.slice("ctx", F.col("delta") + F.col("w.s") - F.col("ctx_from") + 1, F.col("w.m")) == F.slice("ws", F.col("w.s") + 1, F.col("w.m"))
    hit = starts.join(sized(ids, n), "iid").where(same)
    return hit.select("doc_id", "item_id", (F.col("delta") + F.col("w.s")).alias("start"), F.col("w.m").alias("m")).distinct()


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int = 8) -> DataFrame:
    """Places where all distinct words of a query(item_id, text) stand within slop words of its rarest one.

    Returns (doc_id, item_id, pos), pos being a place of the rarest word.
    """
    q = queries.select("item_id", F.array_distinct(words(F.col("text"))).alias("ws")).where(F.size("ws") > 0)
    t = stored(q.select("item_id", F.size("ws").alias("need"), F.explode("ws").alias("term")))
    freq = term_counts(docs, t.select("term").distinct())
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("freq", F.lit(0)), "term"))
    rare = t.join(freq, "term", "left").withColumn("rank", rank).where("rank = 1").select("item_id", "need", "term")
    at = build_postings(docs, rare.select("term").distinct(), slop).join(rare, "term")
    near = at.join(q, "item_id").where(F.size(F.array_intersect("ws", "ctx")) == F.col("need"))
    return near.select("doc_id", "item_id", "pos").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row for each document row: n_words, n_hit (words inside any match), n_items, items_sha256, contaminated, holds_window.

    A document is contaminated if at least one in share of its words is hit; holds_window says whether a match is of size words.
    """
    m = stored(phrase_matches(docs, items, size))
    spans = m.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("at"))
    hit = spans.distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    whole = m.groupBy(F.col("doc_id").alias("w")).agg(F.max(F.col("m") >= size).alias("holds_window"))
    ids = m.select("doc_id", F.col("item_id").cast("string").alias("i")).distinct().groupBy("doc_id").agg(
        F.count("i").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("i")), ","), 256).alias("items_sha256"))
    per = hit.withColumnRenamed("doc_id", "d").join(ids.withColumnRenamed("doc_id", "e"), F.expr("d <=> e")).drop("e").join(whole, F.expr("d <=> w")).drop("w")
    base = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(f"[^{SEPARATORS}]+")), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(per, F.expr("doc_id <=> d"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("holds_window", F.lit(False)).alias("holds_window"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("holds_window")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT item_id, least(len(ws), 13) AS m, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM b WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM w),
g AS (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS g
      FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, ms WHERE len(ws) >= m)),
h AS (SELECT DISTINCT doc_id, p, g.m AS m, item_id FROM g JOIN w ON g.m = w.m AND g.g = w.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS k FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
