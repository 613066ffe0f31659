"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct word 5-grams, held as 64-bit tokens: 6 bits
for how long the words are, long ones first, then 58 bits of a hash. Documents of
equal sets are one class from the start. Two sets that reach the similarity share
a token among each one's first n - ceil(t * n) + 1 tokens under *any* global
order. The first order is that of the tokens, with those of many documents last,
by rising frequency; it is joined through posting lists, of which only those with
two classes or more are kept. Sizes, places in the prefixes and the number of
prefix tokens a pair shares bound its overlap. The pairs left must share prefix
tokens under two further orders as well, before any whole set moves; those that
do are verified on the whole sets.

Of the tokens that a pair shares one is the first, and from there on either set
must still hold the whole overlap. So the last pairing meets two sets only at
tokens that are early enough in both, not at every token of a common passage.

Groups of copies are not expanded into pairs: in every posting list, classes
are first tried against one hub, the one that has fewest tokens of its own, and
united, a few times over; only pairs between classes still apart are then made.
So each link is found or already implied by others.

Defined results: a null text, or one without words, has an empty set and no
links; rows with a null doc_id take the component of their class, which is null
if no row of it has an id; repeated rows come out as often as they come in;
other columns are ignored. Hashes of 58 bits stand for 5-grams, and two sums of
such tokens (128 bits) for a whole set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.shared import bitmap, components, dropped, maybe_in, sized, stored, table

GRAM = 5
#: A 5-gram is frequent if it makes up this share of all, and is in FEW documents at least; 1 / share of them can be, which take 72 MB.
FREQUENT = 2.0**-23
FEW = 16
#: Longs of a set's parity.
WIDE = 8
PARITY = [f"p{k}" for k in range(WIDE)]
#: Bits of a token that hold the hash.
HASHED = np.uint64(58)
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE, BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
#: One odd multiplier for each further order.
ORDERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranked(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of shingles with these hashes and so many bytes of words."""
    return ((63 - np.minimum(size, 63)).astype(np.uint64) << HASHED) | (h >> (np.uint64(64) - HASHED))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK), b)])) for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' tokens, ascending. Works on the bytes of many texts at once, a few MB at a time."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        b, o = data[at[i] : at[j]].copy(), at[i : j + 1] - at[i]
        i = j
        b[(b >= 65) & (b <= 90)] |= 32
        word = ~SPACE[b]
        before, after = np.zeros(len(b) + 1, bool), np.zeros(len(b) + 1, bool)
        before[1:], after[:-1] = word, word
        before[o], after[o] = False, False
        start = np.flatnonzero(word & ~before[:-1])
        end = np.flatnonzero(word & ~after[1:]) + 1
        up, down = powers(len(b))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        h = mix((total[end] - total[start]) * down[start])
        of = np.searchsorted(start, o)
        full = h[: max(0, len(h) - gram + 1)]
        for k in range(1, gram):
            full = full * STEP + h[k : k + len(full)]
        size = np.concatenate([[0], np.cumsum(end - start)])
        full = ranked(mix(full), size[gram:] - size[: len(full)]) if len(full) else full
        for a, z in zip(of[:-1], of[1:]):
            if z - a >= gram:
                yield np.unique(full[a : z - gram + 1])
            elif z > a:
                acc = np.uint64(z - a) + h[a : a + 1]
                for k in range(a + 1, z):
                    acc = acc * STEP + h[k : k + 1]
                yield ranked(mix(acc), size[z : z + 1] - size[a])
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, as signed longs."""
    return tuple(int(x.view(np.int64)) for x in (mix(s ^ STEP).sum(dtype=np.uint64), mix(s ^ BASE).sum(dtype=np.uint64)))


def parity(s: np.ndarray) -> list[int]:
    """For each of 64 * WIDE bits whether an odd number of tokens fall on it. Sets differ in as many tokens as parities in bits, at least."""
    odd = np.bincount((s & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


def survey(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s1, s2, n, and the PARITY) of every document, key being a hash of the row; and, with n null, (token as s1, count as s2) of what is frequent within a task."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        schema = [("doc_id", pa.int64()), ("key", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), *((c, pa.int64()) for c in PARITY)]
        seen, size, waiting = set(), 0, 0

        def often() -> list[tuple]:
            if not held:
                return []
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            ok = counts >= max(2, int(size * FREQUENT))
            return [(None, None, t, c, None, *[None] * WIDE) for t, c in zip(tokens[ok].view(np.int64).tolist(), counts[ok].tolist())]

        for batch in batches:
            out = []
            for doc_id, key, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1))):
                s1, s2 = signature(s)
                out.append((doc_id, key, s1, s2, len(s), *parity(s)))
                if s1 not in seen:
                    seen.add(s1)
                    held.append(s)
                    size += len(s)
                    waiting += len(s)
            yield _batch(out, schema)
            if waiting > 2_000_000:  # bounds a task's memory; counts of its parts are added up below
                yield _batch(often(), schema)
                held, size, waiting = [], 0, 0
        yield _batch(often(), schema)

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text")).mapInArrow(look, "doc_id long, key long, s1 long, s2 long, n long, " + ", ".join(f"{c} long" for c in PARITY))


def postings(docs: DataFrame, frequent, num: int, den: int) -> DataFrame:
    """(token, sig, n, i): the first order's prefix of every distinct set, i being the place there."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = frequent.value
        seen: set[int] = set()
        for batch in batches:
            tokens, sigs, sizes, places = [], [], [], []
            for s in shingle_sets(batch.column(0)):
                sig = signature(s)[0]
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                p = prefix(len(s), num, den)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.argsort(np.where(hot[k] == s, times[k], 0), kind="stable")]
                tokens.append(s[:p].view(np.int64))
                sigs.append(np.full(p, sig))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sigs, sizes, places)], ["token", "sig", "n", "i"])

    return docs.select("text").mapInArrow(emit, "token long, sig long, n int, i int")


def shared(lists: DataFrame) -> DataFrame:
    """Of sorted posting lists, those with two different sets or more, each set once."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, False  # the last row, and whether the row before it had its token
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols)]
            t, g = cols[:2]
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            cols = [x[new] for x in cols]
            same = cols[0][1:] == cols[0][:-1]
            prev, next_ = np.concatenate([[held], same]), np.concatenate([same, [False]])
            ok = (prev | next_)[:-1]
            last, held = [x[-1:] for x in cols], bool(prev[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][ok]) for x in cols], names)
        if last is not None and held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names)

    names = lists.columns
    return lists.repartition("token").sortWithinPartitions("token", "sig").mapInArrow(keep, lists.schema)


def alike(lists: DataFrame) -> DataFrame:
    """Of posting lists of the same sets, as the tokens of a common passage have them, the one of the first token in the order, with their number w: a pair meets once in them."""
    # All sets have the same order, so places in any one of them tell which token is first.
    each = lists.groupBy("token").agg(F.bit_xor(F.xxhash64("sig")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "sig")).alias("x2"), F.count("*").alias("size"), F.min(F.struct("sig", "i")).alias("at"))
    once = each.groupBy("x1", "x2", "size").agg(F.min(F.struct("at.i", "token"))["token"].alias("t"), F.count("*").alias("w"))
    return lists.join(once.select("t", "w"), F.col("token") == F.col("t")).drop("t")


def bounds(num: int, den: int) -> tuple[Callable, Callable, Callable]:
    """What sets of x and y tokens must pass to be similar: enough(overlap at most, x, y), reach(prefix tokens shared at most, x, y) and fits() at a shared token."""
    # Shared tokens that end the shorter reach are all among the m of both prefixes; the rest is at most one set's remainder.
    rest_of = lambda n: F.ceil(n * num / den) - 1

    def enough(most, x, y):
        return den * most >= num * (x + y - most)

    def reach(m, x, y):
        return enough(m + F.greatest(rest_of(x), rest_of(y)), x, y)

    def fits(x, y):
        """Whether a token at its places in both prefixes allows for the similarity."""
        before, after = F.least(x("i"), y("i")), F.least(x("n") - x("i"), y("n") - y("i"))
        return enough(before + after, x("n"), y("n"))

    return enough, reach, fits


def meetings(lists: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of sets in different groups g, among them all similar ones, a row for each list in which they meet."""
    enough, reach, _ = bounds(num, den)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # A pair can't share more tokens than either class has in the lists that are left, less those that parity tells apart.
    bit, lane = F.expr("shiftleft(1L, cast(token & 63 AS int))"), F.shiftrightunsigned("token", 6).bitwiseAND(F.lit(WIDE - 1))
    left = [F.bit_xor(F.when(lane == k, bit).otherwise(F.lit(0))).alias(f"q{k}") for k in range(WIDE)]
    most = lists.groupBy(F.col("sig").alias("s")).agg(F.count("*").cast("int").alias("c"), *left)
    whole = classes.select(F.col("s1").alias("k"), *PARITY)
    own = stored(alike(lists).join(most, F.col("sig") == F.col("s")).join(whole, F.col("sig") == F.col("k")).drop("s", "k", "w", "u"))
    apart = lambda cols: sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in cols), F.lit(0))
    common = F.least(a("c"), b("c"), F.floor((a("c") + b("c") - apart([f"q{k}" for k in range(WIDE)])) / 2))
    # The first token of all that a pair shares has the whole overlap behind it; alike() keeps that of its list.
    first = enough(F.least(a("n") - a("i"), b("n") - b("i")), a("n"), b("n"))
    # Sets of that similarity differ in (den - num) / (den + num) of their sizes' sum.
    close = first & reach(common, a("n"), b("n")) & ((den + num) * apart(PARITY) <= (den - num) * (a("n") + b("n")))
    pairs = own.alias("a").join(own.alias("b"), (a("token") == b("token")) & (a("sig") < b("sig")) & (a("g") != b("g")) & close)
    return pairs.select(a("sig").alias("a"), b("sig").alias("b"))


def fetched(docs: DataFrame, classes: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, s, o1, o2): the sets of sigs(sig), made anew from the texts, and their prefixes under the further orders, 32 bits a token."""
    reps = classes.join(sigs, classes.s1 == F.col("sig"), "left_semi").select(F.col("rep").alias("r")).distinct()
    reps = stored(reps.select("r", F.xxhash64("r").alias("h")))
    some = maybe_in(docs.withColumn("h", F.xxhash64("doc_id")), "h", bitmap(reps.select("h"), reps.count()), "some").where("some")
    texts = some.join(reps.select("r"), F.expr("doc_id <=> r"), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(0)):
                p = prefix(len(s), num, den)
                firsts = [(np.partition(s * odd, p - 1)[:p] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() if len(s) else [] for odd in ORDERS]
                rows.append((signature(s)[0], s.tobytes(), *firsts))
                if len(rows) == 256:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    schema = [("sig", pa.int64()), ("s", pa.binary()), ("o1", pa.list_(pa.int32())), ("o2", pa.list_(pa.int32()))]
    every = texts.mapInArrow(sets, "sig long, s binary, o1 array<int>, o2 array<int>").join(sigs, "sig", "left_semi")
    return stored(every.dropDuplicates(["sig"]))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) that pass the other orders' prefix filters and then reach num / den.

    A set moves once, to its partner b; a b with many partners is dealt over several keys, each with its set.
    """
    sigs = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    sets = fetched(docs, classes, sigs, num, den)
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("o1").alias(f"{c}1"), F.col("o2").alias(f"{c}2"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2"))
    pairs = stored(both.select("a", "b"))
    hubs = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("k")))
    member = pairs.join(hubs, "b").select(F.col("a").alias("sig"), F.col("b").alias("h"), F.pmod(F.xxhash64("a"), "k").cast("int").alias("salt"), F.lit(1).alias("kind"))
    hub = hubs.select(F.col("b").alias("sig"), F.col("b").alias("h"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("kind"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for batch in batches:
            out = []
            for sig, h, salt, kind, s in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if kind == 0:
                    key, held = (h, salt), s.copy()
                elif key == (h, salt) and den * min(len(s), len(held)) >= num * max(len(s), len(held)):
                    both = len(np.intersect1d(s, held, assume_unique=True))
                    if den * both >= num * (len(s) + len(held) - both):
                        out.append((sig, h))
            yield _batch(out, [("a", pa.int64()), ("b", pa.int64())])

    rows = sets.select("sig", "s").join(member.union(hub), "sig").select("sig", "h", "salt", "kind", "s")
    found = stored(rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "kind", "sig").mapInArrow(test, "a long, b long"))
    dropped(sigs, sets, pairs, hubs)
    return found


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, hub_rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, first_key) for every row of docs; links at Jaccard >= num / den.

    key is xxhash64(doc_id, text), first_key that of the component's first row by doc_id, nulls last, null for an empty set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = stored(survey(docs))
    each = seen.where("n IS NOT NULL")
    total = each.agg(F.sum("n")).first()[0] or 0
    often = seen.where("n IS NULL").groupBy("s1").agg(F.sum("s2").alias("m")).where(F.col("m") >= max(FEW, total * FREQUENT)).orderBy("s1").toPandas()
    tokens = often["s1"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[by], np.log2(np.maximum(often["m"].to_numpy(float), 1)).astype(np.uint8)[by]))
    classes = stored(each.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *PARITY)], F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    lists = stored(shared(postings(docs, frequent, num, den)))
    # A class whose prefix is shared most is the likeliest middle of a group of copies.
    own = lists.groupBy(F.col("sig").alias("s")).agg((F.first("n") - F.ceil(F.first("n") * num / den) + 1 - F.count("*")).cast("int").alias("u"))
    before, lists = lists, stored(lists.join(own, F.col("sig") == F.col("s")).drop("s").withColumn("g", F.col("sig")))
    dropped(before)
    _, reach, fits = bounds(num, den)
    tried = links = group = None
    nth = 0
    while nth <= hub_rounds:
        if nth < hub_rounds:
            hubs = lists.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min(F.struct("u", "sig", "n", "i", "g")).alias("hub")).where("lo <> hi")
            star = lists.join(hubs, "token").where((F.col("g") != F.col("hub.g")) & fits(F.col, lambda c: F.col("hub")[c]))
            star = star.select("sig", F.col("hub.sig").alias("h"), "n", F.col("hub.n").alias("hn"))
            # Here m misses tokens with another hub: what this leaves out is found when the rest is paired.
            star = star.groupBy("sig", "h", "n", "hn").agg(F.count("*").alias("m")).where(reach(F.col("m"), F.col("n"), F.col("hn")))
            pairs = star if tried is None else star.join(tried.select(F.col("a").alias("sig"), F.col("b").alias("h")), ["sig", "h"], "left_anti")
            pairs = pairs.groupBy("sig").agg(F.max_by("h", F.struct("m", "h")).alias("b")).select(F.col("sig").alias("a"), "b")
        else:
            pairs = meetings(lists, classes, num, den).distinct()
            pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():  # no hub is left to try, or nothing at all
            nth = hub_rounds if nth < hub_rounds else nth + 1
            continue
        nth += 1
        found = verified(docs, classes, pairs, num, den)
        both = pairs.union(pairs.select("b", "a"))
        tried = both if tried is None else tried.union(both)
        links = found if links is None else links.union(found)
        group = stored(components(spark, links))
        if nth <= hub_rounds:
            now = lists.drop("g").join(sized(group, group.count()), F.col("sig") == F.col("node"), "left").withColumn("g", F.coalesce("component", "sig")).drop("node", "component")
            open_ = now.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token")
            before, lists = lists, stored(now.join(open_, "token", "left_semi"))
            dropped(before)
    dropped(lists)
    group = group if group is not None else spark.createDataFrame([], "node long, component long")
    n = group.count()
    named = classes.join(sized(group, n), classes.s1 == group.node, "left").select("s1", "s2", "first", F.coalesce("component", "s1").alias("g"))
    least = named.groupBy("g").agg(F.min("first").alias("least"))
    out = named.join(least, "g").select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first_key"))
    out = each.join(out, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", "first_key")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM s) WHERE df > 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (WITH RECURSIVE t(node, seen) AS (SELECT x, x FROM e UNION SELECT t.node, e.y FROM t JOIN e ON t.seen = e.x) SELECT node, min(seen) AS component_id FROM t GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node
"""
