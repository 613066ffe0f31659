"""Best-fit packing by exact-complement hashing.

Documents are tokenised, ended with id 0 and, if longer than a sequence, cut
into full pieces, the first of which may be shorter. What decides a packing is
only how many pieces have each length, so the solver works on that histogram:
at most ``capacity`` rows whatever the corpus. It fills the gap that a length
leaves exactly by one, two or three lengths found through an index of single,
pair and triple sums under the counts still available, and packs what has no
exact complement by best fit. Each solution row is a pattern with a number of
repetitions; pieces find their place in it by their rank within their length.

Defined results: a null text is empty (one piece of id 0); repeated rows are
packed each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm.shared import stored, table

CAPACITY = 2048
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """A function from text to ids. tiktoken gives the ids that tokenizers gives, special tokens in the text included (tests hold them equal), in a quarter of the time."""
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(P.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)
        names = list(special)
        _encoders[vocabulary] = lambda text: own.encode(text, allowed_special="all") if any(s in text for s in names) else own.encode_ordinary(text)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, shard, nth[, ids]): nth counts a shard's pieces of equal length."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocabulary), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            owner, all_ids = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [0], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    owner.append(k)
                    for c, v in zip(rows, (piece, a, b - a, crc32(ids[a:b].tobytes()), shard, seen[b - a])):
                        c.append(v)
                    seen[b - a] += 1
                    if keep_ids:
                        all_ids.append(ids[a:b].astype(np.int32))
            cols = [batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"]
            if keep_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, shard int, nth long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class _Counts:
    """Available counts by length, with the sum lookups on them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2:
            return None
        a = np.arange((gap + 1) // 2, gap)
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0) & ((a * 2 != gap) | (self.n[a] > 1))
        return (int(a[k]), int(gap - a[k])) if len(a) and ok[k := int(ok.argmax())] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.n[:gap])[::-1]:
            if 3 * a < gap:
                return None
            self.n[a] -= 1
            rest = self.pair(gap - int(a))
            self.n[a] += 1
            if rest:
                return (int(a), *rest)
        return None


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repetitions) that use up counts {length: number of pieces}."""
    left, out = _Counts(counts, capacity), []

    def use(lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = int(min(left.n[x] // k for x, k in need.items()))
        for x, k in need.items():
            left.n[x] -= times * k
        return times

    rest: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while left.n[length] > 0:
            if length == capacity:
                out.append(((length,), use((length,))))
                continue
            left.n[length] -= 1
            fill = left.single(capacity - length) or left.pair(capacity - length) or left.triple(capacity - length)
            left.n[length] += 1
            if not fill:
                rest.append((length, int(left.n[length])))
                left.n[length] = 0
                continue
            out.append(((length, *fill), use((length, *fill))))
    # Best fit, longest first: each into the open sequences with the least gap that holds it; equal ones at once.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length, n in sorted(rest, reverse=True):
        while n:
            gap = next((g for g in range(length, capacity) if open_.get(g)), None)
            if gap is None:
                each = max(1, min(n, capacity // length))
                out_n, n = n // each, n % each if n >= each else n
                made = [((length,) * each, out_n)] if out_n else []
                if n and n < each:
                    made.append(((length,) * n, 1))
                    n = 0
            else:
                held, times = open_[gap].pop()
                fit = gap // length
                full = min(times, n // fit)
                made = [(held + (length,) * fit, full)] if full else []
                n -= full * fit
                if full < times:
                    if n:
                        made.append((held + (length,) * n, 1))
                        full, n = full + 1, 0
                    if full < times:
                        made.append((held, times - full))
            for held, times in made:
                g = capacity - sum(held)
                (open_[g] if g else out).append((held, times))
    return out + [x for held in open_.values() for x in held]


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges: for (length, from rank lo) the first sequence, how many of the length each sequence holds, and their offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, used[length], sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "sequence", "each", "offset"), cols))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, vocabulary, keep_ids))
    per = cut.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per = stored(per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    # At most `capacity` rows: one for each length.
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(layout(solve(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        starts = np.append(np.searchsorted(p["length"], np.arange(capacity + 2)), len(p["length"]))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                mine = length == x
                row[mine] = starts[x] + np.searchsorted(p["lo"][starts[x] : starts[x + 1]], rank[mine], side="right") - 1
            nth = rank - p["lo"][row]
            cols = [c for c, name in zip(batch.columns, batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p["sequence"][row] + nth // p["each"][row]), pa.array(p["offset"][row] + nth % p["each"][row] * length)],
                [*(x for x in batch.schema.names if x != "rank"), "sequence_id", "offset"])

    ids = ["ids"] if keep_ids else []
    ranked = cut.join(per.select("shard", "length", "base"), ["shard", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
