"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. Tokens that look disguised
(letters mixed with leetspeak, look-alikes or separators, letters repeated, or
letters spaced out) become a lattice of what each character may stand for;
Viterbi decoding under the trigram model restores the word. Restored words are
weighted by a lexicon of words and word beginnings learned from labelled rows,
and a logistic model turns a text's weights into a score.

Counts of the trigram model cover every document. The lexicon and the logistic
model are fitted on at most ``sample`` labelled rows, taken by a hash of their
id, one half each. Only text decides a score.

Defined results: null and empty texts have no words and score as such; rows
without doc_id are scored and not held out; repeated rows come out as often as
they come in; without any labels the score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vertexloom.llm.shared import stored, table

#: The model's alphabet; index 0 is whatever stands between words.
ALPHABET = "\0abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SIZE = len(ALPHABET)
INDEX = {c: i for i, c in enumerate(ALPHABET)}
LOOKUP = np.array([INDEX.get(chr(c), 0) for c in range(0x250)])
# What a character of leetspeak, or a look-alike of another script, may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "§": "s", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "ν": "v", "κ": "k",
}
SEPARATORS = ".-_*~'’·•,/\\​‌‍­ "
EDGES = ".,;:!?\"'()[]{}<>%#&*|~-_…«»“”‘’`^=/\\"
SPACED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*]{1,2}[\w@$!|+]){2,}(?!\w)")
#: What makes a token of letters look disguised: one of them three times in a row, or a look-alike.
ODD = re.compile(r"(.)\1\1|[" + "".join(c for c in STANDS_FOR if c.isalpha()) + "]")
RUN = re.compile(r"(.)\1+")
#: Costs of the channel, in nats.
SUBSTITUTE, DROP_REPEAT, DROP_SEPARATOR, DROP_OTHER, WILD = 0.5, 0.7, 0.2, 6.0, 3.0


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each three characters of the alphabet follow one another in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                points = np.frombuffer(f"\0{(text.as_py() or '').lower()}\0".encode("utf-32-le", "replace"), np.uint32)
                for a in range(0, len(points), 1 << 20):
                    x = points[a : a + (1 << 20) + 2]
                    x = LOOKUP[np.where(x < len(LOOKUP), x, 0)]
                    total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), interpolated with shorter contexts. The counts are at most SIZE ** 3 rows."""
    counts = np.zeros(SIZE**3)
    got = trigram_counts(docs).toPandas()
    counts[got["code"].to_numpy(int)] = got["n"].to_numpy(float)
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def arcs(ch: str, before: str) -> list[tuple[str, float]]:
    """What ch may stand for after the character before, each with its cost; nothing is "". """
    out: dict[str, float] = {ch: 0.0} if ch in INDEX and ch != "\0" else {}
    for c in STANDS_FOR.get(ch, ""):
        out.setdefault(c, SUBSTITUTE)
    if ch == before:
        out[""] = DROP_REPEAT
    if ch in SEPARATORS:
        out[""] = DROP_SEPARATOR
        if ch == "*":
            out |= dict.fromkeys("abcdefghijklmnopqrstuvwxyz", WILD)
    return list(out.items()) or [("", DROP_OTHER)]


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest word that token disguises: Viterbi over the states (last two letters), none left out.

    Tokens whose characters have few arcs go through a dictionary of the states that occur, others through arrays of all states.
    """
    if len(token) > 64 or "*" in token:
        return restore_by_arrays(token, lm)
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before = ""
    for ch in token:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for c, cost in arcs(ch, before):
            k = INDEX[c] if c else 0
            for (a, b), (score, path) in states.items():
                key = (b, k) if c else (a, b)
                s = score - cost + (float(lm[a, b, k]) if c else 0.0)
                if key not in new or s > new[key][0]:
                    new[key] = (s, (path, c) if c else path)
        states, before = new, ch
    path = max(((s + float(lm[a, b, 0]), a, b, path) for (a, b), (s, path) in states.items()), key=lambda x: x[:3])[3]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


#: Characters whose back pointers are held at once; those of earlier ones are worked out again, from the states kept at each BLOCK.
BLOCK = 1024


def restore_by_arrays(token: str, lm: np.ndarray) -> str:
    """restore() with the scores of all states in an array, for tokens of any length and many arcs."""

    def step(scores: np.ndarray, at: int) -> tuple[np.ndarray, list[int], np.ndarray]:
        own = arcs(token[at], token[at - 1] if at else "")
        letters, costs = [INDEX[c] for c, _ in own if c], np.array([x for c, x in own if c])
        drop = [x for c, x in own if not c]
        new = scores - drop[0] if drop else np.full((SIZE, SIZE), -np.inf)
        back = np.full((SIZE, len(letters)), 255, np.uint8)  # 255: dropped
        if letters:
            each = scores[:, :, None] + lm[:, :, letters] - costs
            best = each.max(0)
            better = best > new[:, letters]
            back[better] = each.argmax(0)[better]
            new[:, letters] = np.where(better, best, new[:, letters])
        return new, letters, back

    scores = np.full((SIZE, SIZE), -np.inf)
    scores[0, 0] = 0.0
    kept = []
    for at in range(len(token)):
        if at % BLOCK == 0:
            kept.append(scores)
        scores = step(scores, at)[0]
    last = scores + lm[:, :, 0]
    a, b = np.unravel_index(int(last.argmax()), last.shape)
    out = []
    for nth in range(len(kept) - 1, -1, -1):
        scores, backs = kept[nth], []
        for at in range(nth * BLOCK, min(len(token), (nth + 1) * BLOCK)):
            scores, letters, back = step(scores, at)
            backs.append((letters, back))
        for letters, back in reversed(backs):
            if b in letters and (came := back[a, letters.index(b)]) != 255:
                out.append(ALPHABET[b])
                a, b = int(came), a
    return "".join(reversed(out))


def disguised(token: str) -> bool:
    if token.isalpha():
        return ODD.search(token) is not None
    letters = sum(c.isalpha() for c in token)
    odd = sum(c in STANDS_FOR and not c.isalpha() for c in token)
    return letters + odd > 2 and letters > 0


def restored(token: str, lm: np.ndarray) -> list[str]:
    """The words that a token of a lower-case text may be."""
    word = token.strip(EDGES)
    if word.isalpha() and not disguised(word):
        return [word]
    out = [x for x in re.split(r"[^\w@$!|+*€]+", word) if x.isalpha()]
    for x in dict.fromkeys([token.strip(".,;:?\"'()[]{}<>%#&~-_…«»“”‘’`^=/\\"), word]):
        if disguised(x):
            out.append(restore(x, lm))
    return out


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in range(4, min(len(word), 8)))]


def spaced_words(low: str, lm: np.ndarray) -> Iterator[str]:
    return ("~" + restore(m[0], lm) for m in SPACED.finditer(low))


def words_of(text: str, lm: np.ndarray, memo: dict[str, list[str]]) -> Iterator[str]:
    low = text.lower()
    for token in low.split():
        got = memo.get(token)
        if got is None:
            if len(memo) > 60_000:  # bounds memory; what was dropped is worked out again
                memo.clear()
            got = memo[token] = restored(token, lm)
        yield from got
    yield from spaced_words(low, lm)


class Lexicon:
    """Weights of words and word beginnings; runs of spaced letters are searched for whole words."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        whole = [w for w in weights if w[0] != "^" and len(w) > 3]
        self.squeezed = {RUN.sub(r"\1", w): weights[w] for w in whole}
        self.inside = re.compile("|".join(map(re.escape, sorted(whole, key=len, reverse=True)))) if whole else None
        #: What a word that weighs something by itself begins with.
        self.heads = {w.removeprefix("^")[:4] for w in weights}
        #: Under one language model: tokens of a single word that weighs nothing, and what others hold.
        self.lm, self.plain, self.held = None, set(), {}

    def weigh(self, word: str) -> float:
        if word[0:1] == "~":
            found = self.inside.findall(word) + self.inside.findall(RUN.sub(r"\1", word)) if self.inside else []
            return max([0.0, *(self.weights[x] for x in found)])
        got = max(self.weights.get(f, 0.0) for f in features(word)) if word and word[:4] in self.heads else 0.0
        return got or self.squeezed.get(RUN.sub(r"\1", word) if RUN.search(word) else word, 0.0)

    def holds(self, token: str, lm: np.ndarray) -> tuple[int, list[tuple[str, float]]]:
        """How many words a token has, and those that weigh something with their weights."""
        got = self.held.get(token)
        if got is None:
            ws = restored(token, lm)
            got = len(ws), [(w, x) for w in ws if (x := self.weigh(w))]
            # The bounds are for memory; what was dropped is worked out again.
            if got == (1, []):
                if len(self.plain) > 200_000:
                    self.plain.clear()
                self.plain.add(token)
            else:
                if len(self.held) > 60_000:
                    self.held.clear()
                self.held[token] = got
        return got

    def vector(self, text: str, lm: np.ndarray) -> list[float]:
        if lm is not self.lm:
            self.lm, self.plain, self.held = lm, set(), {}
        low = text.lower()
        tokens = low.split()
        # Most tokens are plain; a comprehension passes over them.
        rest = [t for t in tokens if t not in self.plain]
        n, hits = len(tokens) - len(rest), 0
        seen: dict[str, float] = {}
        for token in rest:
            if token in self.plain:  # since this text began
                n += 1
                continue
            k, found = self.holds(token, lm)
            n += k
            hits += len(found)
            seen.update(found)
        for w in spaced_words(low, lm):
            n += 1
            x = self.weigh(w)
            if x:
                hits += 1
                seen[w] = x
        top = sorted(seen.values(), reverse=True)[:2] + [0.0, 0.0]
        return [1.0, top[0], top[1], math.log1p(hits), math.log1p(len(seen)), 100 * hits / (n + 20)]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, half) of at most sample labelled rows that aren't held out, by a hash of their id."""
    free = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    one = free.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("d"), "toxic", (F.xxhash64(F.lit(1), "doc_id") % 2 == 0).alias("half"))
    return stored(docs.join(F.broadcast(some), docs.doc_id == F.col("d")).select("text", "toxic", "half").where("text IS NOT NULL"))


def fit(docs: DataFrame, labels: DataFrame, lm, sample: int, least: int = 8) -> tuple[dict[str, float], list[float]]:
    """The lexicon from one half of the labelled sample and the logistic model from the other."""
    rows = labelled(docs.select("doc_id", "text"), labels, sample)
    # A beginning counts once a document, as a word does.

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(words_of(text, lm.value, memo)) if w[0:1] != "~" for f in features(w)}:
                    n[f][1 if y else 0] += 1
                n[""][1 if y else 0] += 1
            if len(n) > 150_000:
                yield _counts(n)
                n.clear()
        yield _counts(n)

    def _counts(n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[1] for x in n.values()], pa.int64()), pa.array([x[0] for x in n.values()], pa.int64())], ["f", "pos", "neg"])

    counted = rows.where("half").select("text", F.col("toxic").cast("int")).mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = counted.where((F.col("pos") >= least) | (F.col("f") == "")).where((F.col("pos") * 2 >= F.col("neg")) | (F.col("f") == "")).toPandas()
    total = got[got["f"] == ""]
    pos, neg = (int(total[c].iloc[0]) if len(total) else 0 for c in ("pos", "neg"))
    got = got[got["f"] != ""]
    odds = np.log((got["pos"] + 0.5) / (pos + 1)) - np.log((got["neg"] + 0.5) / (neg + 1)) - np.sqrt(1 / (got["pos"] + 0.5) + 1 / (got["neg"] + 0.5))
    weights = {f: float(o) for f, o in zip(got["f"], odds) if o > 1.0}
    lexicon = rows.sparkSession.sparkContext.broadcast(weights)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.value)
        for batch in batches:
            x = [own.vector(t, lm.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.where("NOT half").select("text", F.col("toxic").cast("int")).mapInArrow(vectors, "x array<double>, y int").toPandas()
    if not len(got):
        return weights, []
    x, y = np.array(got["x"].tolist()), (got["y"].to_numpy() > 0).astype(float)
    scale = np.maximum(x.std(0), 1e-9)
    scale[0] = 1.0
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    return weights, (w / scale).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> DataFrame:
    """docs with the columns score (0 to 1) and predicted (1 if score >= 0.5, else 0) added, or replaced."""
    sc = docs.sparkSession.sparkContext
    lm = sc.broadcast(language_model(docs))
    weights, model = fit(docs, labels, lm, sample)
    known = sc.broadcast((weights, model))
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = known.value
        own = Lexicon(weights)
        for batch in batches:
            s = []
            for text in batch.column(at):
                x = own.vector(text.as_py() or "", lm.value) if model else []
                s.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(map(float.__mul__, x, model)))))) if model else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
