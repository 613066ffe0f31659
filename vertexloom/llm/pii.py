"""Format-preserving Feistel pseudonyms for validated numbers and dates, in SQL functions only.

Card numbers (13 to 19 digits with a right Luhn digit), North American phone
numbers, IPv4 addresses and ISO dates of 1900 to 2099 are permuted within their
own format under a key: equal values become equal pseudonyms in every document,
different ones stay different, and each pseudonym is again valid. The rounds
are keyed SHA-256. Dates walk the permutation's cycle until they are dates.

Defined results: a null text stays null; what doesn't validate stays as it is;
all columns are kept, whatever their names, but for an n_pii of the input, which
the new one replaces; n_pii counts the values that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.shared import table

ROUNDS = 8
FOUND = r"(?<![\w.])(?:\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{13,19}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\w|\.[0-9])"
DAYS = 73049  # from 1900-01-01 to 2099-12-31


def feistel(key: str, label: str, a: Column, b: Column, size_a: Column, size_b: Column, inverse: bool = False) -> Column:
    """A permutation of the pairs (a, b) below (size_a, size_b) as a struct: in turn each half is shifted by a keyed hash of the other."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def step(s: Column, i: Column) -> Column:
        def shift(mine: Column, other: Column, size: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{label}"), i.cast("string"), size.cast("string"), other.cast("string")).cast("binary"), 256)
            by = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)
            return F.pmod(mine - by if inverse else mine + by, size)

        even = i % 2 == 0
        return F.struct(F.when(even, shift(s["a"], s["b"], size_a)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shift(s["b"], s["a"], size_b)).alias("b"))

    return F.aggregate(steps, start, step)


def luhn(digits: Column) -> Column:
    """The sum over digits of which the last is the check digit, mod 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.pmod(x.cast("int") * 2, F.lit(10)) + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def _card(x: Column, key: str, inverse: bool) -> Column:
    n = F.length(x)
    half = F.floor((n - 2) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    size_a, size_b = power(half), power(n - 2 - half)
    r = feistel(key, "card", F.substring(x, F.lit(2), half).cast("long"), F.substring(x, half + 2, n - 2 - half).cast("long"), size_a, size_b, inverse)
    body = F.concat(F.substring(x, 1, 1), F.lpad(r["a"].cast("string"), half, "0"), F.lpad(r["b"].cast("string"), n - 2 - half, "0"))
    return F.when(luhn(x) == 0, F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))


def _phone(x: Column, key: str, inverse: bool) -> Column:
    area, office, line = (F.substring(x, p, k).cast("long") for p, k in ((5, 3), (10, 3), (14, 4)))
    r = feistel(key, "phone", (area - 200) * 800 + office - 200, line, F.lit(640_000), F.lit(10_000), inverse)
    text = F.concat(F.lit("+1 ("), (F.floor(r["a"] / 800) + 200).cast("string"), F.lit(") "), (r["a"] % 800 + 200).cast("string"), F.lit("-"), F.lpad(r["b"].cast("string"), 4, "0"))
    return F.when((area >= 200) & (office >= 200), text)


def _address(x: Column, key: str, inverse: bool) -> Column:
    o = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    r = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), inverse)
    text = F.concat_ws(".", *[p.cast("string") for h in ("a", "b") for p in (F.floor(r[h] / 256), r[h] % 256)])
    plain = ~x.rlike(r"(^|\.)0[0-9]")
    return F.when(plain & (F.array_max(o) < 256), text)


def _date(x: Column, key: str, inverse: bool) -> Column:
    day = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))

    def once(d: Column) -> Column:
        r = feistel(key, "date", F.floor(d / 270), d % 270, F.lit(271), F.lit(270), inverse)
        return r["a"] * 270 + r["b"]

    # 121 of 73,170 places are no dates; the chance to be on them 16 times is nil.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(16)), once(day), lambda d, _: F.when(d < DAYS, d).otherwise(once(d)))
    return F.when(day.between(0, DAYS - 1), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int")), "yyyy-MM-dd"))


def pseudonym(x: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a found value, or the value itself if it isn't valid."""
    kind = F.when(x.startswith("+"), _phone(x, key, inverse)).when(x.contains("."), _address(x, key, inverse)).when(x.contains("-"), _date(x, key, inverse)).otherwise(_card(x, key, inverse))
    return F.coalesce(kind, x)


def pseudonymise(docs: DataFrame, key: str = "vertexloom", inverse: bool = False) -> DataFrame:
    """docs with the values in text replaced, and n_pii. With inverse, the originals of pseudonyms made under the key."""
    some = F.col("text").rlike("[0-9][0-9.-][0-9]|[0-9]\\.[0-9]") & F.col("text").rlike(FOUND)
    values = F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))
    taken = {c.lower() for c in docs.columns}
    old, new = (next(x for k in range(len(taken) + 1) if (x := f"{name}{k or ''}") not in taken) for name in ("__old", "__new"))
    made = docs.withColumn(old, F.when(some, values)).withColumn(new, F.when(some, F.transform(old, lambda x: pseudonym(x, key, inverse))))
    between = F.split("text", FOUND)
    text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda c: c))
    cols = [F.when(F.col(new).isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_pii"]
    return made.select(*cols, F.when(F.col(new).isNull(), F.lit(0)).otherwise(changed).alias("n_pii"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "n_pii", "text")
