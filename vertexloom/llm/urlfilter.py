"""URL filter with redirect equivalence, in DataFrame operations.

Every URL is judged by the longest rule that fits its host (or a parent domain)
and the start of its path. Redirects (meta refresh) and canonical links make
URLs aliases of one another; a block by rule on any alias of a connected
component blocks those aliases that no rule judges. An alias that a rule allows
stays allowed. URLs that neither a rule nor a component judges are allowed.

Relative links are resolved against their page's URL by RFC 3986; as aliases,
URLs are compared without fragment, with scheme and host in lower case.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and has no links; null html has no links; of two rules of equal length the
allowing one wins; repeated rows come out as often as they come in; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.shared import ascii_lower, components, sized, stored, table

#: The rules of the registered query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Character references that a link may hold; the ampersand's come last.
REFERENCES = [("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&#47;|&#x2f;|&sol;", "/"), ("&#58;|&#x3a;|&colon;", ":"), ("&amp;|&#38;|&#x26;", "&")]
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def parts(df: DataFrame, url: str) -> DataFrame:
    """df with the columns host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit(""))
    return df.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def by_rules(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """(host, path, rule, ruled) of the distinct (host, path) of urls that a rule fits."""
    own = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = own.select("host", "path", F.explode(suffixes).alias("r_host"))
    fit = each.join(sized(rules, n_rules), "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("r_verdict") == "allow").alias("a"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("ruled")))
    return fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.ruled")


def bare(c: Column) -> Column:
    """A URL as a node: without fragment, scheme and host in lower case."""
    c = F.regexp_replace(c, "(?s)#.*", "")
    site = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    return F.concat(ascii_lower(site), F.substring(c, F.length(site) + 1, F.length(c)))


def without_dots(path: Column) -> Column:
    """A path without its segments "." and "..", as RFC 3986 takes them out."""
    parts_, none = F.split(path, "/"), F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s))
    # The segment before the first slash is empty; a dot at the end leaves a slash there.
    kept = F.aggregate(F.slice(parts_, 2, F.size(parts_)), none, step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts_, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(base: Column, to: Column) -> Column:
    """The reference ``to`` on a page whose URL is base, by RFC 3986; null if it is but a fragment."""
    scheme = F.regexp_extract(base, r"^[^:/?#]+:", 0)
    site = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    return (
        F.when(to.startswith("#") | (to == ""), F.lit(None).cast("string")).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("//"), F.concat(scheme, to)).when(to.startswith("/"), F.concat(site, without_dots(own), rest))
        .when(to.startswith("?"), F.concat(site, path, to)).otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest)))


def links(pages: DataFrame) -> DataFrame:
    """(url, to): all canonical links and redirects, character references decoded, relative ones resolved against the page."""
    html = F.coalesce("html", F.lit(""))
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in (CANONICAL, REFRESH)])
    out = pages.where("url LIKE '%://%' AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')").select("url", F.explode(found).alias("to"))
    to = F.col("to")
    for name, char in REFERENCES:
        to = F.regexp_replace(to, f"(?i){name}", char)
    return out.withColumn("to", resolved(F.col("url"), to)).where("to IS NOT NULL")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict); redirects(url, to) adds edges to those of the pages' html."""
    spark = pages.sparkSession
    table_ = spark.createDataFrame(rules, "r_host string, r_path string, r_verdict string")
    edges = links(pages)
    edges = stored(edges if redirects is None else edges.unionByName(redirects.select("url", "to").where("url IS NOT NULL AND to IS NOT NULL")))
    all_urls = pages.select("url").union(edges.select("url")).union(edges.select("to"))
    ruled = stored(by_rules(parts(all_urls, "url"), table_, len(rules)))
    group = stored(components(spark, edges.select(bare(F.col("url")).alias("a"), bare(F.col("to")).alias("b"))))
    n = group.count()
    blocked = parts(group, "node").join(ruled.where("ruled = 'block'"), ["host", "path"]).select("component").distinct()
    bad = group.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"))
    out = parts(pages.select("page_id", "url"), "url").join(ruled, ["host", "path"], "left").withColumn("bare", bare(F.col("url")))
    out = out.join(sized(bad, n), F.col("bare") == F.col("alias"), "left")
    verdict = F.coalesce("ruled", F.when(F.col("alias").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


# None of the given pages has a redirect or a canonical link, so the rules alone decide here; tests hold the propagation against brute force.
OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, q, v)),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
