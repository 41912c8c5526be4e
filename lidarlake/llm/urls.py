"""URL rules: host suffixes x path prefixes, short hash prefixes joined, full digests confirmed, longest rule.

DataFrame functions only. A url is expanded into every host suffix at a label boundary and every path prefix
that a rule could name: those that end with ``/`` and, for rules whose path does not, those of the lengths
that occur among such rules. An expression's key is the first 32 bits of its SHA-256; what meets a rule's key
must also have its whole digest. Equal (host, path) pairs are judged once. Rules up to BROADCAST_RULES are
broadcast; more are joined by shuffle, and so is the verdict of each pair with its pages (AQE splits a hot pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of about 150 bytes: 30 MB at most.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    parts = F.split(path, "/", -1)
    slashed = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    slashed = F.when(F.size(parts) > 1, slashed).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return slashed
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.array_union(slashed, cut)


def _digest(df: DataFrame, host: Column, path: Column) -> DataFrame:
    df = df.withColumn("digest", F.sha2(F.concat(F.length(host).cast("string"), F.lit(" "), host, path), 256))
    return df.withColumn("key", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the url's path starts with the
    rule's. The longest rule (host and path together, then the longer host) wins; of equal rules ``allow``.
    No rule: null and ``default``. A null url, or one without ``://``, has an empty host and path and fits
    none. Rules with a null are ignored. Repeated pages are judged one by one; other columns are ignored; empty tables give no rows,
    or defaults alone.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rules = rules.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    odd = rules.where(~F.col("r_path").endswith("/") | (F.col("r_path") == ""))
    lengths = sorted(r[0] for r in odd.select(F.length("r_path")).distinct().limit(1000).collect())
    if len(lengths) == 1000:
        raise ValueError("rules have paths of 1000 or more different lengths that do not end with /")
    rules = _digest(rules, F.col("r_host"), F.col("r_path"))
    small = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    host, path = host_path(F.col("url").cast("string"))
    pages = pages.select(F.col("page_id"), F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    if small:
        rules = F.broadcast(rules)
    sites = pages.where("host != ''").select("host", "path").distinct()
    out = pages.join(_match(sites, rules, lengths, rank), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _match(sites: DataFrame, rules: DataFrame, lengths: list[int], rank: Column) -> DataFrame:
    e = sites.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("e_host")).where("e_host != ''")
    e = e.select("host", "path", "e_host", F.explode(path_prefixes(F.col("path"), lengths)).alias("e_path"))
    e = _digest(e, F.col("e_host"), F.col("e_path")).select("host", "path", "key", F.col("digest").alias("e_digest"))
    return e.join(rules, "key").where("e_digest = digest").groupBy("host", "path").agg(F.max(rank).alias("best"))
