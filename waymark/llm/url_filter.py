"""URL filter lists: host-suffix and path-prefix expressions met by hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares; the full digest decides.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))), F.lit(""))
    raw = F.regexp_extract(after, r"^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.substr(after, F.length(raw) + F.lit(1)), r"(?s)^([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows page_id, host, path, rule, verdict for every page.

    rules: rows rule (a host, then a path from its first "/" on; without one the path is empty) and verdict (allow or
    block). A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest fitting rule
    wins; of equal rules listed twice, block does. Without a fitting rule: rule null, verdict ``otherwise``.

    Each different (host, path) is expanded into its host suffixes times its path prefixes of the lengths that rule paths
    have, and joined with the rules on the first hex digits of SHA-256; full digests confirm. Verdicts go back to the pages
    by (host, path), so that a host with a third of all pages costs no more than its different paths. The lengths are the
    only thing collected (as many as there are lengths). Null URLs and URLs without ``://`` have empty host and path and
    meet only rules with an empty host; null ids and repeated rows are judged each; other columns are ignored; an empty
    rule table leaves all to ``otherwise``.
    """
    digest = lambda c: F.sha2(c, 256)
    known = (
        rules.filter("rule is not null and verdict is not null")
        .select("rule", F.lower("verdict").alias("verdict"), F.substring_index("rule", "/", 1).alias("rule_host"))
        .select("rule", "verdict", "rule_host", F.substr("rule", F.length("rule_host") + F.lit(1)).alias("rule_path"))
        .groupBy("rule", "rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .select("rule", "verdict", F.length("rule_path").alias("path_length"), digest(F.concat_ws("\n", "rule_host", "rule_path")).alias("rule_digest"))
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX))
    )
    lengths = sorted(r[0] for r in known.select("path_length").distinct().collect())
    host, path = host_and_path(pages[url_col])
    judged = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    expressions = (
        judged.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("start"))
        .select("host", "path", digest(F.concat_ws("\n", "suffix", "start")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
    )
    best = (
        expressions.join(known, "prefix")
        .filter("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
