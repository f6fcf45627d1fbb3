"""URL filtering against host/path rules by hashed expressions.

Each URL is expanded into host-suffix and path-prefix expressions; the short
SHA-256 prefixes of these are equi-joined with those of the rules; full digests
confirm a hit, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep, lower_ascii

SHORT = 8  # hex digits of the short hash
SALTS = 32  # tasks that share one site where its verdict is joined by shuffle


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where url is null or has no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty where url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rows: int = 200_000) -> DataFrame:
    """Append host, path, rule and verdict to every row of pages.

    rules(host, path, verdict): a rule fits its host and all subdomains if the
    URL's path starts with the rule's path.  The longest rule (host and path
    together, then host) wins; of equal rules with both verdicts, block wins.
    URLs that no rule fits get `default` and a null rule.  Null, empty and
    malformed URLs have empty host and path, and only a rule with both empty
    could fit them.  Columns of pages keep their names and values; existing
    columns called host, path, rule or verdict are replaced, and none may begin
    with two underscores.  Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull() & F.col("r_verdict").isNotNull())
        .groupBy("r_host", "r_path")
        .agg(F.max(F.col("r_verdict") == "block").alias("blocks"))
        .select("r_host", "r_path", F.when(F.col("blocks"), "block").otherwise("allow").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("r_digest", 1, SHORT))
    )
    # The expansion makes only suffixes and prefixes of lengths that some rule has; both sets are as
    # small as hosts and paths are long, whatever the number of rules.
    shape = rules.agg(
        F.collect_set(F.length("r_path")).alias("cuts"),
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("depths"),
        F.coalesce(F.max(F.length("r_path")), F.lit(0)).alias("longest"),
    ).first()
    taken = {"host", "path", "rule", "verdict"}
    urls = pages.select(*[c for c in pages.columns if c not in taken], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # One row for each host and start of a path: what rules can tell apart.
    urls = urls.withColumn("__start", F.substring("path", 1, shape["longest"]))
    sites = urls.select("host", "__start").distinct()
    labels = F.split("host", r"\.")
    depths = F.array(*[F.lit(d) for d in sorted(shape["depths"])]).cast("array<int>")
    cuts = F.array(*[F.lit(c) for c in sorted(shape["cuts"])]).cast("array<int>")
    expressions = (
        sites.withColumn("labels", labels)
        .withColumn("depth", F.explode(F.filter(depths, lambda d: d <= F.size("labels"))))
        .withColumn("suffix", F.array_join(F.slice("labels", -F.col("depth"), F.col("depth")), "."))
        .withColumn("cut", F.explode(F.filter(cuts, lambda c: c <= F.length("__start"))))
        .withColumn("digest", _digest(F.col("suffix"), F.expr("substring(__start, 1, cut)")))
        .select("host", "__start", "digest", F.substring("digest", 1, SHORT).alias("short"))
    )
    hits = expressions.join(broadcast_if_small(rules, broadcast_rows), "short").where(F.col("digest") == F.col("r_digest"))
    rule = F.concat("r_host", "r_path")
    best = hits.groupBy("host", "__start").agg(
        F.max_by(F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length(rule), F.length("r_host"))).alias("__best")
    )
    found = _with_verdicts(urls, keep(best, "verdicts"), broadcast_rows)
    return found.select(
        *[c for c in urls.columns if c != "__start"],
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )


def _with_verdicts(urls: DataFrame, best: DataFrame, broadcast_rows: int) -> DataFrame:
    """urls with the verdict of their site, where a rule fits it: by a broadcast of the counted sites, beyond its bound by a join that deals every site over SALTS tasks."""
    site = ["host", "__start"]
    if best.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return urls.join(F.broadcast(best), site, "left")
    copies = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return urls.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(copies, [*site, "__salt"], "left").drop("__salt")
