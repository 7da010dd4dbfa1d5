"""Operator 10, URL filters.

A URL is expanded into host-suffix and path-prefix expressions, only of the
shapes (number of host labels, length of path prefix) that some rule has.
Expressions meet the rules in an equi-join on a short digest prefix; the full
digest confirms the hit, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, any_names

PREFIX_HEX = 8  # four bytes of the digest
MAX_SHAPES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what follows the first ``://`` up to ``/ ? #``,
    A-Z lower-cased, and then up to ``? #``.  Both empty for null or no ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> list[Column]:
    full = F.sha2(expression, 256)
    return [F.substring(full, 1, PREFIX_HEX).alias("digest_prefix"), full.alias("digest")]


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each (host, path) that some rule fits.

    A rule (host, path, verdict) fits its host and every subdomain when the
    path starts with the rule's.  The longest rule text wins; equal lengths go
    to the longer host, then to block, then to the smaller text.  Rules with a
    null field, an empty host or a slash in the host are ignored.
    """
    rules = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> '' AND NOT contains(host, '/')")
             .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"))
    shapes = (rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))
              .distinct().limit(MAX_SHAPES + 1).collect())
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"the rules have over {MAX_SHAPES} shapes of host labels and path lengths")
    if not shapes:
        return urls.where("false").select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    listed = rules.select(F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_chars"), "verdict")
    listed = listed.select("rule", "host_chars", "verdict", *_digest(F.col("rule")))

    shape_array = F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(shapes)])
    expanded = (urls.select("host", "path", F.explode(shape_array).alias("shape"))
                .where("shape.labels <= size(split(host, '[.]')) AND shape.chars <= length(path)")
                .select("host", "path", F.expr("concat(substring_index(host, '.', -shape.labels), left(path, shape.chars))").alias("expression")))
    found = (expanded.select("host", "path", *_digest(F.col("expression")))
             .join(listed.withColumnRenamed("digest", "rule_digest"), "digest_prefix")
             .where("digest = rule_digest"))
    rank = F.struct(F.length("rule").alias("chars"), "host_chars", (F.col("verdict") == "block").alias("blocks"))
    best = F.min_by(F.struct("rule", "verdict"),
                    F.struct(-F.col("rank.chars"), -F.col("rank.host_chars"), ~F.col("rank.blocks"), F.col("rule")))
    return (found.withColumn("rank", rank).groupBy("host", "path").agg(best.alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))


@any_names
def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (existing columns of
    these names are replaced).  Without a fitting rule, rule is null and the
    verdict is ``default``.  Repeated rows stay repeated; an empty table gives
    an empty result."""
    host, path = url_parts(F.col(url_col))
    base = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    best = match_rules(base.select("host", "path").distinct(), rules)
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    joined = base.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return (joined.withColumns({"rule": F.col("_rule"), "verdict": F.coalesce("_verdict", F.lit(default))})
            .drop("_h", "_p", "_rule", "_verdict"))
