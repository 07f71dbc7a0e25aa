"""URL filters: host-suffix x path-prefix expressions, an equi-join on short hash prefixes, full digests, precedence.

Handling of edge cases: a null url or one without `://` has an empty host and path and gets the default verdict;
very long urls are matched whole; repeated rows each keep their own output row; an empty table gives an empty result;
further input columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "host string, path string, verdict string, tier int"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_rest(url), "/", 1)).otherwise("")
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (at > 0), F.substr(rest, at)).otherwise(""), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(host, path, verdict, tier): a rule fits its host and every subdomain if the path starts with the rule's."""
    return spark.createDataFrame(rules, RULES_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """-> (id_col, host, path, rule, verdict, tier), one row per input row.

    Of the rules that fit, the lowest tier wins, then the longest host + path, then the longest host, then `allow`.
    Only as many host labels, and only such path lengths, as some rule has are expanded: no rule is missed for it.
    Distinct (host, path) are judged once, so a repeated url costs one lookup and its rows only an equi-join.
    """
    rules = rules.select(*RULES_SCHEMA.replace(" string", "").replace(" int", "").split(", ")).where(F.col("host").isNotNull() & F.col("path").isNotNull()).distinct()
    labels, lengths = rules.agg(F.coalesce(F.max(F.size(F.split("host", "\\."))), F.lit(0)), F.array_sort(F.collect_set(F.length("path")))).first()
    if not lengths:  # no rules at all
        return pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("int").alias("tier"))
    keyed = rules.withColumn("_full", F.sha2(F.concat("host", "path"), 256)).select(
        F.substring("_full", 1, prefix_hex).alias("_short"), F.col("_full").alias("_rule_full"), F.length("host").alias("_host_len"), F.concat("host", "path").alias("_rule"), "verdict", "tier"
    )
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = F.split("host", "\\.")
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in range(1, labels + 1)]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull())
    distinct = urls.where(F.col("host") != "").select("host", "path").distinct()
    expressions = (
        distinct.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_expr", F.explode(F.transform(prefixes, lambda p: F.concat("_suffix", p))))
        .withColumn("_full", F.sha2("_expr", 256))
        .withColumn("_short", F.substring("_full", 1, prefix_hex))
    )
    fits = expressions.join(small(keyed), "_short").where(F.col("_full") == F.col("_rule_full"))
    best = F.struct((-F.col("tier")).alias("t"), F.length("_rule").alias("l"), F.col("_host_len").alias("h"), (F.col("verdict") == "allow").alias("a"), F.col("_rule").alias("rule"), "verdict", "tier")
    # written, so that the join's sides come from plain exchanges: Spark then splits the partition of one very common url
    won = stash(fits.groupBy("host", "path").agg(F.max(best).alias("_best")))
    return urls.join(won, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.col("_best.tier").alias("tier")
    )
