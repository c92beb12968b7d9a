"""URL filters by host-suffix and path-prefix expressions (DataFrame functions only).

Every URL is expanded to the pairs (host suffix of a number of labels, path prefix of a length that
some rule has), written as ``host suffix + path prefix``. The expressions' SHA-256 digests meet
the rules' on their first four bytes; full digests are then compared, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Production rules (verdict, host, path); fixed values.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Verdict where no rule fits: the list names what is blocked, anything else passes.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules that are sent to every task.
SENT_RULES = 10_000


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def _rule_table(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """(_rh, _rp, _verdict): one row per expression; null hosts and paths are empty."""
    if isinstance(rules, DataFrame):
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        block = F.bool_or(F.col("verdict") == "block")
        return rules.groupBy(part("host").alias("_rh"), part("path").alias("_rp")).agg(
            F.when(block, "block").otherwise(F.min("verdict")).alias("_verdict"))
    best = {}
    for verdict, host, path in rules:
        if verdict == "block" or (host, path) not in best:
            best[host, path] = verdict
    return pages.sparkSession.createDataFrame([(h, p, v) for (h, p), v in best.items()], "_rh string, _rp string, _verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = tuple(RULES),
                default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of several,
    the one with the longest expression wins; of equally long ones the one with the longest host, and of
    one expression given twice, ``block``. Null urls and urls without ``://`` have an empty host and
    path, a null rule and the default verdict. Repeated rows are all kept; a null id stays null;
    other columns are ignored. An empty table gives an empty result. ``rules`` is a list of (verdict, host, path) or a table
    with these columns, of any size: up to ``SENT_RULES`` rules, which are counted, are sent to every task, more are joined by a
    shuffle on the short hash.

    Equal (host, path) pairs are judged once, so copies of one url cost one expansion. A url is expanded to as many host suffixes
    and path prefixes as rules have different numbers of labels and lengths of paths, however long it is itself.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    listed = _rule_table(pages, rules)
    shapes = listed.agg(F.collect_set(_labels("_rh")).alias("labels"), F.collect_set(F.length("_rp")).alias("lengths"),
                        F.count("*").alias("n")).first()  # numbers of labels and characters, not rules
    listed = listed.select(
        F.concat("_rh", "_rp").alias("_rule"), F.length("_rh").alias("_hl"), "_verdict",
        _digest(F.concat_ws("\n", "_rh", "_rp")).alias("_rd"),
        F.substring(_digest(F.concat_ws("\n", "_rh", "_rp")), 1, 8).alias("_short"))
    listed = F.broadcast(listed) if shapes["n"] <= SENT_RULES else listed.hint("merge")
    at_most = lambda numbers, most: F.filter(F.array(*map(F.lit, sorted(numbers))).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(at_most(shapes["labels"], F.col("_n")), lambda n: F.call_function(
        "substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(at_most(shapes["lengths"], F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (rows.select("host", "path").filter("host <> ''").distinct().withColumn("_n", _labels("host"))
                   .select("host", "path", F.explode(suffixes).alias("_h"), prefixes.alias("_ps"))
                   .select("host", "path", "_h", F.explode("_ps").alias("_p"))
                   .select("host", "path", _digest(F.concat_ws("\n", "_h", "_p")).alias("_d")))
    found = (expressions.withColumn("_short", F.substring("_d", 1, 8))
             .join(listed, "_short").filter("_d = _rd")
             .groupBy("host", "path")
             .agg(F.min(F.struct((-F.length("_rule")).alias("n"), (-F.col("_hl")).alias("h"),
                                 F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best")))
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
