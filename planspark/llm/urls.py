"""URL filters by host-suffix and path-prefix expressions (operator 9).

A rule (host, path, verdict) fits the host and all its subdomains where the
URL's path starts with the rule's path. Every URL is expanded into
expressions: each dot-suffix of its host with each prefix of its path whose
length occurs among the rules. Expressions meet rules in an equi-join on a
short hash prefix; the full digests confirm the hits. The longest rule wins,
then the one with the longer host, then ``block``. Where no rule fits, the
verdict is ``allow``.

Cases: a null URL or one without ``://`` has an empty host and path and no
rule; hosts are lower-cased in A-Z; repeated rows give repeated results;
repeated rules count once, rules without a host fit nothing; an empty rule table allows everything; extra
columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import ascii_lower, in_rows_of

DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substr({u}, instr({u}, '://') + 3)".replace("{u}", "_url")))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.expr("substr({u}, instr({u}, '://') + 3)".replace("{u}", "_url")))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: list[int]) -> Column:
    """The dot-suffixes of a host that have one of these numbers of labels, itself included if it has.

    Only numbers that occur among the rules are made, so a host of many dots makes no more than the rules can use.
    """
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    found = [F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``verdict`` of each distinct URL.

    ``rules`` has the columns ``host``, ``path`` and ``verdict``. Copies of a
    URL are folded before anything is expanded.
    """
    rules = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).where("r_host <> ''").distinct()
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().orderBy(F.length("r_path")).collect()]
    dots = F.length("r_host") - F.length(F.replace(F.col("r_host"), F.lit("."), F.lit(""))) + 1
    labels = sorted(r[0] for r in rules.select(dots.cast("int").alias("n")).distinct().collect())
    parts = (
        urls.select(F.col(url).alias("_url"))
        .distinct()
        .withColumn("host", host_of(F.col("_url")))
        .withColumn("path", path_of(F.col("_url")))
    )
    wanted = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    expressions = (
        parts.where("host <> ''")
        .select("_url", "path", F.explode(suffixes(F.col("host"), labels)).alias("e_host"))
        .select(
            "_url",
            "e_host",
            F.explode(F.filter(wanted, lambda n: n <= F.length("path"))).alias("n"),
            "path",
        )
        .select("_url", _digest(F.col("e_host"), F.expr("substr(path, 1, n)")).alias("e_digest"))
        .withColumn("key", F.substring("e_digest", 1, PREFIX_HEX))
    )
    coded = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "key", F.substring("r_digest", 1, PREFIX_HEX)
    )
    best = (
        expressions.join(coded, "key")
        .where("e_digest = r_digest")
        .groupBy("_url")
        .agg(
            F.max(
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("size"),
                    F.length("r_host").alias("host_size"),
                    F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("stops"),
                    F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return in_rows_of(parts, best, ["_url"]).select(
        F.col("_url").alias(url),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def filter_urls(rows: DataFrame, rules: DataFrame, id: str, url: str = "url") -> DataFrame:
    """The judgement of every row: ``id``, ``host``, ``path``, ``rule``, ``verdict``."""
    keyed = rows.select(id, url)
    return in_rows_of(keyed, judge(keyed, rules, url), [url]).select(id, "host", "path", "rule", "verdict")


def _digest(host: Column, path: Column) -> Column:
    """Digest of host and path; the line feed keeps ("a", "b") and ("ab", "") apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)
