"""Op 3: URL rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into the concatenations of its host suffixes and path prefixes, but only of the label counts and
lengths that occur in the rules, so a long URL costs no more than the rules have shapes. Expressions meet rules in an
equi-join on the first 8 hex digits of SHA-256 alone; of what meets, the full digest confirms, and the longest rule wins
(block before allow between equal ones). Spark broadcasts the rules below its size threshold and shuffles (with skew
handling) above it.

Edge cases: a null URL, or one without "://", has an empty host and path and the default verdict; rows that repeat an id
are judged one by one; an empty rule table leaves every row to the default, an empty table gives no rows; null rules fit
nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a DataFrame; a rule is a host with the path prefix behind it."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]).cast("array<struct<verdict: string, rule: string>>")
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = rules.where("rule is not null").select("verdict", "rule", F.regexp_extract("rule", "(?s)^([^/]*)", 1).alias("h"), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("p"))
    # distinct label counts and lengths: at most as many as the longest rule has labels and characters
    shapes = known.agg(F.collect_set(F.size(F.split("h", r"\.", -1))).alias("labels"), F.collect_set(F.length("p")).alias("lengths")).first()
    suffixes = F.transform(F.filter(F.array(*map(F.lit, sorted(shapes.labels))).cast("array<int>"), lambda k: k <= F.size(F.split("host", r"\.", -1))), lambda k: F.array_join(F.slice(F.split("host", r"\.", -1), -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(shapes.lengths))).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    exploded = rows.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256))
    hashed = known.select("verdict", "rule", F.sha2(F.concat("h", "p"), 256).alias("full"))
    met = exploded.join(hashed, F.left("digest", F.lit(PREFIX)) == F.left("full", F.lit(PREFIX)), "left")
    best = F.max(F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")))
    return met.groupBy("row", "page_id", "host", "path").agg(best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
