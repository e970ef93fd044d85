"""URL filter by a path-template tree, in DataFrame functions only.

Rules come first: the longest rule whose host is the url's host or a parent of it, and whose path starts the url's
path, decides.  For the other urls a tree of path templates is grown per host, one level of segments after another:

* a branch whose share of bad labels differs from its parent's by ``Z`` standard errors keeps its name; the others are merged
  into ``*``;
* a level is variable where most rows bring a value of their own (at least ``LEAST_KINDS`` kinds, and at least ``VARIABLE`` kinds a
  row): there a branch needs ``LEAST_HOT`` labelled rows as well to keep its name, so that rare values always become ``*``.

Levels are grown to the end of the paths, each written to the shared folder.  Growth of a template stops only where no level below
it can hold a differing branch (fewer than ``LEAST_MARKED`` labelled rows go deeper, or all have one label): the segments left
become ``*`` each, as the levels would have made them.  A template's purity is its share of good labels, smoothed by ``WEIGHT``
rows of the overall share; templates below ``LEAST_PURITY`` are rejected.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and the method's verdict for the template of
that empty host; without labels the overall share is 1 and nothing is rejected but by rules; ids labelled both ways count as unlabelled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

LEAST_KINDS = 8
VARIABLE = 0.5
LEAST_HOT = 8
Z = 3.0
#: With the smoothed share of ``_level``, m alike labels of a branch differ by Z only among more than Z² (m + 1) / m + m - 1 labelled rows.
LEAST_MARKED = 1 + math.floor(min(Z * Z * (m + 1) / m + m - 1 for m in range(1, 100)))
WEIGHT = 10.0
LEAST_PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return (df.withColumn("__rest", rest).withColumn("host", F.translate(host, UPPER, LOWER))
            .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest"))


def ruled(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``ruling`` of the longest rule (verdict, host, path) that fits; null without one."""
    fits = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append((fit, host + path, verdict))
    if not fits:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("ruling", F.lit(None).cast("string"))
    return (df.withColumn("rule", F.coalesce(*[F.when(f, F.lit(name)) for f, name, _ in fits]))
            .withColumn("ruling", F.coalesce(*[F.when(f, F.lit(v)) for f, _, v in fits])))


def _level(rows: DataFrame, k: int) -> DataFrame:
    """Extend every row's template by its segment at level ``k`` or by a wildcard."""
    seg = F.get(F.col("segments"), k)
    known = rows.withColumn("seg", seg)
    kinds = (known.filter(F.col("seg").isNotNull()).groupBy("host", "template", "seg")
             .agg(F.count("*").alias("n"), F.count("bad").alias("marked"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    parents = (kinds.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.sum("marked").alias("all_marked"),
                                                     F.sum("bad").alias("all_bad"))
               .withColumn("variable", (F.col("kinds") >= LEAST_KINDS) & (F.col("kinds") >= VARIABLE * F.col("rows"))))
    share = (F.col("all_bad") + 1.0) / (F.col("all_marked") + 2.0)
    differs = F.abs(F.col("bad") - share * F.col("marked")) > Z * F.sqrt(share * (1.0 - share) * F.col("marked"))
    own = (kinds.join(parents, ["host", "template"]).filter(differs & (~F.col("variable") | (F.col("marked") >= LEAST_HOT)))
           .select("host", "template", "seg", F.lit(True).alias("kept")))
    return (known.join(own, ["host", "template", "seg"], "left")
            .withColumn("template", F.when(F.col("seg").isNull(), F.col("template"))
                        .otherwise(F.concat("template", F.lit("/"), F.when(F.col("kept"), F.col("seg")).otherwise(F.lit("*")))))
            .drop("seg", "kept"))


def _growing(rows: DataFrame, k: int) -> DataFrame:
    """The templates below which a branch can differ at level ``k`` or deeper."""
    return (rows.filter(F.size("segments") > k).groupBy("host", "template").agg(F.count("bad").alias("marked"), F.sum("bad").alias("bad"))
            .filter((F.col("marked") >= LEAST_MARKED) & (F.col("bad") > 0) & (F.col("bad") < F.col("marked")))
            .select("host", "template", F.lit(True).alias("grows")))


def _grown(rows: DataFrame) -> DataFrame:
    """Every row with its whole template."""
    done, k = [], 0
    while True:
        growing = _growing(rows, k)
        last = growing.isEmpty()
        if not last:
            rows = rows.join(growing, ["host", "template"], "left").withColumn("grows", F.coalesce("grows", F.lit(False)) & (F.size("segments") > k))
        closed = rows if last else rows.filter(~F.col("grows")).drop("grows")
        rest = F.array_repeat(F.lit("/*"), F.greatest(F.size("segments") - k, F.lit(0)))
        done.append(closed.withColumn("template", F.concat("template", F.array_join(rest, ""))))
        if last:
            return reduce(DataFrame.unionByName, done)
        rows = shared_table(_level(rows.filter("grows").drop("grows"), k), f"url-level-{k + 1}")
        k += 1


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) for every row.  ``labels`` has (id, good 0/1) of some pages."""
    marks = (labels.filter("id is not null and good in (0, 1)").groupBy("id").agg(F.min("good").alias("low"), F.max("good").alias("high"))
             .filter("low = high").select("id", (F.lit(1) - F.col("low")).cast("long").alias("bad")))
    rows = ruled(parts(pages.select(F.col(page_id), F.col(url)), url), rules)
    inner = F.regexp_replace("path", r"^/|/$", "")
    rows = (rows.join(marks, rows[page_id] == marks["id"], "left")
            .select(page_id, "host", "path", "rule", "ruling", "bad", F.lit("").alias("template"),
                    F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/")).alias("segments")))
    rows = shared_table(rows, "url-rows")
    total = rows.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = 1.0 - total["bad"] / total["n"] if total["n"] else 1.0
    rows = _grown(rows)
    purity = (F.count("bad") - F.coalesce(F.sum("bad"), F.lit(0)) + WEIGHT * overall) / (F.count("bad") + WEIGHT)
    pure = rows.groupBy("host", "template").agg(purity.alias("purity"))
    method = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(pure, ["host", "template"]).select(page_id, "host", "path", "rule", "template", "purity",
                                                        F.coalesce("ruling", method).alias("verdict"))
