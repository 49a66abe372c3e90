"""URL verdicts by longest rule, else by a tree of path templates for each host."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

Z = 2.5  # standard errors by which a branch's labels must differ from its siblings' to stay apart
PRIOR = 8.0  # labelled rows that the parent's purity counts for
REJECT = 0.7
SHIFT = 4.0  # variance of what hosts shift log odds by
WILD, REST = "*", "**"  # any segment, any further segments


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?` or `#`.

    Null or without `://`: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, blank), F.coalesce(path, blank)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of (verdict, host, path) rules that fits, else null.

    A rule fits its host and all subdomains, if the path starts with its path.  Of equally long ones the first in
    order wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The segments of a path with runs of digits and long hexadecimal words as `#`.

    A trailing slash is a segment of its own (empty), as it tells pages apart.
    """
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"\b[0-9a-fA-F]{8,}\b", "#"), "[0-9]+", "#"))


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from rows (host, shape, known, bad): shape is an array of segments.

    First a tree over all hosts together tells which segments part bad rows from good ones anywhere, and gives each
    shape a purity.  A host's own labels shift the log odds of these, by how much oftener its labelled rows are bad
    than their shapes alone would have them.  Then the host's own tree is grown from there, in which a branch
    without labels resembles, and takes the purity of, the branch of that name in the other hosts.
    """
    rows = cut(labelled.select("host", "shape", "known", "bad"))
    whole = rows.agg(F.sum("known").alias("k"), F.sum("bad").alias("b")).first()
    p0 = whole["b"] / whole["k"] if whole["k"] else 0.0
    none = F.array().cast("array<string>")
    every = rows.groupBy("shape").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    every = _grow(every.select(F.lit("").alias("host"), "shape", "known", "bad", F.lit(p0).alias("p"), none.alias("hint")), p0)
    rows = rows.join(every.select("shape", F.col("template").alias("hint"), F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("q")), "shape")
    # one Newton step from no shift, held by a prior of variance SHIFT
    off, weight = F.sum(F.col("bad") - F.col("known") * F.col("q")), F.sum(F.col("known") * F.col("q") * (1 - F.col("q")))
    by = off / (weight + 1 / SHIFT)
    shift = rows.groupBy("host").agg(F.exp(F.least(F.greatest(by, F.lit(-6.0)), F.lit(6.0))).alias("shift"))
    odds = F.col("q") / (1 - F.col("q")) * F.col("shift")
    rows = rows.join(shift, "host").select("host", "shape", "known", "bad", (odds / (1 + odds)).alias("p"), "hint")
    return _grow(rows, p0).select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.col("p").alias("purity"))


def _grow(rows: DataFrame, p0: float) -> DataFrame:
    """(host, shape, template, p) from rows (host, shape, known, bad, p, hint): the trees of all hosts, level by level.

    A segment value stays apart if its labelled share of bad rows differs from the node's, or from that of all
    rows (p0), by Z standard errors, however few of the node's rows it has, or if the hint, a template of the shape,
    has it; all others are merged into the branch `*`.  A node grows on as long as it has enough labelled rows for any
    branch under it, at whatever depth, to pass that test, or the hints name more segments; else the rest of its paths is
    `**`.  p becomes the share of bad among the labelled rows of the template, smoothed by PRIOR rows of p as it was,
    wherever a level parts labelled rows.
    """
    rows = rows.withColumn("template", F.array().cast("array<string>"))
    root = rows.groupBy("host").agg(F.sum("known").alias("all"))
    rows = cut(rows.join(root, "host"))
    deepest = rows.agg(F.max(F.size("shape"))).first()[0] or 0
    done = []
    for k in range(1, deepest + 1):
        named = F.exists(F.slice("hint", k, 1 << 20), lambda x: ~x.isin(WILD, REST))
        hinted = F.coalesce(F.get("hint", F.lit(k - 1)) == F.get("shape", F.lit(k - 1)), F.lit(False))
        at = rows.withColumn("seg", F.get("shape", F.lit(k - 1))).withColumn("named", named).withColumn("hinted", hinted)
        child = at.groupBy("host", "template", "seg").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.max("named").alias("named"), F.max("hinted").alias("hinted"))
        node = child.groupBy("host", "template").agg(F.sum("known").alias("nk"), F.sum("bad").alias("nb"), F.max("named").alias("more"))
        rate = F.try_divide("nb", "nk")
        own = F.try_divide("bad", "known")
        apart = (F.abs(own - rate) * F.sqrt("known") > Z * F.sqrt(rate * (1 - rate))) | (F.abs(own - p0) * F.sqrt("known") > Z * math.sqrt(p0 * (1 - p0)))
        # no branch differs by more standard errors than one with all bad rows or all good rows of the node and no others
        good = F.col("nk") - F.col("nb")
        mixed = (F.col("nb") > 0) & (good > 0) & (F.greatest("nb", good) > Z * Z)
        grows = mixed | (F.col("nb") * (1 - p0) > Z * Z * p0) | (good * p0 > Z * Z * (1 - p0)) | F.col("more")
        kept = child.join(node, ["host", "template"]).select("host", "template", "seg", (F.coalesce(apart, F.lit(False)) | F.col("hinted")).alias("stay"), grows.alias("grows"))
        step = F.when(~F.col("grows"), REST).when(F.col("stay"), F.col("seg")).otherwise(WILD)
        at = at.join(kept, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.array(step)))
        at = cut(at.select("host", "shape", "known", "bad", "template", "all", "p", "hint", "grows"))
        level = at.groupBy("host", "template").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"))
        purity = F.when(F.col("k") == F.col("all"), F.col("p")).otherwise((F.col("b") + PRIOR * F.col("p")) / (F.col("k") + PRIOR))
        at = cut(at.join(level, ["host", "template"]).select("host", "shape", "known", "bad", "template", F.col("k").alias("all"), purity.alias("p"), "hint", "grows"))
        more = F.col("grows") & (F.size("shape") > k)
        done.append(at.where(~more).select("host", "shape", "template", "p"))
        rows = at.where(more).drop("grows")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, done) if done else rows.select("host", "shape", "template", "p")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    rules: (allow or block, host, path); the longest that fits decides.  For all other rows the verdict is
    block where the smoothed share of bad labels of the row's template reaches REJECT.  Labelled rows are those
    that a rule decides (block is bad), or, with labels (id_col, bad 0/1), the rows that it names.  Null
    urls and such without `://` have an empty host and path and are judged like any host's root.  Repeated
    rows give repeated rows; an empty table gives none.
    Rows are counted by host and shape before anything is shuffled; the trees are grown on these counts, and their
    purities joined back.
    """
    host, path = host_and_path(F.col("__url"))
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", segments(F.col("path")))
    if labels is None:
        known = base.withColumn("bad", F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("long")))
    else:
        own = labels.groupBy(labels[id_col].alias("page_id")).agg(F.max("bad").cast("long").alias("bad"))
        known = base.join(own, "page_id", "left")
    counted = known.groupBy("host", "shape").agg(F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # a host's root that most rows have is a skewed key of this join alone, of which Spark splits such partitions
    out = base.join(cut(template_tree(counted)), ["host", "shape"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
