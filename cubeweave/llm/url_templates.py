"""URL filtering with a tree of path templates per host.

Paths are cut into segments. Segments of digits or hex become typed wildcards; where a node has MANY children or
more, and fewer than two urls a child, its segment is variable and becomes `*`, however large the table is. The tree
goes as deep as paths share segments: what follows a node that a single path goes through belongs to that path's
template. Urls that an explicit rule covers are the labelled examples: every template has counts of blocked and
allowed ones. Sibling templates whose rate does not differ from that of the others by a two-proportion test are merged
to one branch, the others are branches of their own, and a branch whose smoothed rate is high is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeweave.scratch import materialize

#: Children from which on a node's segment can be variable.
MANY = 8
SMOOTHING, REJECT, LEAST_LABELLED = 4.0, 0.8, 5
#: Chi-square, one degree of freedom, from which on two rates differ (5 %).
DIFFERENT = 3.841
#: Rows of the verdict table up to which it is broadcast (at about 200 bytes); beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000

Rule = tuple[str, str]  # verdict and host/path-prefix


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case. Null urls and those without :// have none."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that covers the host, or a domain above it, and begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """The segments of a path; digits and hex are typed wildcards."""
    cut = F.split(F.regexp_replace(path, "^/", ""), "/")
    is_hex = lambda s: s.rlike("^[0-9a-f]{8,}$") & s.rlike("[a-f]") & s.rlike("[0-9]")
    return F.transform(cut, lambda s: F.when(is_hex(s), F.lit("<h>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>")))


def templates(shaped: DataFrame) -> DataFrame:
    """Adds template and parent (the node above it) to distinct shaped paths: host, shape (array), n (urls), blocked, allowed.

    A level of the tree is an aggregate by node, joined back and written; paths that have ended, or are alone in their
    node, leave the loop, so it ends with the deepest segment that two paths share.
    """
    names, done = shaped.columns, []
    live = materialize(shaped.select("*", F.lit("").alias("parent"), F.lit("").alias("__at"), F.lit(0).alias("__i")), "url-level")
    while live.limit(1).count():
        inner = F.size("shape") > F.col("__i")
        seg = F.get("shape", F.col("__i"))
        nodes = live.filter(inner).groupBy(F.col("host").alias("__h"), F.col("__at").alias("__a")).agg(F.count_distinct(seg).alias("__kids"), F.sum("n").alias("__urls"), F.count("*").alias("__shapes"))
        met = live.join(nodes, (F.col("host") == F.col("__h")) & (F.col("__at") == F.col("__a")), "left")
        alone = inner & (F.col("__shapes") == 1)
        variable = (F.col("__kids") >= MANY) & (2 * F.col("__kids") > F.col("__urls"))
        rest = F.array_join(F.slice("shape", F.col("__i") + 1, F.greatest(F.size("shape") - F.col("__i"), F.lit(0))), "/")
        step = F.when(variable, F.lit("*")).otherwise(seg)
        at = F.when(~inner, F.col("__at")).otherwise(F.concat("__at", F.lit("/"), F.when(alone, rest).otherwise(step)))
        parent = F.when(inner, F.col("__at")).otherwise(F.col("parent"))
        level = materialize(met.select(*names, parent.alias("parent"), at.alias("__at"), (F.col("__i") + 1).alias("__i"), (~inner | alone).alias("__done")), "url-level")
        done.append(level.filter("__done").select(*names, "parent", F.col("__at").alias("template")))
        live = level.filter("NOT __done").drop("__done")
    return reduce(DataFrame.unionAll, done) if done else shaped.select("*", F.lit("").alias("parent"), F.lit("").alias("template"))


def verdicts(shaped: DataFrame) -> DataFrame:
    """host, shape, template, merged, method: templates after merging and rejecting; merged is null without labelled urls."""
    known = materialize(templates(shaped), "url-templates")
    add = [F.sum(c).alias(c) for c in ("blocked", "allowed")]
    labelled = known.groupBy("host", "parent", "template").agg(*add).filter("blocked + allowed > 0")
    whole = labelled.groupBy("host", "parent").agg(F.sum("blocked").alias("__b"), F.sum(F.col("blocked") + F.col("allowed")).alias("__n"))
    both = labelled.join(whole, ["host", "parent"])
    b1, n1 = F.col("blocked"), F.col("blocked") + F.col("allowed")
    b2, n2, p = F.col("__b") - b1, F.col("__n") - n1, F.col("__b") / F.col("__n")
    spread = p * (1 - p) * (1 / n1 + F.try_divide(F.lit(1), n2))
    chi = F.try_divide(F.pow(b1 / n1 - F.try_divide(b2, n2), 2), spread)
    differs = F.coalesce(F.round(chi, 9) > DIFFERENT, F.lit(False))
    grouped = both.select("host", "parent", "template", "blocked", "allowed", (~differs).alias("merged"), F.when(differs, F.col("template")).otherwise(F.lit("")).alias("branch"))
    pooled = grouped.groupBy("host", "parent", "merged", "branch").agg(*add)
    total = F.col("blocked") + F.col("allowed")
    bad = pooled.select("host", "parent", "merged", "branch", ((total >= LEAST_LABELLED) & (F.round(F.col("blocked") / (total + SMOOTHING), 9) >= REJECT)).alias("rejected"))
    judged = grouped.join(bad, ["host", "parent", "merged", "branch"]).select("host", "template", "merged", "rejected")
    return known.join(judged, ["host", "template"], "left").select("host", "shape", "template", "merged", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")).alias("method"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row.

    The longest fitting rule decides; where none fits, the template tree does: block if the url's branch is
    rejected, else allow. Null urls and those without :// have an empty host and path and are allowed unless a
    rule fits. Paths of any length and depth are judged whole. Rows with null or repeated ids are kept; extra columns
    are ignored; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, label = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), label.alias("label"), shapes(F.col("path")).alias("shape"))
    count = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias(f"{v}ed")
    seen = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), count("block"), count("allow"))
    table = materialize(verdicts(seen), "url-verdicts")
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(table) if few else table, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template")
