"""URL filter by a path-template tree (operator 1).

Given rules (``host/path``, longest wins) decide first. All other urls are
judged by their host's template tree: path segments that vary (numbers, hex
names, dates, or a level with very many different names) become wildcards,
sibling branches of the same shape whose labelled share doesn't differ are
merged, and a template is rejected when its smoothed labelled purity reaches the
limit and enough of its urls are labelled: a few labels don't speak for the rest,
however many urls there are. The labels are the urls that a rule decided.

Null urls and urls without ``://`` have an empty host and path, no rule, and
are allowed. Repeated urls count as often as they occur. Urls are first
combined by host and shape on the map side; the tree is built from those
counts, so a host with a third of all urls stays small.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import narrow, stored

# The rules of the registered query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Lexical wildcards, first match wins: pattern of a whole segment and what stands for it.
WILDCARDS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$", "{date}"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^[0-9]+\.([a-z]{2,5})$", "{n}.$1"),
    (r"^(?=(?:.*[0-9]){4}).{12,}$", "{mixed}"),
)


#: So many levels in one query plan, which names its input several times a level.
LEVELS_A_PLAN = 2


@dataclass(frozen=True)
class TemplateParams:
    #: A level is variable with this many names of which this share are different.
    min_names: int = 20
    variable_share: float = 0.3
    #: A name with this share of its level stays a name.
    own_share: float = 0.1
    #: Siblings merge unless their labelled shares differ by this many standard errors.
    z: float = 1.64
    #: Purity: (blocked + weight * prior) / (labelled + weight); the prior is the host's own smoothed share.
    weight: float = 4.0
    prior: float = 0.1
    reject_at: float = 0.8
    #: At least this share of a template's urls is labelled before it is rejected.
    labelled_share: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, PARTS, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        its_host, its_path = text.split("/", 1)
        fits = ((host == its_host) | F.endswith(host, F.lit("." + its_host))) & F.startswith(path, F.lit("/" + its_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shaped(path: Column) -> Column:
    """Array of the path's segments with lexical wildcards."""
    def wild(s: Column) -> Column:
        out = s
        for pattern, instead in reversed(WILDCARDS):
            out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, instead) if "$" in instead else F.lit(instead)).otherwise(out)
        return out

    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: wild(s))


def joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def with_level(rows: DataFrame, level: int) -> DataFrame:
    """Adds the segment of the level and the parts before and after it."""
    return rows.withColumn("up", joined(F.slice("t", 1, level))).withColumn("name", F.get("t", level)) \
        .withColumn("down", joined(F.slice("t", F.lit(level + 2), F.size("t") + 1)))


def replaced(rows: DataFrame, level: int, change: Column, mark: str) -> DataFrame:
    t = F.transform("t", lambda s, i: F.when((i == level) & change, F.lit(mark)).otherwise(s))
    return rows.withColumn("t", t)


def generalise(rows: DataFrame, level: int, params: TemplateParams) -> DataFrame:
    """Below a parent with very many different names the rare ones become ``*``; names with a real share of it stay."""
    at = with_level(rows, level)
    names = at.filter("name is not null and name not like '{%'").groupBy("host", "up", "name").agg(F.sum("n").alias("own"))
    levels = names.groupBy("host", "up").agg(F.count(F.lit(1)).alias("names"), F.sum("own").alias("all")) \
        .filter((F.col("names") >= params.min_names) & (F.col("names") >= params.variable_share * F.col("all")))
    rare = names.join(levels, ["host", "up"]).filter(F.col("own") < params.own_share * F.col("all")) \
        .select("host", "up", "name", F.lit(True).alias("variable"))
    at = at.join(rare, ["host", "up", "name"], "left")
    return replaced(at, level, F.coalesce("variable", F.lit(False)), "*").select("host", "shape", "t", "n", "labelled", "blocked")


def merge_siblings(rows: DataFrame, level: int, params: TemplateParams) -> DataFrame:
    """Siblings with the same branch shape merge unless their labelled shares differ; unlabelled ones only among themselves."""
    at = with_level(rows, level)
    branch = at.filter("name is not null and name <> '*' and name not like '{%'").groupBy("host", "up", "down", "name") \
        .agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    pool = branch.groupBy("host", "up", "down").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("names"))
    both = branch.join(pool, ["host", "up", "down"])
    rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
    share = F.col("pb") / F.col("pl")
    error = F.sqrt(share * (1 - share) * (1 / F.col("l") + 1 / rest_l))
    apart = F.abs(F.col("b") / F.col("l") - rest_b / rest_l)
    alike = F.when(F.col("pl") == 0, F.lit(True)).when((F.col("l") == 0) | (rest_l == 0), F.lit(False)) \
        .otherwise(apart <= params.z * error)
    merged = both.filter((F.col("names") > 1) & alike).select("host", "up", "down", "name", F.lit(True).alias("merged"))
    at = at.join(merged, ["host", "up", "down", "name"], "left")
    return replaced(at, level, F.coalesce("merged", F.lit(False)), "*").select("host", "shape", "t", "n", "labelled", "blocked")


def shared_levels(rows: DataFrame) -> int:
    """The levels that two shapes of one host reach; on deeper ones no name has another beside it."""
    sizes = rows.groupBy("host", F.size("t").alias("size")).agg(F.count(F.lit(1)).alias("shapes")) \
        .groupBy("host").agg(F.max(F.when(F.col("shapes") > 1, F.col("size"))).alias("twice"),
                             F.sort_array(F.collect_set("size"), asc=False).alias("sizes"))
    return sizes.agg(F.max(F.greatest(F.coalesce("twice", F.lit(0)), F.coalesce(F.get("sizes", F.lit(1)), F.lit(0))))).first()[0] or 0


def template_verdicts(urls: DataFrame, params: TemplateParams) -> DataFrame:
    """(host, shape, template, labelled, purity, rejected) from rows (host, shape array, verdict or null)."""
    rows = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"),
        F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocked"))
    rows = stored(rows.select("host", "shape", F.col("shape").alias("t"), "n", "labelled", "blocked"), "shapes")
    levels = shared_levels(rows)
    for step, name in ((generalise, "templates"), (merge_siblings, "siblings")):
        for level in range(levels):
            rows = step(rows, level, params)
            if level % LEVELS_A_PLAN == LEVELS_A_PLAN - 1 or level == levels - 1:
                rows = stored(rows, name)
    rows = stored(rows.withColumn("template", F.concat(F.lit("/"), joined(F.col("t")))), "merged")
    smooth = lambda b, n, prior: (b + params.weight * prior) / (n + params.weight)
    hosts = rows.groupBy("host").agg(smooth(F.sum("blocked"), F.sum("labelled"), F.lit(params.prior)).alias("host_share"))
    templates = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.sum("n").alias("n")) \
        .join(hosts, "host") \
        .withColumn("purity", smooth(F.col("blocked"), F.col("labelled"), F.col("host_share"))) \
        .withColumn("rejected", (F.col("labelled") > 0) & (F.col("labelled") >= params.labelled_share * F.col("n"))
                    & (F.col("purity") >= params.reject_at))
    return rows.select("host", "shape", "template") \
        .join(templates.select("host", "template", "labelled", "purity", "rejected"), ["host", "template"])


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row."""
    pages = narrow(pages, page_id=("page_id", "bigint"), url=("url", "string"))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), shaped(F.col("path")).alias("shape"))
    judged = template_verdicts(rows.filter("host <> ''").select("host", "shape", "verdict"), params)
    judged = stored(judged.select("host", "shape", "template", "purity", "rejected"), "template-verdicts")
    own = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left") \
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")
