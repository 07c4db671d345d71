"""URL filtering by rules and, where no rule fits, by a learned path-template tree for each host.

The tree grows level by level over counts. Segments first take a shape (numbers, hashes, dates, slugs and long
segments become placeholders), so the levels hold a host's shapes, not its urls; only short words without digits
stay as they are. At each node, segments that are many and each rare become a wildcard. The rest, whose number is
bounded by that, are compared pairwise: branches merge whose labelled block rates do not differ significantly and
whose next segments are of like kinds. A rare segment with enough labels whose block rate differs significantly from
that of the other rare ones stays by itself.

A template's purity is its share of blocked urls among the labelled ones, smoothed towards what is expected of it:
its parent's purity, and the purity that the same path has over all hosts, each by the labels behind it. So a
host without labels is judged by what its paths mean elsewhere. A template is rejected from a purity on.

Skew: a host with a third of all urls arrives as counts after map-side sums; joins on host and template are salted
on both sides, as is the one that brings templates back to the urls. Nothing is collected but the depth of the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, own_name, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Kinds of a next segment that branches are compared by.
CLASSES = ("end", "number", "code", "file", "word")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own_host, own_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(own_path))
        out = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """The path with placeholders for dates, long hex runs, numbers, and segments of three joined words or 32 characters."""
    out = F.regexp_replace(path, r"(?<![0-9])(19|20)[0-9]{2}[-/][01]?[0-9]([-/][0-3]?[0-9])?(?![0-9])", "{date}")
    out = F.regexp_replace(out, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{12,}(?![0-9A-Za-z])", "{hex}")
    out = F.regexp_replace(out, r"[0-9]+", "{num}")
    return F.regexp_replace(out, r"(?<=/)(?:[^/_-]+[_-][^/_-]+[_-][^/]*|[^/]{32,})", "{slug}")


def _class_of(segment: Column) -> Column:
    kind = F.when(segment.isNull() | (segment == ""), "end").when(segment.isin("{num}", "{date}"), "number").when(segment.contains("{"), F.when(segment.contains("."), "file").otherwise("code"))
    return kind.when(segment.contains("."), "file").otherwise("word")


def _apart(labelled: Column, blocked: Column, all_labelled: Column, all_blocked: Column, z: float) -> Column:
    """Whether a branch's block rate differs by more than chance from that of the others of ``all``, or they have none."""
    own, others, every = (F.greatest(n, F.lit(1)) for n in (labelled, all_labelled - labelled, all_labelled))
    rate = all_blocked / every
    spread = F.sqrt(F.greatest(rate * (1 - rate), 0.25 / every) * (1 / own + 1 / others))
    return (labelled == all_labelled) | (F.abs(blocked / own - (all_blocked - blocked) / others) > z * spread)


def _alike(a: dict, b: dict, z: float, distance: float) -> bool:
    """Whether two branches' block rates (expected ones, without labels) and next segments differ by no more than chance and ``distance``."""
    if bool(a["labelled"]) != bool(b["labelled"]):
        return False
    if not a["labelled"] and abs(a["hoped"] / a["n"] - b["hoped"] / b["n"]) > distance:
        return False
    if a["labelled"]:
        rate = (a["blocked"] + b["blocked"]) / (a["labelled"] + b["labelled"])
        spread = math.sqrt(max(rate * (1 - rate), 0.25 / (a["labelled"] + b["labelled"])) * (1 / a["labelled"] + 1 / b["labelled"]))
        if abs(a["blocked"] / a["labelled"] - b["blocked"] / b["labelled"]) > z * spread:
            return False
    return sum(abs(a[c] / a["n"] - b[c] / b["n"]) for c in CLASSES) / 2 <= distance


def merge_branches(branches: pd.DataFrame, z: float = 1.96, distance: float = 0.25) -> pd.DataFrame:
    """``segment`` to ``merged``: each branch, the largest first, joins the first group that it is like."""
    groups: list[tuple[dict, list[str]]] = []
    for row in branches.sort_values(["n", "segment"], ascending=[False, True]).to_dict("records"):
        for total, names in groups:
            if _alike(total, row, z, distance):
                names.append(row["segment"])
                for c in ("n", "labelled", "blocked", "hoped", *CLASSES):
                    total[c] += row[c]
                break
        else:
            groups.append((row, [row["segment"]]))
    return pd.DataFrame([(s, s if len(names) == 1 else "{" + "|".join(sorted(names)) + "}") for _, names in groups for s in names], columns=["segment", "merged"])


def _salted(left: DataFrame, right: DataFrame, on: list[str], by: str, salts: int) -> DataFrame:
    """Inner join with ``right``, which has a row for each key, that deals a key's rows of ``left`` out by ``by``."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "salt"]).drop("salt")


def _smoothed(blocked: Column, labelled: Column, expected: Column, smoothing: float) -> Column:
    return (blocked + smoothing * expected) / (labelled + smoothing)


def learn_templates(urls: DataFrame, *, depth: int = 8, children: int = 30, share: float = 0.02, smoothing: float = 5.0, few: int = 5, z: float = 1.96, salts: int = 8) -> DataFrame:
    """``host, shape, template, urls, labelled, blocked, purity`` from ``host, path, label`` (1 block, 0 allow, or null).

    Segments beyond ``depth`` are one. A segment is rare if its node has more than ``children`` and it has less
    than ``share`` of the node's urls; so no more than ``max(children, 1 / share)`` are compared. Rare segments
    become a wildcard, but for those with ``few`` labels or more whose block rate differs from that of the
    node's other rare ones by more than ``z`` standard errors: each of these is a template of its own.

    What is expected of a branch is the mean of its parent's purity and of the purity of its path over all hosts,
    weighted by their labels, at most ``smoothing`` each; where neither has any, the parent's. Without labels
    every purity is 0.5, the smoothed rate of nothing. No urls, no templates.
    """
    scratch = Scratch(urls.sparkSession)
    counted = urls.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
    tail = F.expr(f"array_join(slice(parts, {depth}, greatest(size(parts) - {depth - 1}, 1)), '/')")
    parts = counted.withColumn("parts", F.split(F.expr("substr(shape, 2)"), "/")).withColumn("parts", F.when(F.size("parts") > depth, F.concat(F.slice("parts", 1, depth - 1), F.array(tail))).otherwise(F.col("parts")))
    parts = scratch.write(parts, "url-shapes")
    total = parts.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.max(F.size("parts")).alias("depth")).first()
    prior = (total["b"] + 0.5 * smoothing) / (total["l"] + smoothing)
    totals = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    hosts = parts.groupBy("host").agg(*totals).select("host", _smoothed(F.col("b"), F.col("l"), F.lit(prior), smoothing).alias("purity"), F.col("l").alias("behind"))
    now = scratch.write(_salted(parts.withColumns({"template": F.lit(""), "anywhere": F.lit(prior)}), hosts, ["host"], "shape", salts), "url-level")
    for level in range(total["depth"] or 0):
        rows = now.withColumn("segment", F.get("parts", F.lit(level))).withColumn("next", _class_of(F.get("parts", F.lit(level + 1))))
        deep = rows.where("segment is not null").withColumn("prefix", F.array_join(F.slice("parts", 1, level + 1), "/"))
        # The purity of the path so far over all hosts, smoothed towards that of the path before it.
        same = deep.groupBy("prefix").agg(*totals, F.avg("anywhere").alias("before")).select("prefix", _smoothed(F.col("b"), F.col("l"), F.col("before"), smoothing).alias("same_path"), F.col("l").alias("same_labels"))
        one, other = (F.least(F.col(c).cast("double"), F.lit(smoothing)) for c in ("behind", "same_labels"))
        expected = F.when(one + other > 0, (one * F.col("purity") + other * F.col("same_path")) / (one + other)).otherwise(F.col("purity"))
        deep = scratch.write(_salted(deep, same, ["prefix"], "host", salts).withColumn("expected", expected), "url-deep")
        counts = {c: F.sum(c).alias(c) for c in ("n", "labelled", "blocked")} | {"hoped": F.sum(F.col("expected") * F.col("n")).alias("hoped")}
        kinds = [F.sum(F.when(F.col("next") == c, F.col("n")).otherwise(0)).alias(c) for c in CLASSES]
        branches = deep.groupBy("host", "template", "segment").agg(*counts.values(), *kinds)
        nodes = branches.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
        judged = _salted(branches, nodes, ["host", "template"], "segment", salts).withColumn("rare", (F.col("k") > children) & (F.col("n") < share * F.col("all")))

        def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return merge_branches(group).assign(host=key[0], template=key[1])[["host", "template", "segment", "merged"]]

        kept = judged.where("not rare").drop("k", "all", "rare").groupBy("host", "template").applyInPandas(merged, "host string, template string, segment string, merged string")
        rare = judged.where("rare").select("host", "template", "segment", "labelled", "blocked")
        wild = rare.groupBy("host", "template").agg(*totals)
        own = (F.col("labelled") >= few) & _apart(F.col("labelled"), F.col("blocked"), F.col("l"), F.col("b"), z)
        folded = _salted(rare, wild, ["host", "template"], "segment", salts).select("host", "template", "segment", F.when(own, F.col("segment")).otherwise("*").alias("merged"))
        names = kept.unionByName(folded)
        named = _salted(deep, names, ["host", "template", "segment"], "shape", salts).withColumn("to", F.concat("template", F.lit("/"), "merged"))
        below = named.groupBy("host", "to").agg(*totals, (F.sum(F.col("expected") * F.col("n")) / F.sum("n")).alias("mean"))
        below = below.select("host", "to", _smoothed(F.col("b"), F.col("l"), F.col("mean"), smoothing).alias("grown"), F.col("l").alias("below"))
        grown = _salted(named, below, ["host", "to"], "shape", salts).select("host", "shape", "parts", "n", "labelled", "blocked", F.col("grown").alias("purity"), F.col("below").alias("behind"), F.col("same_path").alias("anywhere"), F.col("to").alias("template"))
        before, now = now, scratch.write(grown.unionByName(rows.where("segment is null").select(*grown.columns)), "url-level")
        scratch.drop(before, deep)
    return now.select("host", "shape", "template", F.col("n").alias("urls"), "labelled", "blocked", "purity")


def filter_urls(pages: DataFrame, url_col: str = "url", *, rules: Iterable[tuple[str, str, str]] = (), label: Column | None = None, reject: float = 0.7, salts: int = 8, **options) -> DataFrame:
    """``pages`` with ``url_verdict``: ``host, path, rule, template, purity, verdict``.

    A rule decides where one fits; else the verdict is block if the template's purity is ``reject`` or more.
    Urls are labelled by ``label`` (1 block, 0 allow, null unknown), or by the rules where it is not given. A
    null url, or one without ``://``, has an empty host and path, which are judged like any other. Repeated
    rows are judged alike; an empty table gives an empty result. If ``pages`` has a column ``url_verdict``, the
    new one is ``url_verdict_``.
    """
    rules = tuple(rules)
    name = own_name(pages, "url_verdict")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    own = F.when(F.col("rule.verdict") == "block", 1).when(F.col("rule.verdict") == "allow", 0)
    held = F.struct(*(F.col(c) for c in pages.columns)).alias("row")
    read = pages.select(held, host.alias("host"), path.alias("path"), *([label.alias("label")] if label is not None else []))
    read = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if label is None:
        read = read.withColumn("label", own)
    templates = learn_templates(read.select("host", "path", F.col("label").cast("int").alias("label")), salts=salts, **options)
    copies = templates.select("host", "shape", "template", "purity").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = read.withColumn("shape", shape_of(F.col("path"))).withColumn("salt", F.pmod(F.xxhash64("path", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    joined = salted.join(copies, ["host", "shape", "salt"], "left")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    out = F.struct("host", "path", F.col("rule.rule").alias("rule"), "template", "purity", verdict.alias("verdict"))
    return joined.select(*(F.col(f"row.`{c}`") for c in pages.columns), out.alias(name))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules=RULES)
    return judged.select("page_id", *(F.col(f"url_verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "template", "purity")))
