"""Quality rules as a learned decision list, in DataFrame functions throughout.

Text statistics are built-in expressions. Sequential covering learns an ordered list of threshold conjunctions
from labelled statistics: a rule is grown condition by condition on one part of the rows, pruned on another, kept
if it is precise there, and the rows that it covers are set aside before the next. The list becomes one
``CASE WHEN`` expression, so judging a corpus is a projection without any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, read_table

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
POINTS = "!?"
#: What conditions may be put on; each is a ratio or a count of the text itself.
FEATURES = ("n_words", "word_length", "symbol_share", "upper_share", "digit_share", "point_share", "dup_line_share", "repeat_share", "distinct_share")


def with_statistics(df: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the ``FEATURES``.

    Null and empty texts have zero throughout; a text shorter than a window has no repeated windows. Existing
    columns keep their names and values unless they bear one of these names, in which case they are replaced.
    """
    text, words, hashes, grams, repeated, n_lines = (own_name(df, f"_{x}") for x in ("text", "words", "hashes", "grams", "repeated", "lines"))
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("word_chars", F.length(F.translate(t, BLANKS, "")).cast("long"))
    out = out.withColumn(words, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    out = out.withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x))).withColumn("n_words", F.size(words).cast("long"))
    gram = lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(window)))
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - window)
    out = out.withColumn(grams, F.when(F.col("n_words") >= window, F.transform(starts, gram)).otherwise(F.array().cast("array<bigint>")))
    # Sorted by value, equal windows are neighbours; this is only done for texts that repeat any.
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(repeated, F.when(F.size(F.array_distinct(grams)) < F.size(grams), ordered))
    r = F.col(repeated)
    twice = F.transform(r, lambda x, i: F.when((x["h"] == F.get(r, i - 1)["h"]) | (x["h"] == F.get(r, i + 1)["h"]), x["i"]))
    out = out.withColumn(repeated, F.sort_array(F.array_compact(twice)))
    # A window adds the words that the one before doesn't cover.
    added = F.transform(r, lambda x, i: F.when(i == 0, window).otherwise(F.least(F.lit(window), x - F.get(r, i - 1))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    share = lambda chars: 1 - F.length(F.translate(t, chars, "")) / F.greatest(F.length(t), F.lit(1))
    per_word = lambda x: x / F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns(
        {
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "upper_share": F.when(F.length(t) > 0, share(LETTERS)).otherwise(0.0),
            "digit_share": F.when(F.length(t) > 0, share(DIGITS)).otherwise(0.0),
            "point_share": F.when(F.length(t) > 0, share(POINTS)).otherwise(0.0),
            "distinct_share": per_word(F.size(F.array_distinct(hashes))),
            "repeat_share": per_word(F.col("n_repeat_words")),
            "word_length": per_word(F.col("word_chars")),
            n_lines: F.size(lines),
        }
    )
    out = out.withColumns({"symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col(n_lines), F.lit(1))})
    return out.drop(text, words, hashes, grams, repeated, n_lines)


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, "<=" or ">", threshold)`` that rejects what it covers."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict) -> bool:
        return all(row[f] <= v if op == "<=" else row[f] > v for f, op, v in self.conditions)

    def expression(self) -> Column:
        out = F.lit(True)
        for f, op, v in self.conditions:
            out = out & ((F.col(f) <= v) if op == "<=" else (F.col(f) > v))
        return out


def _counted(rows: list[tuple[dict, bool]], cuts: int) -> Iterator[tuple[tuple[str, str, float], int, int]]:
    """Conditions with the bad rows and all rows that they cover: up to ``cuts`` places between values a feature."""
    all_bad = sum(b for _, b in rows)
    for f in FEATURES:
        ordered = sorted(((float(r[f]), b) for r, b in rows), key=lambda x: x[0])
        places = [i for i in range(1, len(ordered)) if ordered[i - 1][0] < ordered[i][0]]
        chosen = {places[round(k * (len(places) - 1) / max(1, cuts - 1))] for k in range(cuts)} if places else set()
        below = 0
        for i in range(1, len(ordered)):
            below += ordered[i - 1][1]
            if i in chosen:
                middle = (ordered[i - 1][0] + ordered[i][0]) / 2
                yield (f, "<=", middle), below, i
                yield (f, ">", middle), all_bad - below, len(rows) - i


def _precision(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int, int]:
    bad = sum(b for r, b in rows if rule.covers(r))
    all_ = sum(rule.covers(r) for r, _ in rows)
    return (bad + 0.1) / (all_ + 0.2), bad, all_


def learn_rules(rows: list[dict], bad: list[bool], *, precisions: tuple[float, ...] = (0.98, 0.9), longest: int = 3, most: int = 12, least: int = 3, cuts: int = 48) -> list[Rule]:
    """Sequential covering: rules that reject, in order, each precise enough on rows held back from growing it.

    Two thirds of the rows grow rules by information gain (as in FOIL), the rest prune them and decide. A rule
    is kept if its precision reaches the level, else another feature has to start the next; once none is left,
    the next level is tried on what is still uncovered. It ends with the levels, at ``most`` rules, or where fewer than ``least`` bad rows remain. Without
    rows or bad rows: no rules.
    """
    grow = [(r, b) for i, (r, b) in enumerate(zip(rows, bad, strict=True)) if i % 3]
    prune = [(r, b) for i, (r, b) in enumerate(zip(rows, bad, strict=True)) if i % 3 == 0]
    rules: list[Rule] = []
    for level in precisions:
        failed: set[str] = set()
        while len(rules) < most and sum(b for _, b in grow) >= least:
            grown = _grow(grow, longest, least, cuts, failed)
            if not grown.conditions:
                break
            prefixes = [Rule(grown.conditions[:k]) for k in range(1, len(grown.conditions) + 1)]
            fit = [r for r in prefixes if min(_precision(r, prune)[0], _precision(r, grow)[0]) >= level]
            if not fit:
                failed.add(grown.conditions[0][0])
                continue
            rule = max(fit, key=lambda r: 2 * _precision(r, prune)[1] - _precision(r, prune)[2])
            rules.append(rule)
            grow = [(r, b) for r, b in grow if not rule.covers(r)]
            prune = [(r, b) for r, b in prune if not rule.covers(r)]
    return rules


def _grow(rows: list[tuple[dict, bool]], longest: int, least: int, cuts: int, failed: set[str]) -> Rule:
    """Conditions are added by their gain until only bad rows are covered or none gains; ``failed`` may not start."""
    rule = Rule(())
    while len(rule.conditions) < longest and not all(b for _, b in rows):
        p0, n0 = sum(b for _, b in rows), len(rows)
        best, gain = None, 1e-9
        for c, p, n in _counted(rows, cuts):
            if not rule.conditions and c[0] in failed:
                continue
            if p >= least and (g := p * (math.log2((p + 0.1) / (n + 0.2)) - math.log2((p0 + 0.1) / (n0 + 0.2)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule = Rule((*rule.conditions, best))
        rows = [(r, b) for r, b in rows if rule.covers(r)]
    return rule


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = 4000, **options) -> list[Rule]:
    """Learns from at most ``sample`` labelled rows, those of the smallest hashes of their ids.

    ``labels``: ``id_col`` and ``label_col`` (1: good); rows without either are left out. The sample's ids are
    so few that they are broadcast, and only their statistics, a few numbers a row, come to the driver.
    """
    chosen = labels.select(id_col, label_col).dropna().dropDuplicates([id_col]).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample)
    joined = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = with_statistics(joined, text_col).select(id_col, label_col, *FEATURES).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).collect()
    return learn_rules([r.asDict() for r in rows], [r[label_col] == 0 for r in rows], **options)


def decision(rules: list[Rule]) -> Column:
    """The index of the first rule that covers a row, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].expression(), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.expression(), i)
    return out


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; ``rule`` is the number of the rule that rejects it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rules = fit_rules(docs, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_statistics(docs).withColumns({"base_failed": failed, "rule": decision(rules)})
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
