"""Personal data in plain and in disguised form, with spans in the characters of the source text.

Plain identifiers are found in the text as it is. A chain of transducers then rewrites character codes,
look-alike characters, spelled digits and at/dot disguises; each keeps, for every character that it writes, the
source characters that it stands for. Identifiers that only the rewritten text shows map back to source spans by
that. Texts without any disguise, nearly all, are only searched for the disguises' triggers.

A row is handled by itself (whole texts, linear time, no shuffle), so memory is one Arrow batch.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, read_table

KINDS = ("email", "ip", "card", "phone")

# The patterns of the kinds; an e-mail's local part is found from its @ backwards.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХҮаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ",
        "ABESIJKMHOPCTXYaesijopcyxhdqwABEZHIKMNOPTYXaovp",
        strict=True,
    )
)
#: Characters without width.
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Those, wide and mathematical forms of ASCII, and the decimal digits of other scripts.
LOOKS = re.compile(f"[{''.join(LOOKALIKES)}{HIDDEN}！-～\U0001d400-\U0001d7ff]|(?![0-9])\\d")

#: Character references and percent codes of the at sign, dot, plus, hyphen and digits.
CODED = re.compile(r"&(?:#0*(?:64|4[356]|48|49|5[0-7])|#x0*(?:40|2b|2d|2e|3[0-9])|commat|period|plus);|%(?:40|2e|2b)", re.IGNORECASE)

# Digits in words, from 0 to 9, in English, German, French and Spanish.
SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0"}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_DOT = r"(?:[\x20\t]+(?:dot|point|punkt|punto)[\x20\t]+)"
_SEP = r"[\x20\t-]{1,3}"
_SPELT = rf"(?:{_WORD})(?!\w)"
_LINK = rf"(?:{_DOT}|{_SEP})"
#: Spelled digits that adjoin numbers or a plus, with the numbers that follow; of words alone, four or more in a row.
DIGITS = re.compile(
    rf"(?<!\w)(?:(?:plus{_SEP}|\+[\x20\t-]{{0,3}})(?:[0-9]+{_LINK}){{0,14}}{_SPELT}|[0-9]++(?=(?:{_DOT}[0-9]+){{0,2}}{_LINK}{_SPELT})|{_SPELT}(?=(?:{_LINK}{_SPELT})*+{_LINK}[0-9]|(?:{_LINK}{_SPELT}){{3}}))(?:{_LINK}(?:{_SPELT}|[0-9]+))*",
    re.IGNORECASE,
)
_DIGIT_PART = re.compile(rf"{_DOT}|[\x20\t-]+|plus|\+|{_WORD}|[0-9]+", re.IGNORECASE)
_BRACKET_AT = r"\s{0,3}[\[({<]\s?(?:at|arroba|ät|@)\s?[\])}>]\s{0,3}"
_BRACKET_DOT = r"\s{0,3}[\[({<]\s?(?:dot|point|punkt|punto|\.)\s?[\])}>]\s{0,3}"
_WORD_AT, _WORD_DOT = r"\s{1,3}at\s{1,3}", r"\s{1,3}dot\s{1,3}"
_ANY_DOT = rf"(?:{_BRACKET_DOT}|{_WORD_DOT}|\.)"
_HIDDEN_DOT = rf"(?:{_BRACKET_DOT}|{_WORD_DOT})"
# Limits: 64 characters of a name and 63 of a label, as addresses have them; three dots in a name, five labels, and
# three blanks around a word or bracket. They keep the search linear; a disguise beyond them is not found.
_NAME, _LABEL = r"[A-Za-z0-9_%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
#: A bracketed at, or the word at or a plain @ before a domain with a disguised dot, or the word at before a plain
#: domain if what precedes it has letters and an inner dot, a digit or an underscore, as in no plain prose.
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?:{_NAME}(?:{_ANY_DOT}{_NAME}){{0,3}}(?:(?:{_BRACKET_AT}){_LABEL}(?:{_ANY_DOT}{_LABEL}){{1,4}}|(?:{_WORD_AT}|@){_LABEL}(?:\.{_LABEL}){{0,2}}{_HIDDEN_DOT}{_LABEL}(?:{_ANY_DOT}{_LABEL}){{0,2}})"
    rf"|(?=[0-9_%+.-]*[A-Za-z])(?:{_NAME}(?:{_ANY_DOT}{_NAME}){{1,3}}|(?=[A-Za-z%+-]*[0-9_]){_NAME}){_WORD_AT}{_LABEL}(?:\.{_LABEL}){{0,3}}\.[A-Za-z]{{2,63}}(?![A-Za-z0-9-]))",
    re.IGNORECASE,
)
_ADDRESS_PART = re.compile(rf"(?P<at>{_BRACKET_AT}|{_WORD_AT}|@)|(?P<dot>{_ANY_DOT})|(?P<name>{_NAME})", re.IGNORECASE)
# Words that stand before "at" in prose, where a lone word before "at ... dot ..." is no name.
PROSE = frozenset(
    "look looks looked looking meet meets met meeting see seen saw find finds found finding available hosted located live lives lived living stay stays stayed "
    "work works worked working arrive arrives arrived start starts started starting stop stops stopped read reads buy bought sell sold shop order ordered visit "
    "visited call called get gets got be is are was were been being am online published posted listed register registered sign signed log logged apply us me you "
    "him her it them we they i and or but not only also here there now today then more up out back down again later info information details site page website".split()
)
TRIGGER = re.compile(rf"[\[({{<]\s?(?:at|arroba|ät|@|dot|point|punkt|punto|\.)\s?[\])}}>]|(?:@|\sat\s{{1,3}})[A-Za-z0-9.-]{{1,253}}\s{{1,3}}dot\s|\sat\s{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9]", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def plain(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(kind, start, stop)`` of the text as it stands, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


class Rewritten:
    """A text that transducers have rewritten; ``start[i]`` and ``stop[i]``: the source of its character i."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text))
        self.stop = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def apply(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace every match by what ``write`` gives: strings, each with the span of this text that it stands for."""
        texts, starts, stops, changed, at = [], [], [], [], 0

        def keep(to: int) -> None:
            texts.append(self.text[at:to])
            starts.append(self.start[at:to])
            stops.append(self.stop[at:to])
            changed.append(self.changed[at:to])

        for m in pattern.finditer(self.text):
            keep(m.start())
            for new, a, b in write(m):
                if new:
                    texts.append(new)
                    starts.append(np.full(len(new), self.start[a]))
                    stops.append(np.full(len(new), self.stop[b - 1]))
                    changed.append(np.full(len(new), new != self.text[a:b] or self.changed[a:b].any()))
            at = m.end()
        if at:
            keep(len(self.text))
            self.text = "".join(texts)
            self.start, self.stop, self.changed = map(np.concatenate, (starts, stops, changed))


def _look(m: re.Match) -> list[tuple[str, int, int]]:
    c = m[0]
    if c.isdecimal():
        new = str(unicodedata.decimal(c))
    elif "！" <= c <= "～":
        new = chr(ord(c) - 0xFEE0)
    elif c >= "\U0001d400":
        new = unicodedata.normalize("NFKC", c)
        new = new if new.isascii() else c
    else:
        new = LOOKALIKES.get(c, "")
    return [(new, *m.span())]


def _coded(m: re.Match) -> list[tuple[str, int, int]]:
    new = html.unescape(m[0]) if m[0][0] == "&" else chr(int(m[0][1:], 16))
    return [(new if len(new) == 1 else m[0], *m.span())]


def _number(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    parts = [(p[0].lower().strip(), m.start() + p.start(), m.start() + p.end()) for p in _DIGIT_PART.finditer(m[0])]
    for word, a, b in parts:
        new = SPELLED.get(word, "+" if word in ("plus", "+") else "." if word in ("dot", "point", "punkt", "punto") else word if word.isdecimal() else "")
        out.append((new, a, b))
    return out


def _address(m: re.Match) -> list[tuple[str, int, int]]:
    parts = list(_ADDRESS_PART.finditer(m[0]))
    if parts[0][0].lower() in PROSE and parts[1].lastgroup == "at" and parts[1][0].strip().lower() == "at":
        return [(m[0], *m.span())]
    return [("@" if p.lastgroup == "at" else "." if p.lastgroup == "dot" else p[0], m.start() + p.start(), m.start() + p.end()) for p in parts]


def disguised(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Source spans of what only the rewritten text shows.

    No span of its kind in ``found`` touches it, but that an e-mail address may be longer than the part of it that
    is found in plain: ``b@x.org`` where a letter before the ``b`` is of another script.
    """
    looks, digits, trigger = not text.isascii() and LOOKS.search(text), DIGITS.search(text), TRIGGER.search(text)
    coded = ("&" in text or "%" in text) and CODED.search(text)
    if not (looks or digits or trigger or coded):
        return []
    out = Rewritten(text)
    if coded:
        out.apply(CODED, _coded)
    if looks:
        out.apply(LOOKS, _look)
    out.apply(DIGITS, _number)
    if trigger or TRIGGER.search(out.text):
        out.apply(ADDRESS, _address)
    added = []
    for kind, a, b in plain(out.text):
        span = (kind, int(out.start[a]), int(out.stop[b - 1]))
        if out.changed[a:b].any() or span[2] - span[1] != b - a:  # rewritten, or something in it was dropped
            touched = [(x, y) for k, x, y in found + added if k == kind and x < span[2] and span[1] < y]
            if not touched or (kind == 0 and all(span[1] <= x and y <= span[2] and (x, y) != span[1:] for x, y in touched)):
                added.append(span)
    return added


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns) and ``pii``, the spans by kind, then start: ``kind, start, stop, base``.

    Kinds are numbered as in ``KINDS``; positions are code points, ``stop`` is exclusive; ``base`` spans stand
    in the text as it is, the others in disguise. Null or empty texts have no spans, repeated rows are rows
    of their own, an empty table gives an empty result. If ``docs`` has a column ``pii``, the new one is
    ``pii_``.
    """
    keep = keep if keep is not None else docs.columns
    kept = docs.select(*keep)
    name = own_name(kept, "pii")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base = plain(text) if text else []
                added = disguised(text, base) if text else []
                rows.append([{"kind": k, "start": a, "stop": b, "base": i < len(base)} for (k, a, b), i in sorted(zip(base + added, range(len(base) + len(added)), strict=True))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, SPANS)], names=[*batch.schema.names[:-1], name])

    return docs.select(*keep, F.col(text_col).alias(own_name(kept, "_text"))).mapInArrow(run, f"{schema}, `{name}` array<struct<kind:int,start:bigint,stop:bigint,base:boolean>>")


def _rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def _counted(spans: Column, kind: int) -> Column:
    # The lambda takes the span alone: a second parameter, defaults included, would be the span's place in the array.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier of every document; counts and digest are of the base spans."""
    found = detect(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    count = [_counted(base, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_rendered(base), 256).alias("base_sha256"), _rendered(F.col("pii")).alias("spans"), (F.size("pii") - F.size(base)).cast("long").alias("n_disguised"))
