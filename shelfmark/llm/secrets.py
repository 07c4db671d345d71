"""Secret scans with corpus-wide ownership frequency, in DataFrame functions throughout.

One pass finds candidates in every text: three fixed kinds (assignments, access keys, hex runs) and ``opaque``,
long mixed-class tokens. Only their positions and hashes leave that pass. The hashes are then aggregated by
repository and owner over the whole corpus: a value that several owners share, or several repositories of few
owners, is a copied example; one that stays with few and does not look like a placeholder counts as live. Opaque
tokens that turn out live become spans of the kind ``owned``.

Skew: the aggregation goes hash and owner and repository, hash and owner, hash, each with map-side partial
sums, so a value in a third of all rows arrives as a few rows for each task. Verdicts go back to the
candidates by a join that is salted on both sides. Positions in a text are running sums over its matches, made by
doubling (``n log n``), so a text that is nothing but candidates takes no longer for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, own_name, read_table

#: Fixed patterns of the base kinds, in the order that ties are listed in.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens of 20 characters or more; those with a lower-case letter, an upper-case letter and a digit are candidates.
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: What makes a value a placeholder, whoever has it.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|0000000|1234567|abcdefg"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:int,rank:int,stop:int,hash:string,placeholder:boolean>"
JUDGED = "struct<start:int,rank:int,stop:int,n_owners:bigint,n_repos:bigint,n_uses:bigint,live:boolean>"


def _mixed(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of each element and all before it, in ``n log n`` steps: spans of two, four, eight, ..."""
    reach = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(reach, values, lambda done, d: F.transform(done, lambda x, i: F.when(i >= d, combine(F.get(done, i - d), x)).otherwise(x)))


def found(text: Column, pattern: str, rank: int, accept: Callable[[Column], Column], group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans, if ``accept`` holds for their ``group``, whose
    value is hashed. Positions are code points: matches and what stands between them alternate.
    """
    gaps = F.transform(F.split(text, pattern), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.filter(F.zip_with(values, gaps, lambda v, gap: gap + F.length(v)), F.isnotnull)  # the last gap has no match
    stops = running(lengths, lambda before, own: before + own)
    steps = F.filter(F.arrays_zip(values.alias("v"), inner.alias("i"), stops.alias("stop")), lambda x: accept(x["i"]))
    span = lambda x: F.struct((x["stop"] - F.length(x["v"])).alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.sha2(x["i"], 256).alias("hash"), x["i"].rlike(PLACEHOLDER).alias("placeholder"))
    return F.when(text.rlike(pattern), F.transform(steps, span)).otherwise(F.array()).cast(f"array<{SPAN}>")


def free_of(wide: Column, base: Column) -> Column:
    """Spans of ``wide`` that touch none of ``base``: in order of their starts, no base span before one ends in it, and none after starts in it."""
    order = F.sort_array(F.concat(wide, base))
    fixed = lambda s, x, other: F.when(s["rank"] < 3, x).otherwise(other)
    ends = running(F.transform(order, lambda s: fixed(s, s["stop"], -1)), F.greatest)
    starts = F.reverse(running(F.reverse(F.transform(order, lambda s: fixed(s, s["start"], 2**31 - 1))), F.least))
    judged = F.arrays_zip(order.alias("s"), ends.alias("before"), starts.alias("after"))
    free = F.filter(judged, lambda x: (x["s"]["rank"] == 3) & (x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["stop"]))
    return F.when((F.size(wide) == 0) | (F.size(base) == 0), wide).otherwise(F.transform(free, lambda x: x["s"]))


def _rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["stop"])), ",")


def candidates(docs: DataFrame, text_col: str, repo: Column, owner: Column, keep: list[str]) -> DataFrame:
    """``kept, repo, owner, row_no, base, opaque``: the spans of every row, from one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = lambda value: F.lit(True)
    scanned = docs.select(
        F.struct(*keep).alias("kept"),
        repo.alias("repo"),
        owner.alias("owner"),
        F.sort_array(F.concat(found(text, ASSIGN, 0, lambda value: F.length(value) >= 8, group=1), found(text, ACCESS, 1, every), found(text, HEX, 2, every))).alias("base"),
        found(text, OPAQUE, 3, _mixed).alias("wide"),
    )
    return scanned.select("kept", "repo", "owner", F.monotonically_increasing_id().alias("row_no"), "base", free_of(F.col("wide"), F.col("base")).alias("opaque"))


def ownership(spans: DataFrame) -> DataFrame:
    """For each hash: distinct repositories and owners, and how often it occurs. ``spans``: ``hash, repo, owner``."""
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def scan_secrets(docs: DataFrame, text_col: str = "text", *, repo: Column, owner: Column, keep: list[str], example_owners: int = 3, example_repos: int = 4, salts: int = 16) -> DataFrame:
    """Spans of every row with what the corpus says of their values.

    Returns ``keep`` and ``base`` (spans of the fixed kinds, by start, then kind), ``owned`` (further spans
    whose values are live), ``n_live`` and ``n_example``, and ``judged``, every candidate by start, then kind, with
    the numbers of owners, repositories and uses of its value and whether it is live. A value that
    ``example_owners`` owners or ``example_repos`` repositories have is a copied example; any other is live if it is
    no placeholder. ``repo`` counts within its owner.

    Null or empty text: no spans. Null owners and repositories count as one owner or repository. Repeated
    rows are rows of their own. An empty table gives an empty result. ``keep`` may hold any names; a column of the
    result that one of them clashes with gets an underscore.
    """
    scratch = Scratch(docs.sparkSession)
    found_ = scratch.write(candidates(docs, text_col, repo, owner, keep), "secret-candidates")
    some = (F.size("base") > 0) | (F.size("opaque") > 0)
    each = found_.where(some).select("row_no", "repo", "owner", F.explode(F.concat("base", "opaque")).alias("span"))
    verdicts = ownership(each.select("span.hash", "repo", "owner")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = each.select("row_no", "span", F.col("span.hash").alias("hash"), F.pmod(F.col("row_no"), F.lit(salts)).cast("int").alias("salt"))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    judged = salted.join(verdicts, ["hash", "salt"]).withColumn("example", copied).withColumn("live", ~F.col("example") & ~F.col("span.placeholder"))
    by_row = judged.groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("span.rank") == 3), F.col("span")))).alias("owned"),
        F.count_if((F.col("span.rank") < 3) & F.col("live")).alias("n_live"),
        F.count_if((F.col("span.rank") < 3) & F.col("example")).alias("n_example"),
        F.sort_array(F.collect_list(F.struct("span.start", "span.rank", "span.stop", "n_owners", "n_repos", "n_uses", "live"))).alias("judged"),
    )
    # Only rows with candidates meet the join; the others, nearly all, pass without a shuffle.
    spans, no_verdicts, zero = F.array().cast(f"array<{SPAN}>"), F.array().cast(f"array<{JUDGED}>"), F.lit(0).cast("bigint")
    results = ("base", "owned", "n_live", "n_example", "judged")
    held = found_.where(some).join(by_row, "row_no").select("kept", *results)
    out = held.unionByName(found_.where(~some).select("kept", "base", spans.alias("owned"), zero.alias("n_live"), zero.alias("n_example"), no_verdicts.alias("judged")))
    return out.select("kept.*", *(F.col(c).alias(own_name(docs.select(*keep), c)) for c in results))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document, with the digest of the fixed kinds."""
    docs = read_table(spark, sf_dir, "documents")
    scanned = scan_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"), keep=["doc_id"])
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"),
        _rendered(F.sort_array(F.concat("base", "owned"))).alias("spans"),
        "n_live",
        "n_example",
    )


def drop_live_secrets(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a live value; columns as they were.

    Takes the options of ``scan_secrets`` but ``keep``. Rows whose values are all examples or placeholders stay.
    """
    packed = own_name(docs, "row")
    scanned = scan_secrets(docs.withColumn(packed, F.struct(*docs.columns)), text_col, keep=[packed], **options)
    return scanned.where((F.col("n_live") == 0) & (F.size("owned") == 0)).select(f"{packed}.*")


_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_PATTERNS = (
    ("assign", rf"""({_KEYWORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]{12,}", 0),
    ("hex", "[0-9a-f]{32,}", 0),
    ("owned", "[A-Za-z0-9+/_-]{20,}", 0),
)
_MATCHES = " UNION ALL ".join(f"SELECT r, source, lang, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS v, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')" for rank, (kind, p, group) in enumerate(_PATTERNS))

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
e AS (
  SELECT r, source, lang, rank, kind, v[i] AS value, g[i] AS inside,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m)),
s AS (
  SELECT *, start + length(value) AS stop, sha256(inside) AS hash FROM e
  WHERE CASE kind WHEN 'assign' THEN length(inside) >= 8 WHEN 'access' THEN length(value) >= 16 WHEN 'hex' THEN length(value) >= 32
        ELSE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') END),
c AS (SELECT * FROM s WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.rank < 3 AND b.start < s.stop AND s.start < b.stop)),
o AS (SELECT hash, count(DISTINCT source) AS n, count(DISTINCT (source, lang)) AS repos FROM c GROUP BY hash),
j AS (SELECT c.*, n, repos, n < 3 AND repos < 4 AND NOT regexp_matches(inside, '{PLACEHOLDER}') AS live FROM c JOIN o USING (hash))
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3 OR live), '') AS spans,
       count(*) FILTER (rank < 3 AND live) AS n_live, count(*) FILTER (rank < 3 AND (n >= 3 OR repos >= 4)) AS n_example
FROM d LEFT JOIN j USING (r) GROUP BY r, doc_id
"""
