"""Secret scans with corpus-wide ownership frequency, with DataFrame operations only.

Candidates are what the base patterns and a few well-known key formats match. Each
candidate's value is hashed, and hashes are counted over the whole corpus by distinct
repositories and owners. A value is a copied example if ``WIDE_OWNERS`` owners hold it, or two
that keep it in ``WIDE_REPOS`` repositories together. Any other belongs to its owner (or two),
however many of that owner's repositories hold it, and is reported as a live credential unless it is a
placeholder; a bare hex run must look random besides. The base spans stay whatever the counts
say. Masking takes out the live ones.

A text's matches take time in proportion to its length and their number (by its logarithm), so
that a text of nothing but matches is no trouble.

Positions are code points, ends exclusive. Defined results: a null text is empty; an empty
text has no span; a null owner or repository counts as one owner or repository of its own;
rows with equal texts get equal spans, and each of their owners counts; repeated rows each get
a row; other columns are ignored by :func:`scan` and kept by :func:`redact`, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, let, named, running, settle

# The base kinds in their order (pattern, the value's group), then the method's own kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
KINDS = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("key", KEY, 0))
NAMES = ("assign", "access", "hex", "key", "live")
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|redacted|x{6}|0{6}|123456|abcdef"
#: Marks around a match and before its value, which no pattern matches.
MARK, VALUE = "\x01", "\x02"

#: Owners, or repositories of two owners, from which on a value is a copied example.
WIDE_OWNERS, WIDE_REPOS = 3, 4
#: Characters of the blocks in which a text is masked.
BLOCK = 1 << 14

SPAN = "array<struct<start:int,nth:int,end:int,vstart:int,value:string>>"
BARE = "array<struct<start:int,nth:int,end:int>>"


def _matches(text: Column, nth: int, pattern: str, group: int) -> Column:
    """The matches of one kind as an array of SPAN; text must not be null.

    Each match is put between marks with its value after it; the lengths of the pieces
    then give the places. Marks that stand in the text itself first give way to a
    character that is as long and matches as little.
    """
    plain = F.translate(text, MARK + VALUE, "~~")
    cut = F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{VALUE}${group}{MARK}"), MARK)
    pieces = F.transform(cut, lambda p, k: F.struct((k % 2 == 1).alias("inside"), F.length(F.substring_index(p, VALUE, 1)).alias("length"), F.when(k % 2 == 1, F.substring_index(p, VALUE, -1)).alias("value")))

    def spans(own: Column) -> Column:
        ends = running(F.transform(own, lambda p: p["length"]))
        one = lambda p, end: F.when(p["inside"], F.struct((end - p["length"]).alias("start"), F.lit(nth).alias("nth"), end.alias("end"), (end - F.length(p["value"])).alias("vstart"), p["value"].alias("value")))
        return F.filter(F.zip_with(own, ends, one), lambda x: x.isNotNull() & (F.length(x["value"]) >= (6 if group else 0)))

    return F.when(text.rlike(pattern), let(pieces, spans)).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All candidates in a text, by start and then by kind."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_matches(whole, n, p, g) for n, (_, p, g) in enumerate(KINDS))))


def _name(nth: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), nth + 1)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["nth"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str, text: str, owner: str, repository: Column) -> DataFrame:
    """(doc_id, owner, repo, text_hash, found) of each row; the hash is null where nothing was found."""
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), repository.cast("string").alias("repo"), F.col(text).alias("text")).withColumn("found", candidates(F.col("text")))
    return seen.select("doc_id", "owner", "repo", F.when(F.size("found") > 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_hash"), "found")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value_hash, repos, owners) over the whole corpus."""
    held = scanned.where("text_hash is not null").select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode("found.value").alias("value"))
    held = held.groupBy(F.sha2("value", 256).alias("value_hash"), "owner", "repo").agg(F.lit(1))
    return held.groupBy("value_hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def _credential(nth: Column, value: Column) -> Column:
    """An assignment or a key format tells a credential of any length, unless it is a placeholder or a run of one or two characters; hex alone must look random."""
    letters = F.size(F.array_distinct(F.split(value, "")))
    random = (F.length(value) >= 20) & (letters >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return ~value.rlike(PLACEHOLDER) & F.when(nth == NAMES.index("hex"), random).otherwise(letters >= 3)


def _copied() -> Column:
    return (F.col("owners") >= WIDE_OWNERS) | ((F.col("owners") == 2) & (F.col("repos") >= WIDE_REPOS))


def verdicts(scanned: DataFrame) -> DataFrame:
    """(text_hash, live, n_live, n_copied) by text with candidates: the value spans of live credentials, and how many candidates are copied examples."""
    texts = scanned.where("text_hash is not null").groupBy("text_hash").agg(F.first("found").alias("found"))
    each = settle(texts.select("text_hash", F.inline("found")).withColumn("value_hash", F.sha2("value", 256)), "values")
    judged = join_hot(each, ownership(scanned), "value_hash")
    span = F.struct(F.col("vstart").alias("start"), F.lit(len(NAMES) - 1).alias("nth"), "end")
    by = judged.groupBy("text_hash").agg(F.collect_set(F.when(~_copied() & _credential(F.col("nth"), F.col("value")), span)).alias("live"), F.count_if(_copied()).alias("n_copied"))
    return by.select("text_hash", F.array_sort("live").alias("live"), F.size("live").cast("bigint").alias("n_live"), "n_copied")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | None = None) -> DataFrame:
    """doc_id, base (array of spans), spans (all, with the live ones), n_live, n_copied of every row.

    ``repository`` tells an owner's repositories apart; without it each row is one.
    """
    repo = F.col(doc_id) if repository is None else repository
    scanned = settle(scan(docs, doc_id, text, owner, repo), "scanned")
    some = join_hot(scanned.where("text_hash is not null"), verdicts(scanned), "text_hash").select("doc_id", "found", "live", "n_live", "n_copied")
    none = scanned.where("text_hash is null").select("doc_id", "found", F.array().cast(BARE).alias("live"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_copied"))
    bare = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["nth"].alias("nth"), x["end"].alias("end")))
    both = some.unionByName(none).withColumn("found", bare)
    return both.select("doc_id", F.filter("found", lambda x: x["nth"] < 3).alias("base"), F.array_sort(F.concat("found", "live")).alias("spans"), "n_live", "n_copied")


def digest(found: DataFrame) -> DataFrame:
    """The columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of :func:`secrets`' result."""
    count = lambda n: F.size(F.filter("base", lambda x: x["nth"] == n)).cast("bigint")
    return found.select("doc_id", *(count(n).alias(f"n_{NAMES[n]}") for n in range(3)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def masked(text: Column, spans: Column, mask: str = "*") -> Column:
    """``text`` with ``spans`` covered. It is cut in blocks, each covered by the spans that reach it, so that no span copies more than a block."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))

    def cover(block: Column, k: Column, own: Column) -> Column:
        low = k * BLOCK

        def one(t: Column, s: Column) -> Column:
            a, b = F.greatest(s["start"] - low, F.lit(0)), F.least(s["end"] - low, F.length(t))
            return F.overlay(t, F.repeat(F.lit(mask), b - a), a + 1, b - a)

        return F.aggregate(F.filter(own, lambda s: (s["start"] < low + BLOCK) & (s["end"] > low)), block, one)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda own: F.array_join(F.transform(blocks, lambda b, k: cover(b, k, own)), "")))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | None = None, mask: str = "*") -> DataFrame:
    """``docs`` with every live credential masked in place, so that lengths and other spans hold; no row goes."""
    repo = F.col(doc_id) if repository is None else repository
    scanned = settle(scan(docs, doc_id, text, owner, repo), "scanned").withColumnRenamed("text_hash", "_hash")
    live = verdicts(scanned.withColumnRenamed("_hash", "text_hash")).where("n_live > 0").select(F.col("text_hash").alias("_hash"), "live")
    maybe = F.coalesce(F.col(text).rlike("|".join(f"(?:{p})" for p in (ASSIGN.replace("(?i)", "(?i:") + ")", ACCESS, HEX, KEY))), F.lit(False))
    rows = docs.select(F.struct(*named(docs)).alias("_row"), maybe.alias("_maybe"))
    own = F.col("_row")[text]
    hit = join_hot(rows.where("_maybe").withColumn("_hash", F.sha2(own, 256)), live, "_hash", "left", scanned.where("_hash is not null"))
    hit = hit.select(F.col("_row").withField(text, masked(own, F.coalesce("live", F.array().cast(BARE)), mask)).alias("_row"))
    return rows.where("not _maybe").select("_row").unionByName(hit).select("_row.*")


def _spans_sql(nth: int, pattern: str, group: int) -> str:
    """Matches of one kind: gaps between them and their lengths give the places."""
    p = pattern.replace("'", "''")
    return f"""
  select rid, {nth} as nth, i, m[i] as m, v[i] as v,
         coalesce(list_sum(list_transform(gaps[:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0) as start
  from (select rid, unnest(range(1, len(m) + 1)) as i, gaps, m, v from (
    select rid, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as v
    from d where regexp_matches(t, '{p}')))"""


ORACLE = f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as owner, concat_ws('/', source, lang) as repo, coalesce(text, '') as t from documents),
found as (
  select rid, nth, start, start + len(m) as stop, start + len(m) - len(v) as vstart, v from ({" union all ".join(_spans_sql(n, p, g) for n, (_, p, g) in enumerate(KINDS))})
  where nth <> 0 or len(v) >= 6),
held as (select v, count(distinct owner) as owners, count(distinct repo) as repos from found join d using (rid) group by 1),
own as (select v, owners >= {WIDE_OWNERS} or owners = 2 and repos >= {WIDE_REPOS} as copied from held),
live as (
  select distinct rid, 4 as nth, vstart as start, stop from found join own using (v)
  where not copied and not regexp_matches(v, '{PLACEHOLDER}') and len(list_distinct(string_split(v, ''))) >= 3
    and (nth <> 2 or len(v) >= 20 and len(list_distinct(string_split(v, ''))) >= 8 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]'))),
spans as (select rid, nth, start, stop from found union all select rid, nth, start, stop from live),
named as (select *, {list(NAMES)}[nth + 1] || ':' || start || ':' || stop as shown from spans),
by_row as (
  select rid, count(*) filter (nth = 0) as a, count(*) filter (nth = 1) as c, count(*) filter (nth = 2) as h, count(*) filter (nth = 4) as l,
         string_agg(shown, ',' order by start, nth) filter (nth < 3) as base, string_agg(shown, ',' order by start, nth, stop) as every
  from named group by 1),
copies as (select rid, count(*) as n from found join own using (v) where copied group by 1)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans, coalesce(l, 0)::bigint as n_live, coalesce(n, 0)::bigint as n_copied
from d left join by_row using (rid) left join copies using (rid)
"""
