"""URL filters: stated host and path rules, then association rules mined by FP-growth, with DataFrame operations only.

A URL's tokens are its host labels (and their hyphenated parts), path segments, file ending
and query names; digits alone become one token. From labelled pages FP-growth finds token
combinations that go with blocked pages; those of enough support and confidence, without
the ones that a more general rule covers as well, are the rules. Each rule is posted under its
rarest token, so that a page meets only the rules that one of its tokens leads to; a
rule fits if the page has all its tokens.

The model is mined over every token that a rule can hold, those that stand in enough blocked
pages to meet the support by themselves, and no rule but the redundant ones is left out. Tokens
that always occur together are mined as one, and written out in the rules again.

Defined results: a null url, or one without ``://``, has empty host and path, no token, and
is allowed; repeated rows each get a row; without labelled pages no rule is mined; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SUPPORT, CONFIDENCE = 0.005, 0.8
_BLOCK = "!block"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, the start of a path, and whether such pages are blocked."""

    host: str
    path: str
    block: bool

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_ASCII)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (columns host and path), null if none does, and whether it blocks."""
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, block = F.when(fits, str(r)).otherwise(name), F.when(fits, F.lit(r.block)).otherwise(block)
    return name, block


def tokens(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    segments = F.split(F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}/?$", "")), "/")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})/?$", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))

    def tagged(tag: str, values: Column) -> Column:
        short = F.transform(values, lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
        return F.transform(F.filter(short, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    found = F.concat(tagged("h:", labels), tagged("h:", parts), tagged("p:", segments), tagged("e:", F.array(ending)), tagged("q:", names))
    return F.array_distinct(found)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, items: int | None = None) -> list[tuple[list[str], float, float]]:
    """(tokens by falling rarity, confidence, support) of the rules from ``labelled`` (tokens, blocked), over all tokens, or the ``items`` that tell most."""
    total, bad = labelled.agg(F.count(F.lit(1)), F.sum(F.col("blocked").cast("int"))).first()
    if not total or not bad:
        return []
    held = labelled.select(F.explode("tokens").alias("token"), F.col("blocked").cast("int").alias("b"), F.xxhash64("tokens").alias("x"), F.xxhash64(F.lit(1), "tokens").alias("y"))
    # Equal baskets hold the same tokens, so sums of basket hashes are equal just for tokens that always occur together.
    sums = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "xy")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bad"), *sums)
    rate = bad / total
    telling = F.pow(F.col("bad") - F.col("n") * rate, 2) / F.col("n")
    most = counts.where(F.col("n") >= max(1.0, support * total)) if items is None else counts.where(F.col("n") >= max(1.0, support * total)).orderBy(telling.desc(), "token").limit(items)
    chosen = sorted((r for r in most.collect() if r.bad >= support * total), key=lambda r: r.token)
    if not chosen:
        return []
    rarity, alike = {r.token: r.n for r in chosen}, {}
    for r in chosen:
        alike.setdefault((r.n, r.bad, r.x, r.y), []).append(r.token)
    classes = {c[0]: c for c in alike.values()}
    baskets = labelled.select(F.array_intersect("tokens", F.array(*map(F.lit, classes))).alias("items"), "blocked")
    baskets = baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(_BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(settle(baskets, "baskets"))
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCK))).select("antecedent", "confidence", "support").collect()
    kept: dict[str, list[tuple[frozenset, float, float]]] = {}
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        own = frozenset(r.antecedent)
        if not any(k < own and c >= r.confidence for t in own for k, c, _ in kept.get(t, ())):
            kept.setdefault(min(own), []).append((own, r.confidence, r.support))
    whole = ((own, c, s) for k, c, s in (rule for rules in kept.values() for rule in rules) for own in product(*(classes[t] for t in sorted(k))))
    return [(sorted(k, key=lambda t: (rarity[t], t)), c, s) for k, c, s in whole]


def match(rules: list[tuple[list[str], float, float]], found: Column) -> Column:
    """The best confidence of the rules whose tokens are all in ``found``, null without one. The index is a constant."""
    index: dict[str, list[dict]] = {}
    for tokens_, confidence, _ in rules:
        index.setdefault(tokens_[0], []).append({"t": tokens_, "c": confidence})
    if not index:
        return F.lit(None).cast("double")
    posted = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:array<string>,c:double>>>")
    met = F.flatten(F.transform(F.filter(found, lambda t: t.isin(list(index))), lambda t: F.element_at(posted, t)))
    return F.array_max(F.transform(F.filter(met, lambda r: F.size(F.array_except(r["t"], found)) == 0), lambda r: r["c"]))


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that blocks, else null).

    Learned from are the pages that ``rules`` decide, and besides these the pages that
    ``labels`` (page_id, blocked) names. The stated rules win over mined ones.
    """
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), tokens(F.col(url)).alias("tokens"))
    name, block = ruled(rules)
    seen = settle(seen.select("page_id", "host", "path", "tokens", name.alias("rule"), block.alias("blocked")), "urls")
    labelled = seen.where("blocked is not null").select("tokens", "blocked")
    if labels is not None:
        told = labels.select(F.col("page_id").alias("_id"), F.col("blocked").alias("_blocked")).where("_id is not null and _blocked is not null").groupBy("_id").agg(F.max("_blocked").alias("_blocked"))
        labelled = labelled.unionByName(seen.where("blocked is null").join(told, F.col("page_id") == F.col("_id")).select("tokens", F.col("_blocked").alias("blocked")))
    mined = mine(settle(labelled, "labelled"), support, confidence)
    best = F.when(F.col("blocked").isNull(), match(mined, F.col("tokens")))
    return seen.withColumn("confidence", best).select("page_id", "host", "path", "rule", F.when(F.coalesce(F.col("blocked"), F.col("confidence").isNotNull()), "block").otherwise("allow").alias("verdict"), "confidence")
