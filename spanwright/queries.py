"""Registered queries of the span-policy operators, over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import labels as L
from .functions import spans as S
from .operators import annotations as A
from .operators import audit as U
from .operators import curricula as C
from .operators import policy as P
from .operators import routing as R
from .operators import splits as D
from .operators import tagging as T
from .operators import validation as V
from .operators.anchor import threshold_grid
from .schema import ANCHOR_THRESHOLDS, CRITICAL_LABELS, EXPERTS, LABELS, SAMPLE, TAGS, TRIM_CHARACTERS
from .sources import jsonl, sinks
from .sources.sinks import settle

#: Curricula with quotas small enough to bind on small tables.
SMALL = {
    "coverage": {"demographic": 40, "address": 30, "person": 30, "critical_risk": 60, "high_risk": 80, "no_pii": 10, "long_text": 40, "common": 100, "filler": 200},
    "precision": {"hard_negative": 60, "numeric_negative": 20, "no_pii": 30, "low_density": 40, "critical_risk": 20, "common": 30, "filler": 150},
}
ROUTES = {f"src{k}": ("precision" if k % 2 else "coverage") for k in range(0, 20, 3)}


def _gold(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    rows = X.beside(spark, sf_dir) if beside else X.annotated(spark, sf_dir)
    return rows.select("sample_id", L.source_prefix(F.col("sample_id")).alias("dataset"), "text", S.gold_spans(F.col("pii_annotations")).alias("gold"), *beside)


def _details(spark: SparkSession, sf_dir: str, expert: str = "anchor") -> DataFrame:
    return U.single(_gold(spark, sf_dir), X.predictions(spark, sf_dir, expert))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 digits: sums over partitions have no fixed order."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = X.PRELUDE + oracle
        return f

    return register


@query("select upper(replace(replace(trim(label), ' ', '_'), '-', '_')) as label, count(*)::bigint as n from ann group by 1")
def normalize_labels(spark, sf_dir):
    rows = X.annotated(spark, sf_dir).select(F.explode("pii_annotations.label").alias("raw"))
    return rows.groupBy(L.normalize_label(F.col("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select split_part(sample_id, ':', 1) as source, count(*)::bigint as n from samples group by 1")
def source_prefix(spark, sf_dir):
    return X.samples(spark, sf_dir).groupBy(L.source_prefix(F.col("sample_id")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("select risk_band, sum(bw)::double as weight, count(*) filter (risk_band = 'CRITICAL')::bigint as critical from ann group by 1")
def risk_weights(spark, sf_dir):
    rows = X.annotated(spark, sf_dir).select(F.explode("pii_annotations.risk_band").alias("risk_band"))
    return rows.groupBy("risk_band").agg(F.sum(L.band_weight(F.col("risk_band"))).alias("weight"), F.count_if(L.is_critical(F.col("risk_band"))).alias("critical"))


_SPLIT = """
, v as (select sample_id, ('0x' || substr(sha256('1337:' || sample_id), 1, 16))::ubigint::double / 18446744073709551616 as x from samples),
s as (select sample_id, case when x < {0} then 'development' when x < {0} + {1} then 'heldout' else 'training' end as split from v)
"""


@query(_SPLIT.format(0.02, 0.02) + "select sample_id, split from s")
def split_assignment(spark, sf_dir):
    return D.with_split(X.samples(spark, sf_dir).select("sample_id"))


@query(_SPLIT.format(0.02, 0.02) + "select split, split_part(sample_id, ':', 1) as source, count(*)::bigint as n from s group by all")
def split_counts(spark, sf_dir):
    return D.split_counts(X.samples(spark, sf_dir))


@query('select sample_id, start::bigint as start, "end"::bigint as "end", label, risk_band, weight, critical_for_pcr from train')
def policy_span_filter(spark, sf_dir):
    return A.training_records(X.annotated(spark, sf_dir)).select("sample_id", F.inline("train_spans"))


@query(
    """, r as (select case when name = 'CONTEXT_MISC' then 'context_misc' when not coalesce(pcr_in_scope, false) then 'out_of_scope'
                         when coalesce(weight, 0) <= 0 then 'zero_weight' when name = 'SOMETHING_ELSE' then 'unknown' end as reason from ann)
    select reason, count(*)::bigint as n from r where reason is not null group by 1"""
)
def reject_reasons(spark, sf_dir):
    return A.reject_reasons(X.annotated(spark, sf_dir))


_EDGE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_BUCKETS = rf"""
, lab as (select sample_id, list(distinct label) as labels, list(distinct risk_band) as bands, bool_or(critical_for_pcr) as crit,
                 count(*) as n, sum("end" - start) as chars from train group by 1),
f as (select s.sample_id, text, coalesce(labels, []) as labels, coalesce(bands, []) as bands, coalesce(crit, false) as crit, coalesce(n, 0) as n, coalesce(chars, 0) as chars
      from samples s left join lab using (sample_id)),
neg as (
  select *,
    regexp_matches(text, '{_EDGE[0]}(?:(?:19|20)[0-9]{{2}}[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12][0-9]|3[01])[-/](?:19|20)?[0-9]{{2}}){_EDGE[1]}')
      and not list_has_any(labels, ['DATE_TIME', 'OFFICIAL_ID']) as date_n,
    regexp_matches(text, '{_EDGE[0]}[0-9][0-9 -]{{5,}}[0-9]{_EDGE[1]}')
      and not list_has_any(labels, ['OFFICIAL_ID', 'FINANCIAL_ACCOUNT', 'AUTH_SECRET', 'TRANSACTION_ASSET', 'CONTACT']) as num_n,
    regexp_matches(text, '(?i){_EDGE[0]}(?:street|st|road|rd|avenue|ave|boulevard|blvd|city|county|state|province|zip|postal|district|north|south|east|west){_EDGE[1]}')
      and not list_contains(labels, 'ADDRESS_GEO') as geo_n,
    regexp_matches(text, '(?i){_EDGE[0]}(?:university|bank|hospital|inc|corp|company|agency|department|team|school|office|committee){_EDGE[1]}')
      and not list_has_any(labels, ['PERSON_NAME', 'ACCOUNT_HANDLE', 'ADDRESS_GEO']) as amb_n
  from f),
flags as (
  select sample_id, unnest([
    case when list_contains(labels, 'HEALTH_MEDICAL') then 'health' end, case when list_contains(labels, 'AUTH_SECRET') then 'auth' end,
    case when list_contains(labels, 'OFFICIAL_ID') then 'official' end, case when list_contains(labels, 'FINANCIAL_ACCOUNT') then 'financial' end,
    case when list_contains(labels, 'DIGITAL_ID') then 'digital' end, case when list_contains(labels, 'CONTACT') then 'contact' end,
    case when list_contains(labels, 'DEMOGRAPHIC_PROFILE') then 'demographic' end, case when list_contains(labels, 'ADDRESS_GEO') then 'address' end,
    case when list_contains(labels, 'PERSON_NAME') then 'person' end, case when list_contains(labels, 'TRANSACTION_ASSET') then 'transaction' end,
    case when crit or list_contains(bands, 'CRITICAL') then 'critical_risk' end, case when list_has_any(bands, ['CRITICAL', 'HIGH']) then 'high_risk' end,
    case when len(text) >= 500 then 'long_text' end, case when n = 0 then 'no_pii' end,
    case when n > 0 and (n <= 2 or chars / greatest(1, len(text)) <= 0.02) then 'low_density' end,
    case when date_n then 'date_negative' end, case when num_n then 'numeric_negative' end,
    case when geo_n then 'geographic_negative' end, case when amb_n then 'ambiguous_negative' end,
    case when date_n or num_n or geo_n or amb_n then 'hard_negative' end,
    case when list_has_any(labels, ['PERSON_NAME', 'CONTACT', 'ADDRESS_GEO', 'OFFICIAL_ID', 'HEALTH_MEDICAL']) then 'common' end]) as bucket
  from neg),
bk as (select * from flags where bucket is not null union all select sample_id, 'filler' from samples)
"""


@query(_BUCKETS + "select sample_id, bucket from bk where bucket <> 'filler'")
def bucket_flags(spark, sf_dir):
    rows = A.training_records(X.annotated(spark, sf_dir))
    return rows.select("sample_id", F.explode(A.buckets(F.col("text"), F.col("train_spans"))).alias("bucket"))


@query(_BUCKETS + "select bucket, count(*)::bigint as n from bk group by 1")
def bucket_counts(spark, sf_dir):
    return C.bucketed(X.annotated(spark, sf_dir)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_SPECS = ", spec as (select * from (values " + ", ".join(f"('{s}', '{b}', {q}, {k}, {quotas['filler']})" for s, quotas in SMALL.items() for k, (b, q) in enumerate(quotas.items())) + ") t(spec, bucket, quota, prio, target))"
_RESERVOIR = (
    _BUCKETS
    + _SPECS
    + """, res as (
  select spec, bk.bucket, prio, target, quota, sample_id, substr(md5(sample_id), 1, 16) as rank from bk join spec using (bucket)
  qualify row_number() over (partition by spec, bucket order by substr(md5(sample_id), 1, 16), sample_id) <= quota)
"""
)
_FILL = (
    _RESERVOIR
    + """, once as (select spec, sample_id, rank, min(prio) as prio, max(target) as target from res group by all),
  fill as (select * from once qualify row_number() over (partition by spec order by prio, rank, sample_id) <= target)
"""
)


@query(_RESERVOIR + "select spec, bucket, sample_id, rank from res")
def stable_reservoir(spark, sf_dir):
    kept = C.reservoirs(settle(C.bucketed(X.annotated(spark, sf_dir)), "buckets"), C.spec_table(spark, SMALL))
    return kept.select("spec", "bucket", "sample_id", "rank")


@query(_FILL + "select spec, sample_id, rank, prio::bigint as prio from fill")
def curriculum_fill(spark, sf_dir):
    return C.build(X.annotated(spark, sf_dir), SMALL)


@query(_SPLIT.format(0.1, 0.1) + "select sample_id, len(text)::bigint as text_len from samples where sample_id not in (select sample_id from s where split <> 'training')")
def leakage_filtered_training(spark, sf_dir):
    rows = X.samples(spark, sf_dir)
    held = D.with_split(rows.select("sample_id"), development=0.1, heldout=0.1)
    excluded = held.where("split = 'development'").unionByName(held.where("split = 'heldout'"))
    return C.without(rows, excluded).select("sample_id", F.length("text").alias("text_len"))


_ALIGNED = """
, al as (
  select b.sample_id, b.start, b."end", t.label, t.risk_band, t.start as ts
  from sub b left join train t on b.sample_id = t.sample_id and b.start < t."end" and t.start < b."end"
  qualify row_number() over (partition by b.sample_id, b.start, b."end" order by
    least(b."end", t."end") - greatest(b.start, t.start) desc,
    case t.risk_band when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end desc,
    list_position(['ADDRESS_GEO', 'PERSON_NAME', 'ACCOUNT_HANDLE', 'DEMOGRAPHIC_PROFILE', 'TRANSACTION_ASSET', 'DIGITAL_ID', 'CONTACT', 'HEALTH_MEDICAL', 'OFFICIAL_ID', 'FINANCIAL_ACCOUNT', 'AUTH_SECRET'], t.label) desc,
    t."end" - t.start desc, t.k) = 1),
tagged as (
  select sample_id, start, "end",
         case when label is null then 0 else list_position(%s, case when start = ts then 'B-' else 'I-' end || label) - 1 end as label_id,
         case when label is null then 0.15 else
           case label when 'PERSON_NAME' then 1.4 when 'ACCOUNT_HANDLE' then 1.8 when 'CONTACT' then 1.5 when 'ADDRESS_GEO' then 1.4 when 'OFFICIAL_ID' then 4.0
                      when 'FINANCIAL_ACCOUNT' then 4.5 when 'AUTH_SECRET' then 5.0 when 'DIGITAL_ID' then 3.0 when 'DEMOGRAPHIC_PROFILE' then 2.7
                      when 'HEALTH_MEDICAL' then 6.5 else 3.0 end::double
           * case risk_band when 'CRITICAL' then 2.4 when 'HIGH' then 1.8 when 'MEDIUM' then 1.35 else 1.0 end::double end::double as loss_weight
  from al)
""" % list(TAGS)


def _tokens(spark, sf_dir):
    """Each candidate's two halves beside the spans of their sample; one row each way, no shuffle."""
    return X.subtokens(X.found(spark, sf_dir).withColumn("train_spans", A.train_spans(X._annotations())), "train_spans").select("sample_id", "start", "end", "train_spans")


@query(_ALIGNED + 'select sample_id, start::bigint as start, "end"::bigint as "end", label_id::bigint as label_id, round(loss_weight, 9) as loss_weight from tagged')
def token_alignment(spark, sf_dir):
    return T.aligned(_tokens(spark, sf_dir))


@query(
    _ALIGNED
    + """select round(sum(loss_weight * -ln((1 + label_id) / 24.0::double)) / greatest(sum(loss_weight), 1), 9) as loss from tagged"""
)
def weighted_cross_entropy(spark, sf_dir):
    rows = T.aligned(_tokens(spark, sf_dir))
    return T.weighted_cross_entropy(rows.withColumn("p", (1 + F.col("label_id")) / F.lit(24.0)))


_AVERAGE = f"""
, av0 as (select sample_id, start, "end", i, avg(p) as p from (select sample_id, start, "end", unnest(range({len(TAGS)})) as i, unnest(probs) as p from win) group by all),
av as (select sample_id, start, "end", arg_max(i, (p, -i)) as label_id, max(p) as score from av0 group by all)
"""
_DECODE = (
    _AVERAGE
    + f"""
, e0 as (select *, {list(TAGS)}[label_id + 1] as tag from av),
e1 as (select *, case when label_id > 0 then substr(tag, 3) end as entity from e0),
e2 as (select *, lag(entity) over w as le, lag("end") over w as lend from e1 window w as (partition by sample_id order by start, "end")),
e3 as (select *, sum(case when entity is not null and (tag[1] = 'B' or le is null or le <> entity or start > lend) then 1 else 0 end)
                 over (partition by sample_id order by start, "end") as island from e2),
e4 as (select sample_id, island, min(start) as start, max("end") as "end", min(entity) as label, avg(score) as score from e3 where entity is not null group by all),
dec as (select * from e4 where start < "end" qualify row_number() over (partition by sample_id, start, "end", label order by island) = 1)
"""
)


@query(_AVERAGE + 'select sample_id, start::bigint as start, "end"::bigint as "end", label_id::bigint as label_id, round(score, 9) as score from av')
def window_average_argmax(spark, sf_dir):
    return T.averaged(X.windows(spark, sf_dir))


@query(_DECODE + 'select sample_id, island::bigint as ordinal, start::bigint as start, "end"::bigint as "end", label, round(score, 9) as score from dec')
def bio_decode(spark, sf_dir):
    return T.decoded(T.averaged(X.windows(spark, sf_dir)))


FLOORS = {"PERSON_NAME": 2.2, "CONTACT": 2.5}


@query(_DECODE + "select label, count(*)::bigint as n from dec where round(score, 9) >= case label when 'PERSON_NAME' then 2.2 when 'CONTACT' then 2.5 else 0 end group by 1")
def span_score_floor(spark, sf_dir):
    spans = T.decoded(T.averaged(X.windows(spark, sf_dir))).withColumn("score", F.round("score", 9))
    return T.floored(spans, FLOORS).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_THRESHOLDS = "case label " + " ".join(f"when '{k}' then {v}" for k, v in ANCHOR_THRESHOLDS.items()) + " end"
_TRIM = TRIM_CHARACTERS.replace("'", "''")
_REFINE = f"""
, r0 as (select p.*, substr(text, p.start + 1, p."end" - p.start) as inside from pred p join samples using (sample_id) where expert = 'anchor'),
r1 as (select *, len(inside) - len(ltrim(inside, '{_TRIM}')) as l, len(trim(inside, '{_TRIM}')) as n from r0)
"""


@query(
    _REFINE
    + f"""select distinct sample_id, (case when n = 0 then start else start + l end)::bigint as start,
       (case when n = 0 then "end" else start + l + n end)::bigint as "end", label from r1 where score >= {_THRESHOLDS}"""
)
def anchor_refine(spark, sf_dir):
    rows = X.beside(spark, sf_dir).select("sample_id", "text", F.col("spans_anchor").alias("pred_spans"))
    return rows.select("sample_id", F.inline(S.refine(F.col("text"), F.col("pred_spans"), ANCHOR_THRESHOLDS, TRIM_CHARACTERS)))


STEPS = {label: (-0.04, 0.04, 0.04) if label in CRITICAL_LABELS else (-0.05, 0.0, 0.05) for label in LABELS}


def _grid(spark):
    return threshold_grid(spark, ANCHOR_THRESHOLDS, STEPS, dict.fromkeys(LABELS, 0.2))


_GRID = (
    ", base as (select * from (values " + ", ".join(f"('{k}', {t}, {n})" for n, (k, t) in enumerate(ANCHOR_THRESHOLDS.items())) + ") t(label, was, ord)),"
    " step as (select * from (values " + ", ".join(f"('{k}', {by}, {n})" for k, own in STEPS.items() for n, by in enumerate(own)) + """) t(label, plus, nth)),
  moved as (select label, ord, min(nth) as nth, round(greatest(0.2, least(0.95, was + plus)), 4) as threshold from base join step using (label) group by all having threshold <> any_value(was)),
  policies as (select row_number() over (order by ord, nth) as policy, label as moved, threshold as x from moved union all select 0, null, null),
  grid as (select policy, label, (case when moved = label then x else was end)::double as threshold from policies, base)
"""
)


@query(_GRID + "select policy::bigint as policy, label, count(*)::bigint as n from pred join grid using (label) where expert = 'anchor' and score >= threshold group by all")
def threshold_sweep(spark, sf_dir):
    """How many spans each policy of the grid keeps; the grid (a policy for each label and step) is a small table."""
    spans = X.predictions(spark, sf_dir, "anchor").select(F.inline("pred_spans"))
    return spans.join(F.broadcast(_grid(spark)), "label").where("score >= threshold").groupBy("policy", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_GRID + "select policy::bigint as policy, label, threshold from grid")
def threshold_policy_grid(spark, sf_dir):
    return _grid(spark)


def _match_sql(tolerance: int, aware: bool, name: str, experts: str = "'anchor'") -> str:
    """Greedy matching as a recursion over gold spans by weight, carrying the pairs found."""
    return f"""
, {name}_g as (select *, row_number() over (partition by sample_id order by -weight, g) as ord from gold),
{name}_p as (select expert, sample_id, list({{'s': start, 'e': "end", 'l': label, 'p': p}} order by p) as preds from pred where expert in ({experts}) group by all),
{name}_r as (
  select e.expert, s.sample_id, 0 as ord, []::struct(g int, p int)[] as done, coalesce(pp.preds, []) as preds
  from (select distinct sample_id from gold) s cross join (select expert from experts where expert in ({experts})) e
  left join {name}_p pp on pp.sample_id = s.sample_id and pp.expert = e.expert
  union all
  select r.expert, r.sample_id, r.ord + 1,
         case when len(b) = 0 then r.done else list_append(r.done, {{'g': r.g, 'p': b[1].p}}) end, r.preds
  from (
    select r.*, g.g, list_sort(list_transform(list_filter(r.preds, lambda x:
             {"x.l = g.label and" if aware else ""} not list_contains(list_transform(r.done, lambda d: d.p), x.p)
             and (least(x.e, g."end") > greatest(x.s, g.start) or least(abs(x.e - g.start), abs(g."end" - x.s)) <= {tolerance})),
             lambda x: {{'o': -greatest(0, least(x.e, g."end") - greatest(x.s, g.start)),
                         'n': case when least(x.e, g."end") > greatest(x.s, g.start) then 0 else least(abs(x.e - g.start), abs(g."end" - x.s)) end, 'p': x.p}})) as b
    from {name}_r r join {name}_g g on g.sample_id = r.sample_id and g.ord = r.ord + 1) r),
{name} as (
  select expert, sample_id, unnest(done) as m from {name}_r
  qualify ord = max(ord) over (partition by expert, sample_id))
"""


@query(_match_sql(2, True, "mm") + "select sample_id, m.g::bigint as g, m.p::bigint as p from mm")
def greedy_match(spark, sf_dir):
    rows = P.evaluated(_gold(spark, sf_dir), X.predictions(spark, sf_dir, "anchor"))
    return rows.select("sample_id", F.inline(S.matches(F.col("gold"), F.col("predicted"), 2)))


def _metrics_sql(experts: str = "'anchor'") -> str:
    return (
        _match_sql(2, True, "mm", experts)
        + f"""
, gs as (select sample_id, count(*) as n, sum(weight) as w, coalesce(sum(weight) filter (critical), 0) as cw from gold group by 1),
ps as (select expert, sample_id, count(*) as n from pred where expert in ({experts}) group by all),
ms as (select expert, mm.sample_id, sum(weight) as gw, coalesce(sum(weight) filter (critical), 0) as cw, count(*) as pw
       from mm join gold on gold.sample_id = mm.sample_id and gold.g = mm.m.g group by all),
gc as (select distinct sample_id, unnest(range(start, "end")) as c from gold),
pc as (select distinct expert, sample_id, unnest(range(start, "end")) as c from pred where expert in ({experts})),
gn as (select sample_id, count(*) as n from gc group by 1),
pn as (select expert, sample_id, count(*) as n from pc group by all),
tn as (select expert, pc.sample_id, count(*) as n from pc join gc on gc.sample_id = pc.sample_id and gc.c = pc.c group by all),
d0 as (
  select e.expert, s.sample_id, split_part(s.sample_id, ':', 1) as dataset, len(text) as text_len,
         coalesce(gs.n, 0) as gt_count, coalesce(ps.n, 0) as pred_count, coalesce(gs.w, 0)::double as gt_weight, coalesce(ps.n, 0)::double as pred_weight,
         coalesce(ms.gw, 0)::double as matched_gt_weight, coalesce(ms.pw, 0)::double as matched_pred_weight,
         coalesce(gs.cw, 0)::double as critical_gt_weight, coalesce(ms.cw, 0)::double as matched_critical_gt_weight,
         coalesce(gn.n, 0) as gt_char_count, coalesce(pn.n, 0) as pred_char_count, coalesce(tn.n, 0) as tp_char_count
  from samples s cross join (select expert from experts where expert in ({experts})) e
  left join gs using (sample_id) left join ps on ps.sample_id = s.sample_id and ps.expert = e.expert
  left join ms on ms.sample_id = s.sample_id and ms.expert = e.expert left join gn on gn.sample_id = s.sample_id
  left join pn on pn.sample_id = s.sample_id and pn.expert = e.expert left join tn on tn.sample_id = s.sample_id and tn.expert = e.expert),
d1 as (
  select *, pred_char_count - tp_char_count as fp_char_count, gt_char_count - tp_char_count as fn_char_count,
         greatest(0, text_len - gt_char_count) as non_pii_char_count,
         case when gt_weight = 0 then 1.0 else matched_gt_weight / gt_weight end::double as weighted_pii_coverage,
         case when pred_weight = 0 then 1.0 else matched_pred_weight / pred_weight end::double as weighted_precision,
         case when critical_gt_weight = 0 then 1.0 else matched_critical_gt_weight / critical_gt_weight end::double as critical_coverage from d0),
d2 as (
  select *, case when non_pii_char_count = 0 then 0.0 else fp_char_count / non_pii_char_count end::double as fp_char_rate,
         case when 4 * weighted_precision + weighted_pii_coverage = 0 then 0.0
              else 5 * weighted_precision * weighted_pii_coverage / (4 * weighted_precision + weighted_pii_coverage) end::double as risk_adjusted_f2 from d1),
det as (
  select *, 1.0 - fp_char_rate as non_pii_preservation, weighted_pii_coverage >= 0.9 as coverage_pass, critical_coverage >= 1.0 as critical_pass,
         fp_char_rate <= 0.05 as fp_char_pass, weighted_pii_coverage >= 0.9 and critical_coverage >= 1.0 and fp_char_rate <= 0.05 as policy_pass from d2)
"""
    )


_INTS = ("text_len", "gt_count", "pred_count", "gt_char_count", "pred_char_count", "tp_char_count", "fp_char_count", "fn_char_count", "non_pii_char_count")
_REALS = ("gt_weight", "pred_weight", "matched_gt_weight", "matched_pred_weight", "critical_gt_weight", "matched_critical_gt_weight", "weighted_pii_coverage", "weighted_precision", "critical_coverage", "risk_adjusted_f2", "fp_char_rate", "non_pii_preservation")
_FLAGS = ("coverage_pass", "critical_pass", "fp_char_pass", "policy_pass")
_DETAIL = ", ".join(["sample_id", "dataset", *(f"{c}::bigint as {c}" for c in _INTS), *(f"round({c}, 9) as {c}" for c in _REALS), *_FLAGS])


@query(_metrics_sql() + f"select {_DETAIL} from det")
def sample_metrics(spark, sf_dir):
    return _details(spark, sf_dir).select("sample_id", "dataset", *_INTS, *_REALS, *_FLAGS)


@query(_metrics_sql() + "select sample_id, tp_char_count::bigint as tp, fp_char_count::bigint as fp, fn_char_count::bigint as fn, non_pii_char_count::bigint as other from det")
def char_confusion(spark, sf_dir):
    rows = P.evaluated(_gold(spark, sf_dir), X.predictions(spark, sf_dir, "anchor"))
    chars = S.confusion(F.col("gold"), F.col("predicted"), F.length("text"))
    return rows.select("sample_id", *(chars[k].alias(k) for k in ("tp", "fp", "fn", "other")))


def _means(names, where: str = "", prefix: str = "") -> str:
    return ", ".join(f"round(coalesce(avg({P.MACRO[k]}::int::double) {where}, 0), 9) as {prefix}{k}" if P.MACRO[k] == "policy_pass" else f"round(coalesce(avg({P.MACRO[k]}) {where}, 0), 9) as {prefix}{k}" for k in names)


@query(_metrics_sql() + f"select dataset, count(*)::bigint as n_samples, {_means(P.BY_DATASET)} from det group by 1")
def policy_by_source(spark, sf_dir):
    return P.by_dataset(_details(spark, sf_dir))


@query(
    _metrics_sql()
    + f"""select count(*)::bigint as n_samples, {_means(P.MACRO)}, count(*) filter (gt_count > 0)::bigint as pos_n_samples, {_means(P.POSITIVE, "filter (gt_count > 0)", "pos_")},
       count(*) filter (gt_count = 0)::bigint as neg_n_samples, {_means(P.NEGATIVE, "filter (gt_count = 0)", "neg_")} from det"""
)
def macro_summary(spark, sf_dir):
    return P.macro(_details(spark, sf_dir))


@query(
    _metrics_sql()
    + """, t as (select sum(matched_pred_weight) / sum(pred_weight) as p, sum(matched_gt_weight) / sum(gt_weight) as r from det)
    select round(p, 9) as weighted_precision, round(r, 9) as weighted_recall, round(2 * p * r / (p + r), 9) as weighted_f1 from t"""
)
def micro_summary(spark, sf_dir):
    return P.micro(_details(spark, sf_dir))


@query(
    _metrics_sql()
    + """, t as (select sum(tp_char_count)::bigint as tp, sum(fp_char_count)::bigint as fp, sum(fn_char_count)::bigint as fn,
                      sum(greatest(0, non_pii_char_count - fp_char_count))::bigint as tn, sum(text_len)::bigint as n from det),
    u as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from t)
    select tp as tp_chars, fp as fp_chars, fn as fn_chars, tn as tn_chars, round(p, 9) as precision, round(r, 9) as recall,
           round(2 * p * r / (p + r), 9) as f1, round(tp / (tp + fp + fn), 9) as iou, round((tp + tn) / n, 9) as accuracy from u"""
)
def char_level(spark, sf_dir):
    return P.characters(_details(spark, sf_dir))


@query(
    _match_sql(0, True, "m1")
    + _match_sql(2, False, "m2")
    + _match_sql(2, True, "m3")
    + """, t as (select (select count(*) from gold) as g, (select count(*) from pred where expert = 'anchor') as p),
    l as (select 'exact_label_aware' as level, count(*) as tp from m1 union all select 'overlap_label_agnostic', count(*) from m2 union all select 'overlap_label_aware', count(*) from m3),
    u as (select level, tp, p - tp as fp, g - tp as fn, tp / p as pr, tp / g as re from l, t)
    select level, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(pr, 9) as precision, round(re, 9) as recall, round(2 * pr * re / (pr + re), 9) as f1 from u"""
)
def entity_levels(spark, sf_dir):
    return P.entities(P.evaluated(_gold(spark, sf_dir), X.predictions(spark, sf_dir, "anchor")))


@query(_match_sql(0, True, "m1") + "select label, count(*)::bigint as tp from m1 join gold on gold.sample_id = m1.sample_id and gold.g = m1.m.g group by 1")
def label_hits(spark, sf_dir):
    return P.label_hits(P.evaluated(_gold(spark, sf_dir), X.predictions(spark, sf_dir, "anchor")))


@query(_metrics_sql() + "select sample_id, policy_pass, round(critical_coverage, 9) as critical_coverage, round(weighted_pii_coverage, 9) as weighted_pii_coverage, round(fp_char_rate, 9) as fp_char_rate from det order by policy_pass, critical_coverage, weighted_pii_coverage, fp_char_rate desc, sample_id limit 20")
def worst_cases(spark, sf_dir):
    return P.worst(_details(spark, sf_dir).select("sample_id", "policy_pass", "critical_coverage", "weighted_pii_coverage", "fp_char_rate"))


_ALL = ", ".join(f"'{e}'" for e in EXPERTS)
_AUDIT = (
    _metrics_sql(_ALL)
    + _SPLIT.format(0.3, 0.3)
    + """, aud0 as (select det.*, case s.split when 'heldout' then 'fresh' else s.split end as split from det join s using (sample_id) where s.split <> 'training'),
aud as (
  select dataset as source, expert, case when grouping(split) = 1 then 'all' else split end as split, count(*)::bigint as rows, count(*) filter (policy_pass)::bigint as passes,
         avg(policy_pass::int::double) as pcr, avg(weighted_pii_coverage) as coverage, avg(critical_coverage) as critical, avg(fp_char_rate) as fp_rate
  from aud0 group by grouping sets ((dataset, expert, split), (dataset, expert)))
"""
)


def _audit(spark, sf_dir):
    gold = D.with_split(_gold(spark, sf_dir, *(f"spans_{e}" for e in EXPERTS)), development=0.3, heldout=0.3).where("split <> 'training'")
    gold = gold.withColumn("split", F.when(F.col("split") == "heldout", U.SPLITS["heldout"]).otherwise(F.col("split")))
    return U.audit(U.details_beside(gold, EXPERTS))


@query(_AUDIT + "select source, expert, split, rows, passes, round(pcr, 9) as pcr, round(coverage, 9) as coverage, round(critical, 9) as critical, round(fp_rate, 9) as fp_rate from aud")
def source_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(
    _AUDIT
    + """, wide as (
      select source, expert, max(rows) filter (split = 'development') as dr, max(pcr) filter (split = 'development') as dp,
             max(rows) filter (split = 'fresh') as fr, max(pcr) filter (split = 'fresh') as fp, max(passes) filter (split = 'all') as ap, max(pcr) filter (split = 'all') as al
      from aud group by all)
    select x.source, x.expert from wide x join wide a on a.source = x.source and a.expert = 'anchor'
    where x.expert <> 'anchor' and coalesce(x.dr, 0) > 0 and x.dp > coalesce(a.dp, 0) and (coalesce(x.fr, 0) = 0 or x.fp >= coalesce(a.fp, 0))
    qualify row_number() over (partition by x.source order by x.al - a.al desc, x.ap desc, x.expert) = 1"""
)
def choose_routes(spark, sf_dir):
    return U.routes(_audit(spark, sf_dir))


_ROUTED = (
    ", rt as (select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in ROUTES.items()) + ") t(source, expert))"
    """, pl as (select expert, sample_id, list({'start': start::int, 'end': "end"::int, 'label': label, 'score': round(score, 9)} order by p) as spans from pred group by all),
    ro as (select s.sample_id, coalesce(rt.expert, 'anchor') as expert from samples s left join rt using (source)),
    rx as (select ro.*, coalesce(a.spans, []) as spans, coalesce(b.spans, []) as base from ro left join pl a on a.sample_id = ro.sample_id and a.expert = ro.expert
           left join pl b on b.sample_id = ro.sample_id and b.expert = 'anchor')"""
)


def _routed(spark, sf_dir):
    return R.routed(X.beside(spark, sf_dir).select("sample_id", *(f"spans_{e}" for e in EXPERTS)), list(EXPERTS), ROUTES)


@query(_ROUTED + "select sample_id, expert, len(spans)::bigint as n, coalesce(list_aggregate(list_transform(spans, lambda x: x.start), 'string_agg', ','), '') as starts, expert <> 'anchor' and spans is distinct from base as changed from rx")
def route_outputs(spark, sf_dir):
    rows = _routed(spark, sf_dir)
    return rows.select("sample_id", "expert", F.size("pred_spans").alias("n"), F.array_join(F.transform("pred_spans", lambda s: s["start"].cast("string")), ",").alias("starts"), "changed")


@query(_ROUTED + "select expert, count(*)::bigint as n, count(*) filter (expert <> 'anchor' and spans is distinct from base)::bigint as changed from rx group by 1")
def routing_stats(spark, sf_dir):
    return R.stats(_routed(spark, sf_dir))


def _submission(spark, sf_dir, gone=8, alone=9):
    """Anchor rows as JSON text, damaged by row number; the test rows they belong to. Of 17 rows one has no submission (``gone``) and one no test row (``alone``)."""
    rows = settle(X.beside(spark, sf_dir).select("sample_id", "text", F.col("spans_anchor").alias("pred_spans")), "submission")
    rows = rows.withColumn("row_idx", F.substring_index("sample_id", ":", -1).cast("bigint"))
    k = F.col("row_idx") % 17
    spans = F.transform("pred_spans", lambda s: F.struct(F.when(k == 1, s["start"] + 100000).otherwise(s["start"]).alias("start"), F.when(k == 2, s["start"]).otherwise(s["end"]).alias("end"), F.when(k == 3, F.lit("NOBODY")).otherwise(F.lower(s["label"])).alias("label")))
    spans = F.when(k == 4, F.concat(spans, F.slice(spans, 1, 1))).otherwise(spans)
    own = F.when(k == 5, F.lit("")).when(k == 6, F.lit("twice")).otherwise(F.col("sample_id"))
    line = F.when(k == 7, F.to_json(F.struct(own.alias("sample_id"), F.lit("none").alias("pred_spans")))).otherwise(F.to_json(F.struct(own.alias("sample_id"), spans.alias("pred_spans"))))
    return rows.where(k != gone).select("row_idx", line.alias("value")), rows.where(k != alone).select("row_idx", "sample_id", "text")


def _validated(gone: int, alone: int, expected: int) -> str:
    return f""", b as (select sample_id, text, split_part(sample_id, ':', 3)::bigint as i, split_part(sample_id, ':', 3)::bigint % 17 as k from samples),
    o as (select *, case k when 5 then '' when 6 then 'twice' else sample_id end as own from b where k <> {gone}),
    sp as (select o.k, o.sample_id, o.text, case k when 1 then p.start + 100000 else p.start end as a, case k when 2 then p.start else p."end" end as z, case k when 3 then 'NOBODY' else p.label end as l
           from o join pred p on p.sample_id = o.sample_id and p.expert = 'anchor' where k <> 7
           union all
           select o.k, o.sample_id, o.text, p.start, p."end", p.label from o join pred p on p.sample_id = o.sample_id and p.expert = 'anchor' and p.p = 0 where k = 4),
    ok as (select *, l <> 'NOBODY' and a < z and (k = {alone} or z <= len(text)) as fine from sp),
    c as (select
      (select count(*) from o)::bigint as row_count,
      (select count(*) - count(distinct own) from o)::bigint as duplicate_submission_rows,
      (select count(*) from o where k = 7)::bigint as malformed_span_count,
      (select count(*) from ok where not fine)::bigint as illegal_or_invalid_span_count,
      (select count(*) - count(distinct (sample_id, a, z, l)) from ok where fine)::bigint as duplicate_span_count,
      (select count(*) filter (own = '') + count(*) filter (k <> {alone} and own <> sample_id) from o)::bigint as sample_id_mismatch_count,
      (select count(*) from b where k = {gone})::bigint as missing_prediction_rows,
      (select count(*) from b where k = {alone})::bigint as extra_prediction_rows,
      (select abs(count(*) - {expected}) from o)::bigint as expected_row_count_mismatch)
    select *, false as strict_pass from c"""


@query(_validated(8, 9, 900))
def validate_counters(spark, sf_dir):
    rows, test = _submission(spark, sf_dir)
    return V.counters(rows, test, expected_rows=900)


@query(
    """, v as (select sample_id, expert, case expert when 'anchor' then 0 when 'coverage' then 1 else 2 end as o from samples cross join experts
              where not (expert = 'precision' and split_part(sample_id, ':', 3)::bigint % 3 = 0)),
    w as (select sample_id, expert from v qualify row_number() over (partition by sample_id order by o desc) = 1)
    select w.sample_id, w.expert, count(p.start)::bigint as n from w left join pred p on p.sample_id = w.sample_id and p.expert = w.expert group by all"""
)
def last_wins_predictions(spark, sf_dir):
    rows = None
    for k, (e, p) in enumerate(X.all_predictions(spark, sf_dir).items()):
        own = p.withColumns({"expert": F.lit(e), "row_idx": F.lit(k)})
        own = own.where(F.substring_index("sample_id", ":", -1).cast("bigint") % 3 != 0) if e == "precision" else own
        rows = own if rows is None else rows.unionByName(own)
    return jsonl.last_wins(rows).select("sample_id", "expert", F.size("pred_spans").alias("n"))


@query("""select label, risk_band, count(*)::bigint as n, count(*) filter ("end" - start >= 9 and name <> 'CONTEXT_MISC' and name <> 'SOMETHING_ELSE')::bigint as valid from (select a.*, a.name as label from (select * exclude (label) from ann) a) group by all""")
def span_validity(spark, sf_dir):
    rows = X.annotated(spark, sf_dir).select(F.inline("pii_annotations"))
    name = L.normalize_label(F.col("label"))
    fits = S.valid(F.col("start") - F.col("start"), F.col("end") - F.col("start") - 8, name)
    return rows.select(name.alias("label"), "risk_band", fits.alias("fits")).groupBy("label", "risk_band").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("valid"))


@query("select s.sample_id, len(text)::bigint as text_len, count(a.start)::bigint as n, coalesce(sum(a.weight), 0)::double as weight from samples s left join ann a using (sample_id) group by all")
def jsonl_round_trip(spark, sf_dir):
    """Annotated samples as JSON lines, written in parallel and read back by the strict scan."""
    folder = sinks.scratch(spark, "samples")
    X.annotated(spark, sf_dir).select("sample_id", "text", "pii_annotations").write.option("ignoreNullFields", False).json(folder)
    read = jsonl.strict(spark, folder, SAMPLE, pattern="*.json")
    weight = F.aggregate("pii_annotations", F.lit(0.0), lambda t, a: t + F.coalesce(a["weight"], F.lit(0.0)))
    return read.select("sample_id", F.length("text").alias("text_len"), F.size("pii_annotations").alias("n"), weight.alias("weight"))


@query(f"select unnest(range({len(TAGS)}))::bigint as label_id, unnest({list(TAGS)}) as tag")
def bio_tags(spark, sf_dir):
    return T.tag_table(spark)


@query('select sample_id, ("window" // 4)::bigint as chunk, count(*)::bigint as n from win group by all')
def window_chunks(spark, sf_dir):
    return T.window_chunks(X.windows(spark, sf_dir), 4).groupBy("sample_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


from . import file_queries  # noqa: E402, F401  registers its queries beside these
