"""Annotated samples and predictions derived from ``documents``, the same in Spark and in DuckDB.

Whole tokens (between blanks, line ends and tabs) that look like personal data, and long
or punctuated words, become annotations. Digits of a hash of the sample and the place decide
what is left out, shifted, or labelled otherwise, so that every rule meets its cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arrays import marked
from .schema import EXPERTS, TAGS
from .sources.sinks import settle

# Fixed values, shared with the SQL below: token patterns with label and risk band.
KINDS = (
    (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "CONTACT", "HIGH"),
    (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "DIGITAL_ID", "CRITICAL"),
    (r"[0-9]{16}", "FINANCIAL_ACCOUNT", "CRITICAL"),
    (r"\"[0-9a-f]{24,}\"", "AUTH_SECRET", "CRITICAL"),
    (r"[A-Z][a-z]{13,}", "HEALTH_MEDICAL", "CRITICAL"),
    (r"[A-Z][a-z]{10,12}", "ADDRESS_GEO", "MEDIUM"),
    (r"[A-Z][a-z]{8,9}", "DEMOGRAPHIC_PROFILE", "HIGH"),
    (r"[A-Z][a-z]{6,7}", "PERSON_NAME", "LOW"),
    (r"[A-Z][a-z]{4}\.", "OFFICIAL_ID", "CRITICAL"),
    (r"[a-z]{16,}", "TRANSACTION_ASSET", "CRITICAL"),
    (r"[A-Z][a-z]{6},", "ACCOUNT_HANDLE", "MEDIUM"),
)
DROPPED = {"anchor": "01", "coverage": "0", "precision": "012"}


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores, dealt to all of them; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return docs.select(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string")).alias("sample_id"), "source", F.coalesce("text", F.lit("")).alias("text"))


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with cands: start, end, label, risk_band of every token of one of KINDS, in order."""
    pattern = r"(?<![^ \n\t])(?:" + "|".join(p for p, _, _ in KINDS) + r")(?![^ \n\t])"

    def named(c: Column) -> Column:
        label, band = F.lit(None).cast("string"), F.lit(None).cast("string")
        for p, name, risk in reversed(KINDS):
            fits = c["token"].rlike(f"^(?:{p})$")
            label, band = F.when(fits, name).otherwise(label), F.when(fits, risk).otherwise(band)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), label.alias("label"), band.alias("risk_band"))

    return rows.withColumn("cands", F.transform(marked(F.col("text"), pattern), named))


_found: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """The session, the table, and when it changed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    changed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
    return spark.sparkContext.applicationId, sf_dir, changed


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with their candidates. They are written once for a session and table, since finding them costs more than most queries; a table that changed is read again."""
    key = version(spark, sf_dir)
    if key not in _found:
        _found[key] = settle(candidates(samples(spark, sf_dir)), "candidates")
    return _found[key]


def _digit(h: Column, k: int) -> Column:
    return F.substring(h, k, 1)


def _annotations() -> Column:
    """pii_annotations from sample_id and cands."""
    hashed = F.transform("cands", lambda c: F.struct(c.alias("c"), F.md5(F.concat_ws(":", "sample_id", c["start"].cast("string"))).alias("h")))

    def one(x: Column) -> Column:
        c, d = x["c"], lambda k: _digit(x["h"], k)
        label = F.when(d(1) == "0", "CONTEXT_MISC").when(d(1) == "1", "SOMETHING_ELSE").otherwise(c["label"])
        weight = F.when(c["risk_band"] == "CRITICAL", 4.0).when(c["risk_band"] == "HIGH", 3.0).when(c["risk_band"] == "MEDIUM", 2.0).otherwise(1.0)
        return F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.when(d(2) < "8", F.lower(F.replace(label, F.lit("_"), F.lit(" ")))).otherwise(label).alias("label"),
            c["risk_band"].alias("risk_band"),
            F.when(d(3) == "0", 0.0).when(d(3) != "1", weight).alias("weight"),
            F.when(d(6) == "0", 0.0).when(d(6) < "8", weight / 2).alias("pcr_weight"),
            F.when(d(4) == "0", F.lit(False)).when(d(4) != "1", F.lit(True)).alias("pcr_in_scope"),
            F.when(d(5) != "0", c["risk_band"] == "CRITICAL").alias("critical_for_pcr"),
            F.array().cast("array<string>").alias("fine_labels"),
        )

    return F.transform(hashed, one)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, source, text, pii_annotations."""
    return found(spark, sf_dir).select("sample_id", "source", "text", _annotations().alias("pii_annotations"))


def _hex(digit: Column) -> Column:
    return F.instr(F.lit("0123456789abcdef"), digit) - 1


def _predicted(expert: str) -> Column:
    """An expert's scored spans from sample_id, text and cands."""
    hashed = F.transform("cands", lambda c: F.struct(c.alias("c"), F.md5(F.concat_ws("|", F.lit(expert), "sample_id", c["start"].cast("string"))).alias("h"), F.length("text").alias("n")))

    def one(x: Column) -> Column:
        c, d = x["c"], lambda k: _digit(x["h"], k)
        start = c["start"] + F.when(d(2) == "0", 1).when(d(2) == "1", 2).when(d(2) == "2", 4).otherwise(0)
        end = F.least(x["n"], c["end"] + F.when(d(3) == "0", -1).when(d(3) == "1", 3).otherwise(0))
        return F.struct(F.when(start < end, start).otherwise(c["start"]).alias("start"), F.when(start < end, end).otherwise(c["end"]).alias("end"), F.when(d(4) == "0", "CONTACT").otherwise(c["label"]).alias("label"), (_hex(d(5)) * 16 / 255.0 + _hex(d(6)) / 255.0).alias("score"))

    return F.transform(F.filter(hashed, lambda x: ~F.contains(F.lit(DROPPED[expert]), _digit(x["h"], 1))), one)


def predictions(spark: SparkSession, sf_dir: str, expert: str) -> DataFrame:
    """sample_id, pred_spans (scored) of one expert."""
    return found(spark, sf_dir).select("sample_id", _predicted(expert).alias("pred_spans"))


def beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, source, text, pii_annotations and each expert's spans_<expert>, in one pass."""
    return found(spark, sf_dir).select("sample_id", "source", "text", _annotations().alias("pii_annotations"), *(_predicted(e).alias(f"spans_{e}") for e in EXPERTS))


def all_predictions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {e: predictions(spark, sf_dir, e) for e in EXPERTS}


def subtokens(rows: DataFrame, *kept: str) -> DataFrame:
    """(sample_id, nth, start, end, target): each candidate as two tokens, with the tag number it should get; columns ``kept`` stay beside them."""
    tag = F.lit(0)
    for k, t in enumerate(TAGS):
        if t[:2] == "B-":
            tag = F.when(F.col("c.label") == t[2:], k).otherwise(tag)
    each = rows.select("sample_id", *kept, F.posexplode("cands").alias("o", "c"))
    middle = F.col("c.start") + F.floor((F.col("c.end") - F.col("c.start")) / 2).cast("int")
    halves = F.array(F.struct((F.col("o") * 2).alias("nth"), F.col("c.start").alias("start"), middle.alias("end"), tag.alias("target")), F.struct((F.col("o") * 2 + 1).alias("nth"), middle.alias("start"), F.col("c.end").alias("end"), (tag + 1).alias("target")))
    return each.select("sample_id", *kept, F.explode(halves).alias("t")).select("sample_id", *kept, "t.*")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, window, start, end, probs): windows of 8 tokens that share 2 with the one before."""
    rows = subtokens(found(spark, sf_dir))
    own = F.floor(F.col("nth") / 8).cast("int")
    rows = rows.withColumn("window", F.explode(F.when((F.col("nth") % 8 < 2) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    rows = rows.withColumn("h", F.md5(F.concat_ws("#", "sample_id", F.col("window").cast("string"), F.col("start").cast("string"))))
    lead = F.when(_digit(F.col("h"), 24) > "2", F.col("target")).otherwise(-1)
    probs = F.array(*((_hex(_digit(F.col("h"), k + 1)) / 16.0 + F.when(lead == k, 2.0).otherwise(0.0)) for k in range(len(TAGS))))
    return rows.select("sample_id", "window", "start", "end", probs.alias("probs"))


def _kind_sql(what: int) -> str:
    return "case " + " ".join(f"when regexp_full_match(token, '{k[0]}') then '{k[what]}'" for k in KINDS) + " end"


#: The same tables as common table expressions for DuckDB; tokens come from splitting and running sums.
PRELUDE = rf"""
with recursive samples as (
  select concat_ws(':', source, lang, doc_id::varchar) as sample_id, source, coalesce(text, '') as text from documents),
split as (
  select sample_id, text, string_split_regex(text, '[ \n\t]') as p from samples),
tok as (select sample_id, len(text) as text_len, unnest(range(len(p))) as pos, unnest(p) as token from split),
toks as (
  select *, (sum(len(token) + 1) over (partition by sample_id order by pos) - len(token) - 1)::int as start from tok),
cand as (
  select sample_id, text_len, start, start + len(token)::int as "end", {_kind_sql(1)} as label, {_kind_sql(2)} as risk_band
  from toks where regexp_full_match(token, '{"|".join(p for p, _, _ in KINDS)}')),
ann0 as (
  select *, md5(sample_id || ':' || start) as h, case risk_band when 'CRITICAL' then 4.0 when 'HIGH' then 3.0 when 'MEDIUM' then 2.0 else 1.0 end::double as bw from cand),
ann1 as (select *, case substr(h, 1, 1) when '0' then 'CONTEXT_MISC' when '1' then 'SOMETHING_ELSE' else label end as name from ann0),
ann as (
  select sample_id, start, "end", name, risk_band, bw, text_len,
         case when substr(h, 2, 1) < '8' then lower(replace(name, '_', ' ')) else name end as label,
         case substr(h, 3, 1) when '0' then 0.0 when '1' then null else bw end::double as weight,
         case when substr(h, 6, 1) = '0' then 0.0 when substr(h, 6, 1) < '8' then bw / 2 end::double as pcr_weight,
         case substr(h, 4, 1) when '0' then false when '1' then null else true end as pcr_in_scope,
         case when substr(h, 5, 1) <> '0' then risk_band = 'CRITICAL' end as critical_for_pcr
  from ann1),
train as (
  select sample_id, start, "end", name as label, risk_band, weight, coalesce(critical_for_pcr, false) as critical_for_pcr,
         row_number() over (partition by sample_id order by start, "end", name) - 1 as k
  from ann where name not in ('CONTEXT_MISC', 'SOMETHING_ELSE') and pcr_in_scope and weight > 0),
gold as (
  select sample_id, start, "end", name as label, coalesce(weight, pcr_weight, bw) as weight, coalesce(critical_for_pcr, risk_band = 'CRITICAL') as critical, text_len,
         (row_number() over (partition by sample_id order by start) - 1)::int as g
  from ann where coalesce(pcr_in_scope, coalesce(weight, pcr_weight, bw) > 0)),
experts as (select unnest(['anchor', 'coverage', 'precision']) as expert, unnest(['01', '0', '012']) as dropped),
pred0 as (select c.*, e.expert, e.dropped, md5(e.expert || '|' || sample_id || '|' || start) as h from cand c, experts e),
pred1 as (
  select *, start + case substr(h, 2, 1) when '0' then 1 when '1' then 2 when '2' then 4 else 0 end as s,
         least(text_len, "end" + case substr(h, 3, 1) when '0' then -1 when '1' then 3 else 0 end) as e
  from pred0 where not contains(dropped, substr(h, 1, 1))),
pred as (
  select expert, sample_id, (case when s < e then s else start end)::int as start, (case when s < e then e else "end" end)::int as "end",
         case when substr(h, 4, 1) = '0' then 'CONTACT' else label end as label,
         (('0x' || substr(h, 5, 1))::int * 16 / 255.0::double + ('0x' || substr(h, 6, 1))::int / 255.0::double) as score,
         (row_number() over (partition by expert, sample_id order by pred1.start) - 1)::int as p
  from pred1),
sub0 as (
  select sample_id, row_number() over (partition by sample_id order by start) - 1 as o, start, "end", start + ("end" - start) // 2 as mid,
         list_position({list(TAGS)}, 'B-' || label) - 1 as tag
  from cand),
sub as (
  select sample_id, o * 2 as nth, start, mid as "end", tag as target from sub0
  union all select sample_id, o * 2 + 1, mid, "end", tag + 1 from sub0),
win0 as (
  select *, nth // 8 as w from sub union all select *, nth // 8 - 1 from sub where nth % 8 < 2 and nth >= 8),
win1 as (select *, md5(sample_id || '#' || w || '#' || start) as h from win0),
win as (
  select sample_id, w as "window", start, "end",
         list_transform(range({len(TAGS)}), lambda i: ('0x' || substr(h, i::int + 1, 1))::int / 16.0::double
           + case when substr(h, 24, 1) > '2' and i = target then 2.0::double else 0 end) as probs
  from win1)
"""
