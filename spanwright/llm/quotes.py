"""Chat formatting by quotation linking, with DataFrame operations only.

Lines that start with ``>`` marks are quotes of that depth. A passage is a run of lines of one
depth in a message, without lines that announce a quote. Passages are normalised (lower case,
letters and digits, one space, whatever the line breaks) and hashed. A passage of depth d is
looked up among the unquoted passages of the conversation, which gives the message that wrote
it, and, from depth 2 on, among those of depth d - 1, which gives the message that it was
quoted from. Passages that no unquoted one equals, because they are a part of a longer one, are
looked up by shingles of ``WIDTH`` words. Only earlier messages count; of several the first.

A message answers the one that most of its quoted characters come from, at the least depth
that any link has; of links at that depth, those to the message quoted from go before those to
the writer of the text. Quotes and their announcements are taken out, and a conversation is
ordered by threads, and within a thread by reply depth and turn, so that each message follows
the one it answers.

Defined results: a null text is empty; a message whose quotes match nothing earlier answers
none and begins a thread; several rows of one turn are one message whose lines are put together
by their number and then by their text; null conv_ids (and turns) are one conversation (and
turn) of their own, below all others, and what answers a message of a null turn has reply_to null with a
reply_depth above 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, settle

_QUOTE = r"^(?:[ \t]*>)+[ \t]?"
#: A line that announces a quote below it.
_INTRO = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"
#: Words of a passage's shingles; a passage of fewer words, but LEAST, is one shingle.
WIDTH, LEAST = 5, 3
_SHINGLE = "array<struct<hash:bigint,chars:bigint>>"
#: Shingles asked for in a conversation that may go to each of its passages.
HELD = 4096
#: Turns of a conversation that are sent as mail together; a power of two.
BLOCK = 64


def _key(column: Column) -> Column:
    """An id as a key that null ids have as well, below all others."""
    return F.named_struct(F.lit("known"), column.isNotNull(), F.lit("id"), F.coalesce(column.cast("bigint"), F.lit(0)))


def _id(key: str) -> Column:
    return F.when(F.col(key)["known"], F.col(key)["id"])


def depth(line: Column) -> Column:
    return _depth(_head(line))


def _head(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(">")), F.regexp_extract(line, _QUOTE, 0)).otherwise("")


def _depth(head: Column) -> Column:
    return F.length(head) - F.length(F.replace(head, F.lit(">")))


def normal(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces: what a quote may have changed goes, line breaks too."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def messages_of(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, lines) of each message; texts are moved only where several rows make one message."""
    rows = messages.select(_key(F.col(conv_id)).alias("conv"), _key(F.col(turn)).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    twice = settle(rows.groupBy("conv", "turn").count().where("count > 1").select("conv", "turn"), "twice")
    alone = rows.select("conv", "turn", "role", _lines(F.col("text")).alias("lines"))
    if twice.isEmpty():
        return alone
    put = F.flatten(F.transform(F.collect_list(_lines(F.col("text"))), lambda own: F.transform(own, lambda line, nth: F.struct(nth.alias("nth"), line.alias("line")))))
    merged = rows.join(twice, ["conv", "turn"], "left_semi").groupBy("conv", "turn").agg(F.min("role").alias("role"), F.transform(F.array_sort(put), lambda x: x["line"]).alias("lines"))
    return alone.join(twice, ["conv", "turn"], "left_anti").unionByName(merged)


def parsed(messages: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n_quoted, passages) of messages with their ``lines``, each row by itself.

    ``text`` is what no line quotes or announces a quote; ``passages`` has (depth, words, hash) of
    those with a word, ``words`` as one string. Every step takes time in proportion to the lines.
    """

    def marked(own: Column) -> Column:
        head = F.transform(own, lambda x: F.struct(x.alias("line"), _head(x).alias("head")))
        return F.transform(head, lambda x: F.struct(x["line"].alias("line"), _depth(x["head"]).alias("depth"), F.substr(x["line"], F.length(x["head"]) + 1).alias("bare")))

    def said(seen: Column) -> Column:
        intro = lambda x, k: (F.coalesce(F.get(seen, k + 1)["depth"], F.lit(0)) > x["depth"]) & x["bare"].rlike(_INTRO)
        return let(F.filter(seen, lambda x, k: ~intro(x, k)), lambda kept: let(F.filter(F.sequence(F.lit(0), F.size(kept) - 1), lambda k: (F.size(kept) > 0) & (k >= 0) & ((k == 0) | (F.get(kept, k - 1)["depth"] != F.get(kept, k)["depth"]))), lambda starts: told(seen, kept, starts)))

    def told(seen: Column, kept: Column, starts: Column) -> Column:
        own = F.array_join(F.transform(F.filter(kept, lambda x: x["depth"] == 0), lambda x: x["line"]), "\n")
        run = lambda k, i: F.slice(kept, k + 1, F.coalesce(F.get(starts, i + 1), F.size(kept)) - k)
        whole = F.transform(starts, lambda k, i: F.struct(F.get(kept, k)["depth"].alias("depth"), normal(F.array_join(F.transform(run(k, i), lambda x: x["bare"]), "\n")).alias("words")))
        passages = F.transform(F.filter(whole, lambda p: p["words"] != ""), lambda p: F.struct(p["depth"].alias("depth"), p["words"].alias("words"), F.xxhash64(p["words"]).alias("hash")))
        return F.struct(F.regexp_replace(own, r"^\s+|\s+$", "").alias("text"), F.size(F.filter(seen, lambda x: x["depth"] > 0)).cast("bigint").alias("n_quoted"), passages.alias("passages"))

    told_of = let(marked(F.col("lines")), said)
    return messages.select("conv", "turn", "role", F.inline(F.array(told_of)))


def _shingles(words: Column, width: int) -> Column:
    """(hash, chars) of the shingles of ``width`` words of an array; chars are those of the words that no earlier shingle of it starts with."""

    def one(k: Column) -> Column:
        text = F.array_join(F.slice(words, k, width), " ")
        last = k == F.size(words) - width + 1
        return F.struct(F.xxhash64(F.lit(width), text).alias("hash"), F.when(last, F.length(text)).otherwise(F.length(F.element_at(words, k))).cast("bigint").alias("chars"))

    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1))
    return F.coalesce(F.transform(starts, one), F.array().cast(_SHINGLE))


def _hashes(words: Column, width: int) -> Column:
    """The hashes of :func:`_shingles` alone, of as many arrays of words as conversations ask for shingles of that width."""
    starts = F.when(F.col(f"asks{width}") & (F.size(words) >= width), F.sequence(F.lit(1), F.size(words) - width + 1))
    return F.coalesce(F.transform(starts, lambda k: F.xxhash64(F.lit(width), F.array_join(F.slice(words, k, width), " "))), F.array().cast("array<bigint>"))


def parts(whole: DataFrame, lost: DataFrame, held: int = HELD) -> DataFrame:
    """(conv, turn, depth, origin, chars): messages whose unquoted passages the quoted passages ``lost`` are parts of.

    Few shingles are asked for beside those that are written. Where a conversation asks for
    ``held`` at most, they go to its passages, and only those that are found there are listed;
    in others all written ones of the widths asked for are, and meet those asked for by their hash.
    """
    words, widths = F.split("words", " "), range(LEAST, WIDTH + 1)
    size = F.size(F.split("words", " "))
    short = let(words, lambda w: F.concat(_shingles(w, WIDTH), *(F.when(F.size(w) == n, _shingles(w, n)).otherwise(F.array().cast(_SHINGLE)) for n in range(LEAST, WIDTH))))
    asked = lost.select("conv", "turn", "depth", F.least(size, F.lit(WIDTH)).alias("width"), F.inline(short)).groupBy("conv", "turn", "depth", "width", "hash").agg(F.sum("chars").alias("chars"))
    asked = settle(asked, "asked")
    flags = [F.bool_or(F.col("width") == n).alias(f"asks{n}") for n in widths]
    counts = settle(asked.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), *flags), "asking")
    some, many = counts.where(F.col("n") <= held).drop("n"), counts.where(F.col("n") > held).drop("n")
    wanted = asked.join(some, "conv").groupBy("conv", *(f"asks{n}" for n in widths)).agg(F.collect_set("hash").alias("wanted"))
    written = whole.where("depth = 0").select("conv", "turn", "words")
    every = let(words, lambda w: F.concat(*(_hashes(w, n) for n in widths)))
    found = written.join(wanted, "conv").select("conv", "turn", F.explode(F.array_intersect(every, F.col("wanted"))).alias("hash"))
    if not many.isEmpty():
        found = found.unionByName(written.join(many, "conv").select("conv", "turn", F.explode(F.array_distinct(every)).alias("hash")))
    first = found.groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    return asked.join(first, ["conv", "hash"]).where(F.col("origin") < F.col("turn")).select("conv", "turn", "depth", "origin", "chars")


def links(whole: DataFrame, held: int = HELD) -> DataFrame:
    """(conv, turn, depth, direct, origin, chars): of each message's passages of each depth the earlier messages that they come from.

    ``whole`` has (conv, turn, depth, words, hash) of each passage.
    ``direct`` links lead to the message that a passage was quoted from, others to its writer; at depth 1 these are the same.
    However often a passage is used or quoted, each quoted one meets one original at each level. Its words
    go only where the writer's is looked up, as they may be needed there.
    """
    first = whole.groupBy("conv", "hash", F.col("depth").alias("level")).agg(F.min("turn").alias("origin"))
    levels = F.when(F.col("depth") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("depth") - 1))
    asked = whole.where("depth > 0").select("conv", "turn", "depth", "hash", "words", F.length("words").cast("bigint").alias("chars"), F.explode(levels).alias("level")).withColumn("words", F.when(F.col("level") == 0, F.col("words")))
    found = asked.join(first, ["conv", "hash", "level"], "left").withColumn("met", F.coalesce(F.col("origin") < F.col("turn"), F.lit(False)))
    found = settle(found.where("met or level = 0").withColumn("words", F.when(~F.col("met"), F.col("words"))), "quoted")
    met = found.where("met").select("conv", "turn", "depth", (F.col("level") == F.col("depth") - 1).alias("direct"), "origin", "chars")
    lost = found.where("not met").select("conv", "turn", "depth", "words")
    if not lost.isEmpty():
        met = met.unionByName(parts(whole, lost, held).withColumn("direct", F.col("depth") == 1))
    return met.groupBy("conv", "turn", "depth", "direct", "origin").agg(F.sum("chars").alias("chars"))


def answers(linked: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, quoted_from) by message with links: the message answered, and for each depth its text's writer, as ``depth:turn``."""
    best = F.max_by("origin", F.struct(-F.col("depth"), "direct", "chars", "origin")).alias("reply_to")
    writer = linked.where("not direct or depth = 1").groupBy("conv", "turn", "depth").agg(F.max_by("origin", F.struct("chars", "origin")).alias("origin"))
    shown = F.struct("depth", F.concat_ws(":", F.col("depth").cast("string"), F.coalesce(_id("origin").cast("string"), F.lit("null"))).alias("s"))
    told = writer.groupBy("conv", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]), " ").alias("quoted_from"))
    return linked.groupBy("conv", "turn").agg(best).join(told, ["conv", "turn"], "left").withColumn("quoted_from", F.coalesce("quoted_from", F.lit("")))


def places(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread, reply_depth) of each message in ``replies`` (conv, turn, reply_to): the turn that its thread begins with, and the replies from there.

    Each round doubles how far back a message has looked; a row holds four numbers however long its thread.
    """
    up = F.col("reply_to")
    state = settle(replies.select("conv", "turn", up.alias("up"), F.coalesce(up, F.col("turn")).alias("thread"), F.when(up.isNull(), 0).otherwise(1).cast("bigint").alias("reply_depth")), "places")
    while not state.where("up is not null").isEmpty():
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("thread").alias("top"), F.col("reply_depth").alias("more"))
        further = state.where("up is not null").join(above, ["conv", "up"]).select("conv", "turn", F.col("next").alias("up"), F.col("top").alias("thread"), (F.col("reply_depth") + F.col("more")).alias("reply_depth"))
        state = settle(state.where("up is null").unionByName(further), "places")
    return state.select("conv", "turn", "thread", "reply_depth")


def threads(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = HELD) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, reply_depth, quoted_from, n_quoted of each message.

    Rows are sorted by conversation, thread, reply depth and turn over all partitions; a long
    conversation spreads over as many ranges as it needs.
    """
    each = settle(parsed(messages_of(messages, conv_id, turn, role, text)), "messages")
    linked = answers(links(each.select("conv", "turn", F.inline("passages")), held))
    whole = settle(each.select("conv", "turn").join(linked, ["conv", "turn"], "left"), "answers")
    placed = each.drop("passages").join(whole.join(places(whole.select("conv", "turn", "reply_to")), ["conv", "turn"]), ["conv", "turn"])
    count = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = placed.select(_id("conv").alias("conv_id"), _id("turn").alias("turn"), "role", "text", _id("reply_to").alias("reply_to"), _id("thread").alias("thread"), "reply_depth", F.coalesce("quoted_from", F.lit("")).alias("quoted_from"), "n_quoted")
    order = ("conv_id", "thread", "reply_depth", "turn")
    return out.repartitionByRange(count, *order).sortWithinPartitions(*order)


def as_mail(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as a mail client would send them: most messages quote the one to three before, nested and announced.

    Digits of a hash of conversation and turn tell how many, whether quoted texts are whole, wrapped anew
    every 8 words or cut after 12, and whether the nearest one was trimmed away. A message's own text, quotes and
    all, stays below. Turns are dealt by blocks of BLOCK, each with copies of the three turns before it, so that a text is
    moved about once and a long conversation needs no place of its own.
    """
    own = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    place, block = F.col("turn").bitwiseAND(F.lit(BLOCK - 1)), F.floor(F.shiftright("turn", BLOCK.bit_length() - 1))
    copies = F.array(F.struct(block.alias("block"), place.alias("place")), F.when(place >= BLOCK - 3, F.struct((block + 1).alias("block"), (place - BLOCK).alias("place"))))
    dealt = own.where(known).select("*", F.inline(F.array_compact(copies)))
    at = lambda k: Window.partitionBy("conv_id", "block").orderBy("place").rangeBetween(-k, -k)
    near = dealt.select("conv_id", "turn", "role", "text", "place", *(F.max(c).over(at(k)).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("text", "role"))).where("place >= 0")
    digit = lambda k: F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), k, 1)

    def form(k: int) -> Column:
        flat = F.replace(f"text{k}", F.lit("\n"), F.lit(" "))
        return F.when(digit(3) < "6", F.col(f"text{k}")).when(digit(3) < "b", F.regexp_replace(flat, "((?:[^ ]+ ){7}[^ ]+) ", "$1\n")).otherwise(F.regexp_extract(flat, "^(?:[^ ]+ ){0,11}[^ ]+", 0))

    def quoted(k: int, inner: Column) -> Column:
        return F.concat(F.lit("On Monday "), F.coalesce(f"role{k}", F.lit("someone")), F.lit(" wrote:\n> "), F.replace(inner, F.lit("\n"), F.lit("\n> ")))

    third = F.when((digit(2) >= "c") & F.col("text3").isNotNull(), F.concat(quoted(3, form(3)), F.lit("\n"))).otherwise("")
    nested = F.when((digit(2) >= "8") & F.col("text2").isNotNull(), quoted(2, F.concat(third, form(2))))
    nearest = F.when(nested.isNull(), form(1)).when(digit(4) < "3", nested).otherwise(F.concat(nested, F.lit("\n"), form(1)))
    sent = F.when((digit(1) >= "3") & F.col("text1").isNotNull(), F.concat(quoted(1, nearest), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return near.select("conv_id", "turn", "role", sent.alias("text")).unionByName(own.where(~known))


def _form_sql(k: int) -> str:
    flat = f"replace(u{k}.text, chr(10), ' ')"
    return f"case when substr(b.h, 3, 1) < '6' then u{k}.text when substr(b.h, 3, 1) < 'b' then regexp_replace({flat}, '((?:[^ ]+ ){{7}}[^ ]+) ', '\\1' || chr(10), 'g') else regexp_extract({flat}, '^(?:[^ ]+ ){{0,11}}[^ ]+') end as form{k}, u{k}.role as role{k}"


def _quoted_sql(k: int, inner: str) -> str:
    return f"'On Monday ' || coalesce(role{k}, 'someone') || ' wrote:' || chr(10) || '> ' || replace({inner}, chr(10), chr(10) || '> ')"


ORACLE = rf"""
with recursive own as (
  select conv_id, turn, role, coalesce(text, '') as text, md5(conv_id || ':' || turn) as h from conversations),
f0 as (
  select b.*, {_form_sql(1)}, {_form_sql(2)}, {_form_sql(3)}
  from own b left join own u1 on u1.conv_id = b.conv_id and u1.turn = b.turn - 1
  left join own u2 on u2.conv_id = b.conv_id and u2.turn = b.turn - 2 left join own u3 on u3.conv_id = b.conv_id and u3.turn = b.turn - 3),
f1 as (select *, case when substr(h, 2, 1) >= 'c' and form3 is not null then {_quoted_sql(3, "form3")} || chr(10) else '' end as third from f0),
f2 as (select *, case when substr(h, 2, 1) >= '8' and form2 is not null then {_quoted_sql(2, "third || form2")} end as nested from f1),
f3 as (select *, case when nested is null then form1 when substr(h, 4, 1) < '3' then nested else nested || chr(10) || form1 end as nearest from f2),
m as (
  select conv_id, turn, role, string_split_regex(case when substr(h, 1, 1) >= '3' and form1 is not null then {_quoted_sql(1, "nearest")} || chr(10) || text else text end, '\r?\n') as p from f3),
l as (select conv_id, turn, unnest(range(len(p))) as nth, unnest(p) as line from m),
d as (
  select *, regexp_extract(line, '^(?:[ \t]*>)+[ \t]?') as head, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') as bare from l),
q as (
  select *, len(head) - len(replace(head, '>', '')) as depth, trim(regexp_replace(lower(bare), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as n from d),
i as (
  select *, regexp_matches(bare, '(?i)^.{{0,200}}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$')
            and coalesce(lead(depth) over (partition by conv_id, turn order by nth), 0) > depth as intro from q),
r as (
  select *, case when lag(depth) over (partition by conv_id, turn order by nth) is distinct from depth then 1 else 0 end as starts from i where not intro),
s as (select *, sum(starts) over (partition by conv_id, turn order by nth) as run from r),
p as (select conv_id, turn, run, depth, string_agg(n, ' ' order by nth) filter (n <> '') as words from s group by all having words is not null),
f as (select conv_id, words, depth as level, min(turn) as origin from p group by all),
a as (select conv_id, turn, run, depth, words, unnest(case when depth = 1 then [0] else [0, depth - 1] end) as level from p where depth > 0),
found as (select a.*, f.origin from a left join f on f.conv_id = a.conv_id and f.words = a.words and f.level = a.level and f.origin < a.turn),
lost as (select conv_id, turn, depth, string_split(words, ' ') as w from found where level = 0 and origin is null),
z as (select *, least(len(w), {WIDTH}) as width from lost where len(w) >= {LEAST}),
ask as (select conv_id, turn, depth, width, len(w) as n, w, unnest(range(1, len(w) - width + 2)) as k from z),
ask2 as (
  select conv_id, turn, depth, width, array_to_string(w[k:k + width - 1], ' ') as g, case when k = n - width + 1 then len(array_to_string(w[k:k + width - 1], ' ')) else len(w[k]) end as chars from ask),
o as (select conv_id, turn, string_split(words, ' ') as w, unnest(range({LEAST}, {WIDTH + 1})) as width from p where depth = 0),
o2 as (select conv_id, turn, width, w, unnest(range(1, len(w) - width + 2)) as k from o where len(w) >= width),
o3 as (select conv_id, width, array_to_string(w[k:k + width - 1], ' ') as g, min(turn) as origin from o2 group by all),
every as (
  select conv_id, turn, depth, level = depth - 1 as direct, origin, len(words) as chars from found where origin is not null
  union all select x.conv_id, x.turn, x.depth, x.depth = 1, o3.origin, x.chars from ask2 x join o3 on o3.conv_id = x.conv_id and o3.width = x.width and o3.g = x.g and o3.origin < x.turn),
links as (select conv_id, turn, depth, direct, origin, sum(chars) as chars from every group by all),
best as (select conv_id, turn, arg_max(origin, {{'d': -depth, 'direct': direct, 'chars': chars, 'origin': origin}}) as reply_to from links group by all),
wr as (select conv_id, turn, depth, arg_max(origin, {{'chars': chars, 'origin': origin}}) as origin from links where not direct or depth = 1 group by all),
told as (select conv_id, turn, string_agg(depth || ':' || origin, ' ' order by depth) as quoted_from from wr group by all),
t as (
  select conv_id, turn, count(*) filter (depth > 0) as n_quoted,
         regexp_replace(coalesce(string_agg(line, chr(10) order by nth) filter (depth = 0 and not intro), ''), '^\s+|\s+$', '', 'g') as text
  from i group by all),
w as (select t.*, own.role, best.reply_to, coalesce(told.quoted_from, '') as quoted_from from t join own using (conv_id, turn) left join best using (conv_id, turn) left join told using (conv_id, turn)),
place as (
  select conv_id, turn, turn as thread, 0::bigint as reply_depth from w where reply_to is null
  union all select w.conv_id, w.turn, place.thread, place.reply_depth + 1 from place join w on w.conv_id = place.conv_id and w.reply_to = place.turn)
select conv_id, turn, role, text, reply_to, thread, reply_depth, quoted_from, n_quoted::bigint as n_quoted from w join place using (conv_id, turn)
"""
