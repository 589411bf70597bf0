import os
import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from spanwright.llm.common import settle
from spanwright.llm.quotes import ORACLE, as_mail, threads

INTRO = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)
COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def parse(line):
    m = re.match(r"(?:[ \t]*>)+[ \t]?", line)
    bare = line[m.end() :] if m else line
    return (m[0].count(">") if m else 0), bare, re.findall(r"[^\W_]+", bare.lower())


def split(text):
    """(own lines, number of quoted lines, passages as (depth, words)) of a message."""
    ls = [(*parse(x), x) for x in re.split(r"\r?\n", text or "")]
    intro = [bool(INTRO.match(b)) and k + 1 < len(ls) and ls[k + 1][0] > d for k, (d, b, _, _) in enumerate(ls)]
    runs, last = [], None
    for (d, _, words, _), skip in zip(ls, intro):
        if skip:
            continue
        if d != last:
            runs.append((d, []))
        runs[-1][1].extend(words)
        last = d
    own = "\n".join(x for (d, _, _, x), skip in zip(ls, intro) if d == 0 and not skip).strip()
    return own, sum(d > 0 for d, _, _, _ in ls), [(d, tuple(w)) for d, w in runs if w]


def by_hand(rows):
    out, convs = {}, defaultdict(dict)
    for c, t, role, text in rows:
        convs[c][t] = (role, *split(text))
    for c, turns in convs.items():
        def first(words, level, before):
            return min((t for t in turns if t < before and (level, words) in turns[t][3]), default=None)

        grams = {}
        for t in sorted(turns):
            for d, w in turns[t][3]:
                for n in (3, 4, 5):
                    for k in range(len(w) - n + 1) if d == 0 else ():
                        grams.setdefault(w[k : k + n], t)
        for t in sorted(turns):
            role, own, n_quoted, told = turns[t]
            votes = Counter()
            for d, w in told:
                if d == 0:
                    continue
                size, writer = len(" ".join(w)), first(w, 0, t)
                if writer is not None:
                    votes[d, d == 1, writer] += size
                if d > 1 and first(w, d - 1, t) is not None:
                    votes[d, True, first(w, d - 1, t)] += size
                if writer is None and len(w) >= 3:
                    n = min(5, len(w))
                    for k in range(len(w) - n + 1):
                        if grams.get(w[k : k + n], t) < t:
                            votes[d, d == 1, grams[w[k : k + n]]] += len(" ".join(w[k : k + n])) if k == len(w) - n else len(w[k])
            up = max(votes, key=lambda v: (-v[0], v[1], votes[v], v[2]))[2] if votes else None
            writers = {}
            for (d, direct, o), size in votes.items():
                if not direct or d == 1:
                    writers[d] = max(writers.get(d, (0, -1)), (size, o))
            thread, depth = (out[c, up][3], out[c, up][4] + 1) if up is not None else (t, 0)
            out[c, t] = (role, own, up, thread, depth, " ".join(f"{d}:{writers[d][1]}" for d in sorted(writers)), n_quoted)
    return out


def shown(got):
    return {(g.conv_id, g.turn): (g.role, g.text, g.reply_to, g.thread, g.reply_depth, g.quoted_from, g.n_quoted) for g in got}


def conversations(r, n):
    words = "alpha beta gamma delta Éta zeta theta iota kappa lambda".split()
    return [(c, t, r.choice(["user", "assistant"]), "\n".join(" ".join(r.choices(words, k=r.randint(1, 25))) + r.choice(["", ".", ","]) for _ in range(r.randint(1, 3)))) for c in range(n) for t in range(r.randint(1, 9))]


def test_threads_against_brute_force(spark):
    r = random.Random(8)
    rows = [tuple(x) for x in as_mail(spark.createDataFrame(conversations(r, 50), COLUMNS)).collect()]
    for c in range(100, 112):
        said = []
        for t in range(r.randint(1, 12)):
            parts = [f"line {r.randint(0, 30)} Éa, {c}" for _ in range(r.randint(0, 3))]
            if said and r.random() < 0.7:
                parts = ["On Monday someone wrote:"] * r.randint(0, 1) + [r.choice(["> ", ">", " >  "]) + q.upper() for q in r.choice(said).split("\n")] + parts
            text = r.choice(["\n", "\r\n"]).join(parts)
            said.append(text.replace("\r", ""))
            rows.append((c, t, r.choice(["user", "assistant"]), text))
    rows += [(500, 0, "user", None), (500, 1, None, ""), (510, 0, "user", "x\n" * 30000), (510, 1, "user", "> x\n>> y\nok"), (520, 3, "user", "> never said\nyes")]
    got = threads(spark.createDataFrame([(*x, "clash") for x in rows], f"{COLUMNS}, thread string")).collect()
    want = by_hand(rows)
    assert shown(got) == want
    assert [tuple(g)[:1] + (g.thread, g.reply_depth, g.turn) for g in got] == sorted(tuple(g)[:1] + (g.thread, g.reply_depth, g.turn) for g in got)
    linked = Counter(d.split(":")[0] for w in want.values() for d in w[5].split())
    assert min(linked["1"], linked["2"], linked["3"]) > 5 and max(w[4] for w in want.values()) > 3


def test_mail_by_hand(spark):
    rows = conversations(random.Random(3), 60)
    texts = {(c, t): x for c, t, _, x in rows}
    got = {(g.conv_id, g.turn): g.text for g in as_mail(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got.keys() == texts.keys() and all(got[k].endswith(texts[k]) for k in texts)
    quoting = [x for k, x in got.items() if x != texts[k]]
    deepest = Counter(max(parse(x)[0] for x in q.split("\n")) for q in quoting)
    assert set(deepest) == {1, 2, 3} and all(INTRO.match(q.split("\n")[0]) for q in quoting)
    again = [(5, 1, "u", "same"), (5, 1, "u", "same"), (None, 2, "u", None), (5, None, None, "x")]
    assert as_mail(spark.createDataFrame(again, COLUMNS)).count() == 4


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "u", "a"), (None, 1, "u", "> a\nb"), (None, -1, "u", "c"), (-(1 << 63), 1, "u", "d"), (1, 1, "u", "b one"), (1, 1, "u", "b one"), (1, 1, "a", "a two")], COLUMNS)
    got = {(g.conv_id, g.turn): g for g in threads(df).collect()}
    assert set(got) == {(None, None), (None, 1), (None, -1), (-(1 << 63), 1), (1, 1)}
    assert got[1, 1].text == "a two\nb one\nb one" and got[1, 1].role == "a"
    assert (got[None, 1].reply_to, got[None, 1].reply_depth, got[None, 1].quoted_from) == (None, 1, "1:null") and got[None, -1].reply_depth == 0
    assert threads(df.limit(0)).count() == 0


def test_rewrapped_partial_and_deep_quotes_find_their_message(spark):
    long = "The quick brown fox jumps over the lazy dog, and then it sleeps; nobody knows for how long it will."
    rows = [
        (1, 0, "u", f"Hello there\n{long}"),
        (1, 1, "a", "Some other message of no interest to anyone here"),
        (1, 2, "u", "> The quick brown fox jumps over\n> the lazy dog, and then\n>\n> it sleeps; nobody knows\nyes"),
        (1, 3, "a", "> of no interest to anyone\nno"),
        (1, 4, "u", "> other message of\nshort"),
        (1, 5, "u", "> brown dog\n> sleeps under the quick fox tonight\nnot said"),
        (2, 0, "u", "> The quick brown fox jumps over the lazy dog\nelsewhere"),
        (3, 0, "u", "one two three\nfour five six\nseven"),
        (3, 1, "u", "> one two three four five six\n> seven\nok"),
        (3, 2, "u", ">> one two three four five six seven\nonly the deep quote is left"),
        (3, 3, "u", ">> > two three four five six\nthree levels"),
    ]
    got = {(g.conv_id, g.turn): (g.reply_to, g.quoted_from) for g in threads(spark.createDataFrame(rows, COLUMNS)).collect()}
    none = (None, "")
    assert got == {(1, 0): none, (1, 1): none, (1, 2): (0, "1:0"), (1, 3): (1, "1:1"), (1, 4): (1, "1:1"), (1, 5): none, (2, 0): none, (3, 0): none, (3, 1): (0, "1:0"), (3, 2): (1, "2:0"), (3, 3): (0, "3:0")}


def test_a_long_chain_of_replies(spark):
    rows = [(1, t, "u", (f"> says {t - 1}\n" if t else "") + f"says {t}") for t in range(700)]
    got = threads(spark.createDataFrame(rows, COLUMNS)).agg(F.max("reply_depth"), F.min("thread"), F.max("thread"), F.count("reply_to")).first()
    assert tuple(got) == (699, 0, 0, 699)


def written(spark, root):
    """Bytes in the session's own folders (shuffles) and in ``root`` (settled tables)."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(os.path.getsize(os.path.join(d, x)) for top in [*folders, root] for d, _, names in os.walk(top) for x in names)


def test_disk_stays_in_proportion_to_the_texts(spark):
    words = [f"w{k}x{k * k}" for k in range(3000)]
    r = random.Random(4)
    rows = [(c, t, "u", " ".join(r.choices(words, k=80))) for c in range(500) for t in range(8)]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    messages = settle(as_mail(spark.createDataFrame(rows, COLUMNS)), "mail")
    before = written(spark, root)
    assert threads(messages).where("n_quoted > 0").count() > 1000
    assert written(spark, root) - before < 2 * sum(len(x[3]) for x in rows)


def test_blocks_of_turns_and_few_or_many_shingles_give_the_sql(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(c, t, r.choice(["user", None]), " ".join(r.choices(words, k=r.randint(1, 40)))) for c, turns in enumerate((range(-70, 140), range(60, 68), (1, 3, 4, 63, 64, 66, 67, 128))) for t in turns]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    told = con.execute(ORACLE)
    names = [d[0] for d in told.description]
    want = sorted(map(repr, told.fetchall()))
    mail = settle(as_mail(spark.createDataFrame(rows, COLUMNS)), "mail")
    for held in (4096, 20, 0):
        assert sorted(repr(tuple(g[n] for n in names)) for g in threads(mail, held=held).collect()) == want


def test_mail_at_the_ends_of_the_turns(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(1, low, "u", "a"), (1, low + 1, "u", "b"), (1, high - 1, "u", "c"), (1, high, "u", "d"), (1, high, "u", "e")]
    got = sorted((g.turn, g.text[-1]) for g in as_mail(spark.createDataFrame(rows, COLUMNS)).collect())
    assert got == [(t, x) for _, t, _, x in rows]
