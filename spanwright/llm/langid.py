"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of a line has a label; affixes, letter n-grams and a lexicon of frequent words
score it, and learned transitions tie it to its neighbours. Forward-backward gives
each word's label distribution, and a document's is the mean over its words with letters.

The model is fitted on a bounded sample of labelled documents: of each language up to ``DOCS``
documents with the smallest hash of their id, fewer if the languages are so many that these
would exceed ``SAMPLE`` in all, and of each of these up to ``PIECES`` pieces of ``PIECE`` words
spread over the whole text. Every language is learned, however many there are, up to ``SAMPLE``
labels, more than there are languages. Pieces of different documents are put together to
chains, so that the transitions see switches. Labelling covers every word of every text; words
without letters are no part of a chain.

Defined results: a null text, or one without letters, is ``und`` with score 0; rows with equal
texts get equal labels; repeated rows each get a row; without any labelled row all are
``und``; null ids are never held out nor learned from; other columns are ignored by
:func:`identify` and kept, whatever their names, by :func:`keep_known`; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_names, let, named, small_batches

#: The sample's bounds: documents of a language, pieces of a document, words of a piece, letters of a word, documents in all.
DOCS, PIECES, PIECE, LETTERS, SAMPLE = 80, 16, 16, 64, 10_240
#: Chains of a batch are lines, cut after so many words.
CHAIN = 128
#: Words whose scores a worker remembers.
CACHE = 200_000
UNKNOWN = "und"
#: What goes from texts before they are cut into words: neither letters nor white space.
_NOISE = re.compile(r"[^\w\s]+|[\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def features(word: str) -> list[str]:
    """Lexicon entry, affixes up to 3 letters and letter pairs and triples of a lower-cased word, over its letters alone."""
    w = word if word.isalpha() else "".join([c for c in word if c.isalpha()])
    if not w:
        return []
    edged = f"^{w}$"
    out = ["=" + w]
    out += ["<" + w[:n] for n in (1, 2, 3)] + [">" + w[-n:] for n in (1, 2, 3)]
    out += [edged[k : k + 2] for k in range(len(edged) - 1)]
    out += [edged[k : k + 3] for k in range(len(edged) - 2)]
    return out


def _gram(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each run of ``n`` code points, which stands for their string."""
    wide = codes.astype(np.uint64)
    key = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        key = key * _BASE + wide[k : len(codes) - n + 1 + k]
    return key ^ key >> np.uint64(29)


def _key(text: str) -> int:
    return int(_gram(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), len(text))[0])


class Model:
    """labels, the number of each feature, their weights (features by labels), transitions and start weights.

    Affixes are letter runs at a word's edge, so that all features but the lexicon's are runs of
    2 to 4 characters of the edged word: their weights are summed by run, and looked up for all words at once.
    """

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.labels, self.index, self.weights, self.moves, self.start = labels, index, weights, moves, start
        self.lexicon = {f[1:]: k for f, k in index.items() if f[0] == "="}
        sums: dict[int, np.ndarray] = {}
        for f, k in index.items():
            run = "^" + f[1:] if f[0] == "<" else f[1:] + "$" if f[0] == ">" else f
            if f[0] != "=":
                sums[_key(run)] = sums.get(_key(run), 0) + weights[k]
        self.keys = np.array(sorted(sums), dtype=np.uint64)
        self.by_key = np.array([sums[k] for k in sorted(sums)]).reshape(-1, len(labels))

    def slow_scores(self, word: str) -> tuple[np.ndarray, bool]:
        known = [self.index[f] for f in features(word) if f in self.index]
        return self.weights[known].sum(axis=0), bool(known)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label scores of words, whether each has letters, and whether the model knows any of its features."""
        bare = [w if w.isalpha() else "".join([c for c in w if c.isalpha()]) for w in words]
        letters = np.array([bool(w) for w in bare], dtype=bool)
        out, known = np.zeros((len(words), len(self.labels))), np.zeros(len(words), dtype=bool)
        codes = np.frombuffer("".join([f"^{w}$" for w in bare]).encode("utf-32-le"), dtype=np.uint32)
        word = np.repeat(np.arange(len(bare)), np.array([len(w) + 2 for w in bare], dtype=np.int64))
        for n in (2, 3, 4):
            if len(codes) < n or not len(self.keys):
                continue
            inside = word[n - 1 :] == word[: len(codes) - n + 1]
            if n == 4:
                inside &= (codes[: -n + 1] == 94) | (codes[n - 1 :] == 36)
            key, at = _gram(codes, n)[inside], word[n - 1 :][inside]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[place] == key
            place, at = place[met], at[met]
            known[at] = True
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(at, self.by_key[place, k], len(bare))
        entry = np.array([self.lexicon.get(w, -1) for w in bare], dtype=np.int64)
        out[entry >= 0] += self.weights[entry[entry >= 0]]
        known |= entry >= 0
        for k in [k for k, w in enumerate(bare) if len(w) < 3]:  # their affixes coincide
            out[k], known[k] = self.slow_scores(bare[k])
        return out, letters, known


def forward_backward(score: np.ndarray, length: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains side by side (time by chain by label, chains by falling length): label distributions, expected moves, log of all normalisers."""
    times, chains, labels = score.shape
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(times)]  # chains longer than t
    top = score.max(axis=2, keepdims=True)
    local, step = np.exp(score - top), np.exp(moves)
    alpha, scale = np.zeros_like(score), np.ones((times, chains))
    for t in range(times):
        n = active[t]
        a = local[t, :n] * (np.exp(start) if t == 0 else alpha[t - 1, :n] @ step)
        scale[t, :n] = a.sum(axis=1)
        alpha[t, :n] = a / scale[t, :n, None]
    beta, pairs = np.ones_like(score), np.zeros((labels, labels))
    for t in range(times - 2, -1, -1):
        n = active[t + 1]
        ahead = local[t + 1, :n] * beta[t + 1, :n] / scale[t + 1, :n, None]
        pairs += step * (alpha[t, :n].T @ ahead)
        beta[t, :n] = ahead @ step.T
    held = np.arange(times)[:, None] < length[None, :]
    return alpha * beta, pairs, float(np.log(scale[held]).sum() + top[..., 0][held].sum())


def fit(texts: list[tuple[str, str]], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3, seed: int = 7) -> Model | None:
    """A model from (language, text) pairs; None without any word."""
    pieces = []
    for lang, text in texts:
        words = text.lower().split()
        cuts = [words[k : k + PIECE] for k in range(0, len(words), PIECE)]
        every = max(1, -(-len(cuts) // PIECES))
        pieces += [(lang, c) for c in cuts[::every] if any(map(features, c))]
    if not pieces:
        return None
    labels = sorted({lang for lang, _ in pieces})
    random.Random(seed).shuffle(pieces)
    stream = [(w, labels.index(lang)) for lang, c in pieces for w in c]
    times = min(64, len(stream))
    chains = len(stream) // times
    stream = stream[: times * chains]
    vocabulary = sorted({w for w, _ in stream})
    number = {w: k for k, w in enumerate(vocabulary)}
    word = np.array([number[w] for w, _ in stream]).reshape(chains, times).T
    gold = np.array([y for _, y in stream]).reshape(chains, times).T

    uses = Counter(w for w, _ in stream)
    seen = Counter()
    for w, n in uses.items():
        for f in set(features(w)):
            seen[f] += n
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    ids, rows = [], []
    for k, w in enumerate(vocabulary):
        known = [index[f] for f in features(w) if f in index]
        ids += known
        rows += [k] * len(known)
    ids, rows, size = np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64), len(labels)

    target = np.zeros((len(vocabulary), size))
    np.add.at(target, (word.ravel(), gold.ravel()), 1)
    moved = np.zeros((size, size))
    np.add.at(moved, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    first = np.bincount(gold[0], minlength=size).astype(float)
    params = [np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(size)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lengths = np.full(chains, times)
    for n in range(1, rounds + 1):
        weights, moves, start = params
        score = np.stack([np.bincount(rows, weights[ids, k], len(vocabulary)) for k in range(size)], axis=1)
        belief, pairs, _ = forward_backward(score[word], lengths, moves, start)
        expected = np.stack([np.bincount(word.ravel(), belief[..., k].ravel(), len(vocabulary)) for k in range(size)], axis=1)
        by_word = expected - target
        slopes = [np.stack([np.bincount(ids, by_word[rows, k], len(index)) for k in range(size)], axis=1), pairs - moved, belief[0].sum(axis=0) - first]
        for p, g, m, v in zip(params, slopes, mean, square, strict=True):
            g = g / word.size + decay * p / max(1, len(index)) ** 0.5
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return Model(labels, index, params[0], params[1], params[2])


class Labeller:
    """Labels whole texts with a model, many chains at once."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = np.zeros((0, len(self.model.labels)))
        self.letters, self.met = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.number})
        if new:
            if len(self.number) + len(new) > CACHE and self.number:
                self._forget()
                new = list(set(words))
            scores, letters, met = self.model.scores(new)
            self.number.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known, self.letters, self.met = np.concatenate([self.known, scores]), np.concatenate([self.letters, letters]), np.concatenate([self.met, met])
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def _chains(self, chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chain: summed distributions, words with letters, changes of label between them, words of which a feature is known."""
        length = np.array([len(c) for c in chains])
        order = np.argsort(-length, kind="stable")
        sorted_ = length[order]
        flat = self._numbers([w for k in order.tolist() for w in chains[k]])
        chain = np.repeat(np.arange(len(chains)), sorted_)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sorted_) - sorted_, sorted_)
        score = np.zeros((int(sorted_[0]), len(chains), len(self.model.labels)))
        score[at, chain] = self.known[flat]
        belief, _, _ = forward_backward(score, sorted_, self.model.moves, self.model.start)
        own, letters = belief[at, chain], self.letters[flat]
        own, where, met = own[letters], chain[letters], self.met[flat][letters]
        sums = np.stack([np.bincount(where, own[:, k], len(chains)) for k in range(own.shape[1])], axis=1)
        best = own.argmax(axis=1)
        changes = np.bincount(where[1:][(best[1:] != best[:-1]) & (where[1:] == where[:-1])], minlength=len(chains))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return sums[back], np.bincount(where, minlength=len(chains))[back], changes[back], np.bincount(where[met], minlength=len(chains))[back]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """(language, score, words with letters, switches) of each text."""
        return [found[:4] for found in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int, int, int]]:
        """As :meth:`label`, with the number of words of which the model knows a feature."""
        sums, counts = np.zeros((len(texts), len(self.model.labels))), np.zeros((len(texts), 3), dtype=np.int64)
        owners, chains, held = [], [], 0
        most = max(64, 4_000_000 // (CHAIN * len(self.model.labels)))

        def work():
            found, own = self._chains(chains), np.array(owners)
            np.add.at(sums, own, found[0])
            for k in range(3):
                np.add.at(counts[:, k], own, found[k + 1])

        for k, t in enumerate(texts):
            for line in _NOISE.sub("", (t or "").lower()).split("\n"):
                words = line.split()
                for a in range(0, len(words), CHAIN):
                    owners.append(k)
                    chains.append(words[a : a + CHAIN])
                    held += len(chains[-1])
                    if held >= 100_000 or len(chains) >= most:
                        work()
                        owners, chains, held = [], [], 0
        if chains:
            work()
        best = sums.argmax(axis=1).tolist() if len(texts) else []
        return [(self.model.labels[b], min(1.0, float(s[b] / c[0])), *c.tolist()) if c[0] else (UNKNOWN, 0.0, 0, 0, 0) for b, s, c in zip(best, sums, counts, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def shortened(text: Column) -> Column:
    """Up to PIECES pieces of PIECE words, of LETTERS letters at most, spread over the whole text."""
    words = F.filter(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")

    def pieces(own: Column) -> Column:
        cuts = F.ceil(F.size(own) / PIECE)
        step = F.greatest(F.lit(1), F.ceil(cuts / PIECES)).cast("int") * PIECE
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), step)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda k: F.slice(own, k, F.lit(PIECE))))

    return F.array_join(F.transform(let(words, pieces), lambda w: F.substring(w, 1, LETTERS)), " ")


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """The (language, text) pairs to learn from, SAMPLE at most; texts are fetched for the chosen ids alone and shortened where they are read."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    common = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()]
    each = max(1, min(DOCS, SAMPLE // max(1, len(common))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.where(F.col("lang").isin(common)).withColumn("nth", nth).where(F.col("nth") <= each).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    rows = docs.select(F.col(doc_id).alias("_own"), F.col(lang).cast("string").alias("_told"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(ids), (F.col("_own") == F.col("_id")) & (F.col("_told") == F.col("_lang")))
    rows = rows.select("_lang", "_id", shortened(F.col("_text")).alias("_text")).groupBy("_lang", "_id").agg(F.min("_text").alias("_text"))
    return [(r._lang, r._text) for r in rows.orderBy("_lang", F.xxhash64("_id"), "_id").collect()]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    return fit(sample(docs, doc_id, text, lang))


ADDED = (("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("words", T.LongType(), pa.int64()), ("switches", T.LongType(), pa.int64()), ("known", T.LongType(), pa.int64()))


def annotate(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns ADDED, and the names these got: their own unless ``docs`` has such columns."""
    small_batches(docs.sparkSession, 256)
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    names = free_names(docs.columns, *(n for n, _, _ in ADDED))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, (_, kind, _) in zip(names, ADDED, strict=True))])

    def run(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(place).to_pylist()
            found = labeller.judge(texts) if labeller else [(UNKNOWN, 0.0, 0, 0, 0)] * len(texts)
            columns = [pa.array([f[k] for f in found], kind) for k, (_, _, kind) in enumerate(ADDED)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], schema.names)

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema), names  # names with dots can't be handed over


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, words, switches of every row."""
    model = learn(docs, doc_id, text, lang)
    seen, _ = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), model)
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "words", "switches")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that no language fits; a null language becomes the one found.

    These are rows without any word, and those of which the model knows no feature at all,
    as in a script that no learned language is written in. However low a score is, no row goes for it.
    """
    seen, (found, _, _, _, known) = annotate(docs, learn(docs, doc_id, text, lang), text)
    return seen.where(F.col(known) > 0).withColumn(lang, F.coalesce(lang, found)).select(*named(docs))
