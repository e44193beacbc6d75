"""Language identification with interpolated Kneser-Ney language models over characters, one per language.

The model's n-grams are those of words: lower-cased runs of letters with a mark at either end. Spark counts words per
language over all training rows, then n-grams over the distinct words, and from these the shares and weights. n-grams
are keyed by hashes of 64 bits, so the model holds every n-gram seen, and its arrays are sorted by hash. A text gets
the language of the lowest cross-entropy per character; the score is that language's share of a softmax over the
length-normalised cross-entropies at a temperature.

Temperature and rejection are calibrated on rows that the counts of the model judging them left out (a tenth of the
training rows, chosen by hash, all of it); the final model then counts all rows. A text is rejected if its
cross-entropy is higher than those rows' mean by more than MARGIN times the largest excess among them (which shrinks
with the root of the length), or if its score isn't above that of calibration rows that were told wrong (as far as at
most LOSS of the right ones lie below).

Edge cases: a null text or one without letters gets 'und', score 0, and is rejected; equal cross-entropies go to the
language that sorts first; rows without a language aren't learned from; without any training row all is 'und'; repeated
rows count as often as they stand, for calibration once; very long texts are read whole; an empty table gives an empty
result. identify() reads only doc_id and text; accepted() passes further columns under other names, so none can clash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .lookups import Numbered, Sorted, mixed

ORDER, DISCOUNT = 4, 0.75
#: How far beyond calibration rows a cross-entropy may lie; the share of right ones a least score may cost; temperatures.
MARGIN, LOSS, GRID = 1.5, 0.001, np.geomspace(0.5, 64, 15)
#: Words that a worker keeps scored.
MEMORY = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _tenth() -> Column:
    """Whether a row is in the tenth from which calibration rows are taken."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)) == 0


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all words with a mark at either end, as one array; each character's word and place in it."""
    text = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(chars == 2)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chars))))
    return chars, word, np.arange(len(chars)) - starts[word]


def _hashes(chars: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that ends at each character; of fewer characters at the start of a word."""
    h = chars + np.uint64(1)
    for back in range(1, n):
        more = (chars[:-back] + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, back, 2**64))
        h[back:] += np.where(place[back:] >= back, more, np.uint64(0))
    return mixed(h)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n and kept over all rows with a language: occurrences, and those outside the tenth for calibration."""
    # held comes before the words are spread, else Spark hashes the text again for each
    bits = docs.where(F.col("lang").isNotNull()).select("lang", _tenth().alias("held"), F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+").alias("words"))
    bits = bits.select("lang", "held", F.explode("words").alias("word"))
    return bits.where("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("held")).cast("long")).alias("kept"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, size, gram, context (hashes of the n-gram and of all but its last character), n (count), first (a hash of
    all but its first character) over distinct words, each as often as it was counted."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, group in part.groupby("lang"):
                chars, word, place = _codes(group["word"].tolist())
                n = group["n"].to_numpy(np.int64)[word]
                inner = chars != 2  # what is predicted: all but the mark at the start
                context = {k: np.roll(_hashes(chars, place, k), 1) if k else np.zeros(len(chars), np.uint64) for k in range(ORDER)}
                grams = {k: _hashes(chars, place, k) for k in range(1, ORDER + 1)}
                for k in range(1, ORDER + 1):
                    out = pd.DataFrame({"gram": grams[k][inner].astype(np.int64), "context": context[k - 1][inner].astype(np.int64), "lower": (grams[k - 1] if k > 1 else context[0])[inner].astype(np.int64), "n": n[inner]})
                    out = out.groupby(["gram", "context", "lower"], as_index=False)["n"].sum()
                    yield out.assign(lang=lang, size=k)

    out = words.mapInPandas(run, "gram long, context long, lower long, n long, lang string, size int")
    return out.groupBy("lang", "size", "gram", "context", "lower").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """tables: per order, by n-gram hash and for all languages at once, the n-gram's own share of probability and the
    weight that it leaves, as a context, to the lower order. start: that weight for the empty context."""

    langs: list[str]
    start: np.ndarray
    tables: list[Sorted]
    floor: float
    temperature: float = 1.0
    mean: float = 0.0
    excess: float = np.inf
    least: float = 0.0

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: bits under each language's model, and predicted characters."""
        chars, word, place = _codes(words)
        weight, p = self.start, self.floor
        for k, table in enumerate(self.tables, 1):
            found = table.get(_hashes(chars, place, k))
            p = found[:, : len(self.langs)] + weight * p
            weight = np.roll(found[:, len(self.langs) :], 1, axis=0)
        inner = chars != 2
        ends = np.flatnonzero(np.diff(word[inner], prepend=-1))
        return np.add.reduceat(-np.log2(p[inner]), ends), np.diff(np.append(ends, inner.sum())).astype(np.float64)

    def coded(self, found: list[list[str]]) -> np.ndarray:
        """Places of all words in a memory of scored words, which starts anew beyond MEMORY words."""
        if "_seen" not in self.__dict__ or len(self._seen) > MEMORY:
            self._seen, self._bits, self._chars = Numbered(), np.zeros((0, len(self.langs))), np.zeros(0)
        code = np.fromiter(map(self._seen.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        if self._seen.new:
            bits, chars = self.costs(self._seen.new)
            self._bits, self._chars = np.concatenate([self._bits, bits]), np.concatenate([self._chars, chars])
            self._seen.new.clear()
        return code

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character under each model, and characters (0: no letter). Words are scored
        once for all texts of the batch."""
        found = [[w for w in LETTERS.findall(t.lower()) if w.isalpha()] if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, chars = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if sizes.sum() and self.langs:
            code = self.coded(found)
            doc = np.repeat(np.arange(len(texts)), sizes)
            chars = np.bincount(doc, self._chars[code], len(texts))
            for i in range(len(self.langs)):
                total[:, i] = np.bincount(doc, self._bits[code, i], len(texts))
        return total / np.maximum(chars, 1)[:, None], chars

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy of the best model, and whether the text is rejected."""
        bits, chars = self.texts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, known = bits.min(1), chars > 0
        share = np.exp(-self.temperature * (bits - best[:, None]))
        score = np.where(known, 1 / share.sum(1), 0.0)
        odd = best > self.mean + MARGIN * self.excess / np.sqrt(np.maximum(chars, 1))
        return [self.langs[i] if k else "und" for i, k in zip(bits.argmin(1), known)], score, best, ~known | odd | (score <= self.least)


def _table(own: pd.DataFrame, left: pd.DataFrame, langs: list[str]) -> Sorted:
    """The two parts of an order's table from rows of lang, gram, p and of lang, context, w."""
    own_keys, left_keys = own["gram"].to_numpy(np.int64).astype(np.uint64), left["context"].to_numpy(np.int64).astype(np.uint64)
    keys = np.union1d(own_keys, left_keys)
    values = np.concatenate([np.zeros((len(keys), len(langs))), np.ones((len(keys), len(langs)))], 1)
    for frame, key, value, shift in ((own, own_keys, "p", 0), (left, left_keys, "w", len(langs))):
        values[np.searchsorted(keys, key), pd.Categorical(frame["lang"], categories=langs).codes + shift] = frame[value]
    return Sorted(keys, values, np.concatenate([np.zeros(len(langs)), np.ones(len(langs))]))


def shares(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From gram_counts: lang, size, gram, p (its share of its context's probability), and lang, size, context, w (the
    weight that a context leaves to the lower order). The highest order uses counts, lower ones the number of different
    n-grams that they end."""
    c = F.col
    top = grams.where(c("size") == ORDER).select("lang", "size", "gram", "context", c("n").cast("double").alias("n"))
    higher = grams.where("size > 1").groupBy("lang", (c("size") - 1).alias("size"), c("lower").alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    below = grams.where(c("size") < ORDER).select("lang", "size", "gram", "context").join(higher, ["lang", "size", "gram"])
    counts = top.unionByName(below)
    sums = cut(counts.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
    own = counts.join(sums, ["lang", "size", "context"]).select("lang", "size", "gram", (F.greatest(c("n") - DISCOUNT, F.lit(0.0)) / c("total")).alias("p"))
    return own, sums.select("lang", "size", "context", F.least(DISCOUNT * c("kinds") / c("total"), F.lit(1.0)).alias("w"))


def _model(counts: DataFrame) -> Model:
    """The model of lang, word, n. The finished tables reach the driver: an entry per distinct n-gram of up to ORDER
    characters inside words, which grows with what the corpus has of them and is bounded by the alphabets in it."""
    own, left = (t.toPandas() for t in shares(cut(gram_counts(counts))))
    langs = sorted(own["lang"].unique())
    characters = max(2, own.loc[own["size"] == 1, "gram"].nunique())
    start = left[left["size"] == 1].set_index("lang")["w"].reindex(langs).fillna(1.0).to_numpy()
    tables = [_table(own[own["size"] == k], left[left["size"] == k + 1], langs) for k in range(1, ORDER + 1)]
    return Model(langs, start, tables, 1.0 / (characters + 1))


def fit(docs: DataFrame) -> Model:
    """Counts, shares and weights over all rows with a language; temperature and rejection by a model without a tenth."""
    counts = cut(word_counts(docs))
    model = _model(counts.select("lang", "word", "n"))
    if model.langs:
        _calibrate(model, _model(counts.where("kept > 0").select("lang", "word", F.col("kept").alias("n"))), docs)
    return model


def _calibrate(model: Model, judge: Model, docs: DataFrame) -> None:
    """Sets model's temperature, mean, excess and least from all rows of the tenth. Their texts are scored by judge in the
    tasks that read them; sums, a maximum and the LOSS lowest scores of the right ones are taken by Spark."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & _tenth()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    if not judge.langs:
        return
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bits, chars = shared.value.texts(part["text"].tolist())
            true = pd.Categorical(part["lang"], categories=shared.value.langs).codes
            known = (chars > 0) & (true >= 0)
            bits, chars, true = bits[known], chars[known], true[known]
            own, best = bits[np.arange(len(bits)), true], bits.min(1)
            loss = np.stack([np.log(np.exp(-t * (bits - own[:, None])).sum(1).clip(1, 1e300)) for t in GRID], 1)
            score = np.stack([1 / np.exp(-t * (bits - best[:, None])).sum(1) for t in GRID], 1)
            yield pd.DataFrame({"h": part["h"].to_numpy()[known], "fine": bits.argmin(1) == true, "best": best, "chars": chars, "loss": list(loss), "score": list(score)})

    c = F.col
    found = cut(rows.mapInPandas(run, "h long, fine boolean, best double, chars double, loss array<double>, score array<double>").dropDuplicates(["h"]))
    means = found.agg(*(F.avg(F.get("loss", F.lit(i))).alias(f"l{i}") for i in range(len(GRID)))).first()
    if means[0] is None:
        return
    at = int(np.argmin(list(means)))
    model.temperature = float(GRID[at])
    scores = found.select("fine", "best", "chars", F.get("score", F.lit(at)).alias("score"))
    right = scores.where("fine")
    n, bits, chars = right.agg(F.count(F.lit(1)), F.sum(c("best") * c("chars")), F.sum("chars")).first()
    if not n:
        return
    model.mean = bits / chars
    model.excess = max(right.agg(F.max((c("best") - model.mean) * F.sqrt("chars"))).first()[0], 1.0)
    # the quantile lies between the two at its place in the order; no more than so many rows are needed
    place = (n - 1) * LOSS
    low = right.orderBy("score").limit(int(place) + 2).agg(F.sort_array(F.collect_list("score"))).first()[0]
    bound = low[int(place)] + (low[min(int(place) + 1, n - 1)] - low[int(place)]) * (place - int(place))
    model.least = scores.where(~c("fine") & (c("score") < bound)).agg(F.coalesce(F.max("score"), F.lit(0.0))).first()[0]


def _told(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns as c0, c1, ..., then lang_pred, score, bits (cross-entropy per character) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # an entry per distinct n-gram, see _model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                lang, score, bits, rejected = shared.value.predict(some.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(lang), pa.array(score), pa.array(bits), pa.array(rejected)], [*some.schema.names[1:], "lang_pred", "score", "bits", "rejected"])

    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    schema = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(columns)) + "lang_pred string, score double, bits double, rejected boolean"
    return docs.select(F.col("text").alias("t"), *kept).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (cross-entropy per character), rejected."""
    return _told(docs, model, ["doc_id"]).withColumnRenamed("c0", "doc_id")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with its columns; a null lang becomes the language told."""
    told = _told(docs, model, docs.columns).where("not rejected")
    return told.select(*((F.coalesce(f"c{i}", "lang_pred") if c == "lang" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
