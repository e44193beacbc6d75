"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and their beginnings of 3 to 6 letters (for word endings), each counted once per
text and hashed to 20 bits. The model is a bias, a weight per term and a vector per term; the products of two terms'
vectors give what a pair adds beyond both weights, such as an insult next to the mention of a group. It is fitted on a
bounded sample of labelled rows (SAMPLE). Every term in LEAST or more of these has a vector, since a pair may tell what
neither term does alone; only terms whose own share of toxic rows differs from the sample's by LEVEL standard errors have
a weight besides. Against learning rows by heart, the epoch that does best on a tenth of the rows, held back, is taken.
All texts are then scored in tasks, whole.

Edge cases: a null or empty text has no terms and gets the score of the bias; a doc_id with several labels counts as
toxic if one says so, a null label counts as none; without labelled rows every score is 0; repeated rows are scored
each, and alike; equal scores are left equal; very long texts are read whole, their terms counted once each; an empty
table gives an empty result; rows are learnt from in the order of a hash of doc_id, however tasks have them; only doc_id
and text are read, so further columns can't clash."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .lookups import Numbered

BITS, FACTORS, SAMPLE, LEAST, LEVEL, EPOCHS, MEMORY = 20, 6, 20_000, 4, 4.5, 12, 200_000
#: Of the vectors: spread at first, step, decay (times LONG per learning row), and terms beyond which a long text counts less.
INIT, STEP, DECAY, LONG = 0.01, 1.0, 0.3, 30
LETTERS = re.compile(r"[^\W\d_]+")


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Terms:
    """Terms of texts, as hashes or, given the sorted hashes of known terms, as places among these. Words seen before
    are looked up; beyond MEMORY words that starts anew."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = known
        self.places = {} if known is None else dict(zip(known.tolist(), range(len(known))))
        self._clear()

    def _clear(self) -> None:
        self.words = Numbered()
        self.codes, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Remembers the terms of new words."""
        codes, sizes = [], []
        for word in self.words.new:
            found = {_hash(word), *(_hash(word[:k] + "+") for k in range(3, 7) if len(word) > k)}
            if self.known is not None:
                found = [self.places[x] for x in found if x in self.places]
            codes += found
            sizes.append(len(found))
        self.words.new.clear()
        self.codes = np.append(self.codes, np.array(codes, np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) pairs, each once, in order."""
        if len(self.words) > MEMORY:
            self._clear()
        found = [set(LETTERS.findall(t.lower())) if isinstance(t, str) else () for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
        if self.words.new:
            self._learn()
        times = self.ends[word + 1] - self.ends[word]
        at = np.repeat(self.ends[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs = (np.repeat(np.repeat(np.arange(len(texts)), sizes), times) << BITS) | self.codes[at]
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Machine:
    bias: float
    known: np.ndarray  # sorted hashes
    weight: np.ndarray
    vector: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the logit, and the sums of its terms' vectors. term: places among the known, in the order of doc."""
        out = np.zeros((n, FACTORS + 2))
        if len(doc):
            vector = self.vector[term]
            rows = np.column_stack([vector, np.einsum("pf,pf->p", vector, vector), self.weight[term]])
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[first]] = np.add.reduceat(rows, first)
        sums = out[:, :FACTORS]
        return self.bias + out[:, -1] + 0.5 * ((sums**2).sum(1) - out[:, FACTORS]), sums


def telling(codes: np.ndarray, rows: np.ndarray, toxic: np.ndarray, total: int, total_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms to learn from, sorted, and whether each has a weight: found in so many rows, so many of them toxic."""
    share = total_toxic / total
    z = (toxic - rows * share) / np.sqrt(np.maximum(rows * share * (1 - share), 1e-9))
    order = np.argsort(codes)
    order = order[rows[order] >= LEAST]
    return codes[order], np.abs(z[order]) >= LEVEL


def train(known: np.ndarray, weighted: np.ndarray, doc: np.ndarray, term: np.ndarray, y: np.ndarray, seed: int = 1) -> Machine:
    """Logistic loss by AdaGrad over small batches, in an order fixed by the seed; the epoch with the least loss on held-back
    rows. Terms that aren't weighted keep the weight 0."""
    rng = np.random.default_rng(seed)
    size = len(known)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(rate / (1 - rate))), known, np.zeros(size), rng.normal(0, INIT, (size, FACTORS)))
    starts = np.searchsorted(doc, np.arange(len(y) + 1, dtype=doc.dtype))
    seen_w = np.full(size, 1e-8)

    def terms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = starts[rows + 1] - starts[rows]
        at = np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(rows)), sizes), term[at]

    back, learn = np.split(rng.permutation(len(y)), [len(y) // 10])
    best, decay = np.inf, min(DECAY * LONG / max(len(learn), 1), 0.1)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            d, t = terms(rows)
            z, sums = m.logits(d, t, len(rows))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
            used, place = np.unique(t, return_inverse=True)
            e = error[d]
            grad_w = np.bincount(place, e, len(used)) / len(rows) + 1e-4 * m.weight[used]
            e = e * np.minimum(1, LONG / np.maximum(np.bincount(d, minlength=len(rows)), 1))[d]
            grad_v = np.stack([np.bincount(place, e * (sums[d, f] - m.vector[t, f]), len(used)) for f in range(FACTORS)], 1) / len(rows)
            seen_w[used] += grad_w**2
            m.bias -= 0.05 * float(error.mean())
            m.weight[used] -= 0.15 * grad_w / np.sqrt(seen_w[used]) * weighted[used]
            m.vector *= 1 - STEP * decay
            m.vector[used] -= STEP * np.clip(grad_v, -0.1, 0.1)
        parts = np.array_split(back, max(1, len(back) // 128)) if len(back) else []
        z = np.concatenate([m.logits(*terms(rows), len(rows))[0] for rows in parts] or [np.zeros(0)])
        loss = np.logaddexp(0, np.where(y[back] > 0, -z, z)).sum()
        if loss <= best or not len(back):
            best, kept = loss, Machine(m.bias, known, m.weight.copy(), m.vector.copy())
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine from the rows of at most sample labelled doc_ids, the first by a hash of doc_id. Terms are counted in Spark; counts
    (at most 2**BITS) and the known terms of each row reach the driver."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    # the sample is chosen among labels, which are small; its bounded list of ids then meets the texts where they are
    chosen = cut(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(parts: Iterator[pd.DataFrame], known=None) -> Iterator[pd.DataFrame]:
        of = Terms(known)
        for part in parts:
            doc, term = of.pairs(part["text"].tolist())
            groups = np.split(term, np.searchsorted(doc, np.arange(1, len(part)))) if len(part) else []
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": (part["y"] > 0).astype("int32"), "terms": groups})

    rows = cut(rows.select("doc_id", "text", "y").repartition(docs.sparkSession.sparkContext.defaultParallelism))
    shape = "doc_id long, y int, terms array<int>"
    totals = rows.agg(F.count(F.lit(1)), F.sum((F.col("y") > 0).cast("long"))).first()
    if not totals[0]:
        return None
    counts = rows.mapInPandas(run, shape).select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    counts = counts.where(F.col("n") >= LEAST).toPandas()
    known, weighted = telling(*(counts[c].to_numpy(np.int64) for c in ("term", "n", "y")), *totals)

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in run(parts, known):
            yield part.assign(terms=[t.astype(np.int32).tobytes() for t in part["terms"]])

    # four bytes a term, and a partition at a time, so that the driver holds little besides
    got = [(r["place"], r["doc_id"], r["y"], bytes(r["terms"])) for r in cut(rows.mapInPandas(packed, "doc_id long, y int, terms binary").withColumn("place", F.xxhash64("doc_id"))).toLocalIterator()]
    got.sort()  # the order in which rows are learnt from is theirs, not that of tasks
    doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(t) // 4 for *_, t in got])
    term = np.frombuffer(b"".join(t for *_, t in got), np.int32)
    return train(known, weighted, doc, term, np.array([y for _, _, y, _ in got], np.float64))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score (0 to 1). The machine's size is fixed by BITS and FACTORS."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        of = Terms(m.known) if m else None
        for part in parts:
            for at in range(0, len(part), 500):
                some = part.iloc[at : at + 500]
                if m is None:
                    yield pd.DataFrame({"doc_id": some["doc_id"], "score": 0.0})
                    continue
                doc, term = of.pairs(some["text"].tolist())
                z, _ = m.logits(doc, term, len(some))
                yield pd.DataFrame({"doc_id": some["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
