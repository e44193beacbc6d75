"""Substring deduplication with suffix automata.

repeats(docs) removes every word that a window of so many words covers whose word sequence starts anywhere else in the
documents, the same one included. The reference is then the corpus itself, whose automata cannot be broadcast: they
grow with it. So shards of the reference are cut where windows can meet at all. Each window has an anchor, the 10-word
run of least hash inside it; equal windows have equal anchors, so an anchor that stands once rules its windows out. The
windows of one anchor make a segment. Where all segments of an anchor are equal, all their windows are repeated.
The others are dealt by anchor into shards; the task that owns a shard builds its suffix automaton and streams the
shard's segments for matching statistics. An anchor with more than SEGMENTS different segments is too much for one
shard: its windows are counted by content instead, which no hot passage can skew.

without(docs, reference) is the same against a reference of bounded size, whose automata are broadcast.

Edge cases: a null text has no words; texts shorter than a window lose nothing; repeated rows are repeats of each
other; a null doc_id is a document like any other; an empty table gives an empty result; only doc_id and text are read.
Segments are told apart by 128 bits of hash; the words compared in shards are the words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import beside, cut, small
from .lookups import mixed, windows, word_hashes

WINDOW, ANCHOR, SEGMENTS, SHARD, REFERENCE_ROWS = 35, 10, 1000, 2000, 100_000
OTHER = 0xD1342543DE82EF95


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def anchored(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start (of the first window), count (of windows), anchor and segment hash of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = word_hashes(words)
    grams = windows(h, ANCHOR)
    n = len(words) - window + 1
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1).argmin(1)
    start = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(np.append(start, n))
    # the hash of a stretch: a polynomial, read off its sums from the beginning of the text
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), np.uint64(OTHER))])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), np.uint64(pow(OTHER, -1, 2**64)))])
    sums = np.r_[np.uint64(0), np.cumsum(mixed(h) * up[:-1], dtype=np.uint64)]
    segment = mixed((sums[start + count + window - 1] - sums[start]) * down[start] + count.astype(np.uint64))
    return start, count, grams[place[start]], segment


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [anchored(split(t), window) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "tie": part["tie"].to_numpy(), **{k: [o[i].astype(np.int64) for o in out] for i, k in enumerate(("start", "count", "anchor", "segment"))}})

    return docs.mapInPandas(run, "doc_id long, tie long, start array<int>, count array<int>, anchor array<long>, segment array<long>")


def _segment_repeats(segments: DataFrame, window: int) -> DataFrame:
    """anchor, segment, starts: the repeated windows of each different segment. segments: anchor, segment, words, n."""
    c = F.col
    crowd = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    crowded = cut(crowd.where(c("crowd") > SEGMENTS).select("anchor"))
    few = segments.join(small(crowded), "anchor", "left_anti")
    many = segments.join(small(crowded), "anchor", "left_semi")

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, int] = {}
        sequences = [[names.setdefault(w, len(names)) for w in s.split(" ")] for s in part["words"]]
        own = SuffixAutomaton()
        for words, times in zip(sequences, part["n"]):
            own.add(words, int(times))
        own.finish()
        return pd.DataFrame({"anchor": part["anchor"], "segment": part["segment"], "starts": [own.repeated(words, window, 2) for words in sequences]})

    shards = max(1, segments.count() // SHARD)
    dealt = few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    out = dealt.groupBy("shard").applyInPandas(shard, "anchor long, segment long, starts array<int>")
    if crowded.count():
        one = many.withColumn("w", F.split("words", " ")).select("anchor", "segment", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("at"))
        content = F.slice("w", c("at") + 1, F.lit(window))
        one = cut(one.select("anchor", "segment", "n", "at", F.xxhash64(content).alias("h"), F.hash(content).alias("g")))
        double = one.groupBy("anchor", "h", "g").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "h", "g")
        counted = one.join(double, ["anchor", "h", "g"], "left_semi").groupBy("anchor", "segment").agg(F.collect_list("at").alias("starts"))
        out = out.unionByName(counted)
    return out.where(F.size("starts") > 0)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start, end of removed words), kept (the other words, joined by spaces)."""
    c = F.col
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    runs = cut(_runs(rows, window))
    flat = runs.select("doc_id", "tie", F.explode(F.arrays_zip("start", "count", "anchor", "segment")).alias("r")).select("doc_id", "tie", "r.*")
    shared = flat.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), (F.min("segment") != F.max("segment")).alias("mixed"))
    shared = cut(shared.where("times > 1").select("anchor", "mixed"))
    found = cut(flat.join(shared.hint("merge"), "anchor"))
    sure = found.where("not mixed").select("doc_id", "tie", "start", "count")
    open_ = found.where("mixed")

    # the words of the open segments, each different segment once
    lists = open_.groupBy(c("doc_id").alias("_id"), c("tie").alias("_tie")).agg(F.collect_set("start").alias("open"))
    texts = rows.join(beside(cut(lists), 0), c("doc_id").eqNullSafe(c("_id")) & (c("tie") == c("_tie")))

    def cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = {}
            for text, wanted in zip(part["text"], part["open"]):
                w = split(text)
                start, count, anchor, segment = anchored(w, window)
                for i in np.flatnonzero(np.isin(start, wanted)):
                    name = (anchor[i].astype(np.int64), segment[i].astype(np.int64))
                    if name not in out:
                        out[name] = b" ".join(w[start[i] : start[i] + count[i] + window - 1]).decode("utf-8", "surrogatepass")
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["anchor", "segment", "words"])

    words = texts.select("text", "open").mapInPandas(cut_out, "anchor long, segment long, words string").groupBy("anchor", "segment").agg(F.max("words").alias("words"))
    times = open_.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"))
    segments = cut(words.join(times, ["anchor", "segment"]))
    again = cut(_segment_repeats(segments, window))
    more = open_.join(small(again), ["anchor", "segment"]).select("doc_id", "tie", F.explode(_merged("starts", window)).alias("s"), "start")
    spans = sure.select("doc_id", "tie", c("start").alias("from"), (c("start") + c("count") + window - 1).alias("to"))
    spans = spans.unionByName(more.select("doc_id", "tie", (c("start") + c("s.from")).alias("from"), (c("start") + c("s.to")).alias("to")))
    spans = spans.groupBy(c("doc_id").alias("_id"), c("tie").alias("_tie")).agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("gone"))
    spans = spans.withColumn("gone", _joined_spans(c("gone")))
    rows = rows.join(beside(cut(spans), 0), c("doc_id").eqNullSafe(c("_id")) & (c("tie") == c("_tie")), "left")
    return rows.select("doc_id", "text", "gone").mapInPandas(_removed, REMOVED)


def _joined_spans(spans: Column) -> Column:
    """Maximal spans of sorted ones that overlap or adjoin."""

    def step(out, s):
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))))
        return F.when(F.size(out) == 0, F.array(s)).when(last["to"] >= s["from"], longer).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<from:int,to:int>>"), step)


def _merged(starts: str, window: int) -> Column:
    """Maximal spans of the windows that start at these places."""
    return _joined_spans(F.transform(F.array_sort(starts), lambda s: F.struct(s.alias("from"), (s + window).alias("to"))))


REMOVED = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


def _removed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Removes spans (gone: from, to) of words; adjoining spans become maximal ones."""
    for part in parts:
        out = []
        for text, gone in zip(part["text"], part["gone"]):
            w = split(text)
            edge = np.zeros(len(w) + 1, np.int64)
            for s in gone if gone is not None else ():
                edge[s["from"]] += 1
                edge[s["to"]] -= 1
            off = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.r_[False, off, False]))
            kept = b" ".join(w if not len(turns) else [x for x, o in zip(w, off) if not o]).decode("utf-8", "surrogatepass")
            out.append((len(w), int(off.sum()), [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)], kept))
        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **{k: [o[i] for o in out] for i, k in enumerate(("n_words", "n_removed", "spans", "kept"))}})


def without(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """repeats()'s columns, for words covered by windows that occur in reference (a text column) of at most
    REFERENCE_ROWS rows; one automaton per 1,000 of its texts is broadcast."""
    rows = reference.select("text").limit(REFERENCE_ROWS + 1).toPandas()["text"].tolist()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"a reference of more than {REFERENCE_ROWS} texts is no broadcast; use repeats() on the union")
    shared = docs.sparkSession.sparkContext.broadcast(sorted({b" ".join(split(t)) for t in rows}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = []
        for at in range(0, len(shared.value), 1000):
            shards.append(SuffixAutomaton())
            for t in shared.value[at : at + 1000]:
                shards[-1].add(t.split())
            shards[-1].finish()
        for part in parts:
            gone = [[{"from": s, "to": s + window} for a in shards for s in a.repeated(split(t), window)] for t in part["text"]]
            yield from _removed(iter([part.assign(gone=gone)]))

    return docs.select("doc_id", "text").mapInPandas(run, REMOVED)
