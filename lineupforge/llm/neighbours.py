"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are normalised, so the largest inner product is the largest cosine, and cut into parts of four bits each. The
codebooks and the codes minimise a loss in which the residual's component along the vector weighs more than the rest,
since it is this that changes the score of a query that the vector matches. A scan adds up one table entry per part
and query; the best of each block are reranked by the exact cosine in double precision, and with them all whose rough
score, and a share of what their code leaves out, reaches the k-th of these, or whose rough score is that of one of
these k: large groups of near copies with equal codes lose none.

That share is calibrated: on the sample, codes fall short of the exact scores of near rows by more than it in one case of
SHORT. With exact=True it is 1, beyond which no query can be; then no nearer row is lost, and many more are reranked.

The codebooks are fitted on at most SAMPLE vectors, chosen by a hash; every vector is coded, once, and written beside its code of two parts
a byte. Queries go in blocks of at most QUERIES, each broadcast (a bounded size) to a scan of all codes; of each scanned
block only a query's best few remain. There is no coarse partition, so nothing is lost to one.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part; equal cosines are ordered by the smaller vec_id; a query is no candidate for itself, that is, for any row of
its vec_id; repeated rows of one vec_id are candidates each, and of a
query the one that sorts first asks; an empty table gives an empty result; only vec_id and
embedding are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PART, CENTRES, SAMPLE, QUERIES, RERANK, BLOCK, PARALLEL = 2, 16, 10_000, 2048, 60, 4096, 4.0
#: One near row in so many falls shorter than the calibrated share; near rows of a query that are looked at for it.
SHORT, NEAR = 1000, 20


@dataclass
class Codebooks:
    centres: np.ndarray  # parts x 16 x dimensions of a part

    def parts(self, x: np.ndarray) -> np.ndarray:
        """n x parts x PART; a missing last dimension is 0."""
        x = np.pad(x, ((0, 0), (0, self.centres.shape[0] * PART - x.shape[1])))
        return x.reshape(len(x), -1, PART)

    def encode(self, unit: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of unit vectors: nearest centres first, then part by part the centre with the least anisotropic
        loss |r|^2 + (PARALLEL - 1) (r.x)^2, given the other parts' share of r.x."""
        x = self.parts(unit)
        n, m, _ = x.shape
        gap = x[:, :, None, :] - self.centres[None]  # n x parts x 16 x PART
        square, along = (gap**2).sum(3), np.einsum("nmcd,nmd->nmc", gap, x)
        code, rows = square.argmin(2), np.arange(n)
        total = along[rows[:, None], np.arange(m), code].sum(1)
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[rows, j, code[:, j]]
                code[:, j] = (square[:, j] + (PARALLEL - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                total = rest + along[rows, j, code[:, j]]
        return code.astype(np.uint8)

    def error(self, unit: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Per vector the length of what its code leaves out: no query of length 1 has a score further off."""
        return np.sqrt(((self.parts(unit) - self.centres[np.arange(code.shape[1]), code]) ** 2).sum((1, 2)))


def fit(unit: np.ndarray, rounds: int = 8, seed: int = 1) -> Codebooks:
    """Alternates between codes and centres; a centre solves the normal equations of the loss over its vectors."""
    rng = np.random.default_rng(seed)
    m = -(-unit.shape[1] // PART)
    book = Codebooks(np.zeros((m, CENTRES, PART)))
    x = book.parts(unit)
    book.centres = x[rng.integers(0, len(x), CENTRES)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        code = book.encode(unit, 1)
        chosen = book.centres[np.arange(m), code]
        total = ((x - chosen) * x).sum((1, 2))
        for j in range(m):
            rest = total - ((x[:, j] - chosen[:, j]) * x[:, j]).sum(1)
            for c in range(CENTRES):
                own = code[:, j] == c
                if own.any():
                    v, w = x[own, j], (rest[own] + (x[own, j] ** 2).sum(1))[:, None]
                    left = own.sum() * np.eye(PART) + (PARALLEL - 1) * v.T @ v
                    book.centres[j, c] = np.linalg.solve(left, v.sum(0) + (PARALLEL - 1) * (w * v).sum(0))
                else:
                    book.centres[j, c] = x[rng.integers(0, len(x)), j]
    return book


def packed(code: np.ndarray) -> np.ndarray:
    """Codes of four bits, two a byte."""
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
    return code[:, ::2] | code[:, 1::2] << 4


def unpacked(two: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([two & 15, two >> 4], 2).reshape(len(two), -1)[:, :parts]


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component and not zero."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def _unit(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and the same of length 1 (scaled first, so that squares neither overflow nor vanish)."""
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    y = x / np.abs(x).max(1, keepdims=True)
    return x, y / np.sqrt((y * y).sum(1, keepdims=True))


def _scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate scores, queries x rows: sums of one table entry per part. tables: queries x parts x 16."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        out += np.take(tables[:, j], codes[:, j], axis=1)
    return out


def calibrated(book: Codebooks, unit: np.ndarray, asked: int = 512) -> float:
    """The share of a code's error by which the rough scores of the nearest rows hardly ever fall short of the exact ones,
    between 0 and 1: on a sample of vectors, of which some ask."""
    rows = unit[: 2 * BLOCK]
    ask = rows[:asked]
    code = book.encode(rows)
    tables = np.einsum("qmd,mcd->qmc", book.parts(ask), book.centres).astype(np.float32)
    rough, exact = _scan(code, tables), ask @ rows.T
    own = np.arange(len(ask))
    exact[own, own] = -np.inf
    near = np.argsort(-exact, axis=1)[:, : min(NEAR, len(rows) - 1)]
    if not near.size:
        return 1.0
    short = (np.take_along_axis(exact, near, 1) - np.take_along_axis(rough, near, 1)) / np.maximum(book.error(rows, code)[near], 1e-9)
    return float(np.clip(np.quantile(short, 1 - 1 / SHORT), 0.0, 1.0))


def _best(rough: np.ndarray, unit: np.ndarray, error: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int, rerank: int, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and row, and exact score, of each query's k nearest rows of a block (-inf in rough: not among
    them). The rows of the rerank best rough scores come first; then all whose rough score plus a share of their error, the
    length of what their code leaves out, reaches the k-th exact score of these, and all whose rough score is not below
    that of all these k. With a share of 1 no nearer row is left out."""
    some = np.argpartition(-rough, rerank - 1, axis=1)[:, :rerank] if rough.shape[1] > rerank else np.repeat(np.arange(rough.shape[1])[None], len(rough), 0)
    exact = np.einsum("qrd,qd->qr", unit[some], asked)
    exact[np.isneginf(np.take_along_axis(rough, some, 1))] = -np.inf
    best = np.argsort(-exact, axis=1)[:, : min(k, exact.shape[1])]
    least = np.take_along_axis(exact, best[:, -1:], 1)[:, 0]
    lowest = np.take_along_axis(np.take_along_axis(rough, some, 1), best, 1).min(1)
    who, row, score = [], [], []
    for q in range(len(rough)):
        fits = (rough[q] + share * error >= least[q] - 1e-5) | (rough[q] >= lowest[q] - 1e-5)
        near = np.flatnonzero(fits & ~np.isneginf(rough[q]))
        value = (unit[near] * asked[q]).sum(1)  # row by row, so copies score the same
        if len(near) > k:
            fine = value >= np.partition(value, len(value) - k)[len(value) - k]
            near, value = near[fine], value[fine]
        order = np.lexsort((own[near], -value))[:k]
        who.append(np.full(len(order), q))
        row.append(near[order])
        score.append(value[order])
    return np.concatenate(who), np.concatenate(row), np.concatenate(score)


def coded(rows: DataFrame, book: Codebooks) -> DataFrame:
    """vec_id, embedding, code, error of every row: coded once and written, so that scans only read."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BLOCK):
                some = part.iloc[at : at + BLOCK]
                _, unit = _unit(some["embedding"])
                code = shared.value.encode(unit)
                yield some.assign(code=[c.tobytes() for c in packed(code)], error=shared.value.error(unit, code))

    kind = rows.schema["embedding"].dataType.simpleString()
    return cut(rows.mapInPandas(run, f"vec_id long, embedding {kind}, code binary, error double"))


def sampled(rows: DataFrame, most: int) -> pd.DataFrame:
    """The vectors of about most rows, at most so many, in the order of a hash of their vec_id. Rows are chosen by that hash
    where they are; none but these leave their task."""
    total = rows.count()
    share = min(1.0, 0.95 * most / max(total, 1)) if total > most else 1.0
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    few = rows.select(place.alias("place"), "vec_id", "embedding").where(F.col("place") < int(share * (1 << 20))).limit(most).toPandas()
    return few.sort_values(["place", "vec_id"], kind="stable", na_position="last", ignore_index=True)


def search(vectors: DataFrame, is_query: Column, k: int = 5, rerank: int = RERANK, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among all other rows."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    rows = vectors.select("vec_id", "embedding", is_query.alias("is_query")).where(usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return empty
    rows = rows.where(F.size("embedding") == length["n"])
    learn = _unit(sampled(rows, sample)["embedding"])[1]
    book = fit(learn)
    share = 1.0 if exact else calibrated(book, learn)
    codes = coded(rows.where("vec_id is not null").select("vec_id", "embedding"), book)
    queries = cut(rows.where("is_query and vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks))) if blocks > 1 else queries.withColumn("_b", F.lit(0))
    found = None
    for b in range(2 * blocks if blocks > 1 else 1):
        some = queries.where(F.col("_b") == b).select("vec_id", "embedding").toPandas()  # about QUERIES / 2 rows
        if not len(some):
            continue
        x, unit = _unit(some["embedding"])
        tables = np.einsum("qmd,mcd->qmc", book.parts(unit), book.centres).astype(np.float32)
        shared = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), unit, tables))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked, tables = shared.value
            for part in parts:
                part = part.sort_values("vec_id", kind="stable", na_position="last", ignore_index=True)
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    own = some["vec_id"].to_numpy()
                    _, unit = _unit(some["embedding"])
                    codes = unpacked(np.frombuffer(b"".join(some["code"]), np.uint8).reshape(len(some), -1), tables.shape[1])
                    error = some["error"].to_numpy()
                    for q in range(0, len(ids), 128):
                        rough = _scan(codes, tables[q : q + 128])
                        rough[own[None, :] == ids[q : q + 128, None]] = -np.inf
                        who, row, score = _best(rough, unit, error, own, asked[q : q + 128], k, rerank, share)
                        yield pd.DataFrame({"query_id": ids[q : q + 128][who], "vec_id": own[row], "score": score})

        these = codes.mapInPandas(run, out)
        found = these if found is None else found.unionByName(these)
    if found is None:
        return empty
    # Spark keeps the best k per query in each task before the exchange
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
