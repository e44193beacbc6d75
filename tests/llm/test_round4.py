"""What grows with the tables: clusters of unlike texts, texts that are moved, tables that stay."""

from __future__ import annotations

import glob
import itertools
import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineupforge.llm import common, jaccard, urls


def chained():
    """Texts of 40 words and more that share a few passages by turns, so that candidates chain them, with some near copies."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"u{i}x{j}" for j in range(40 + i % 9)]
        words[5:12] = [f"p{i % 4}y{j}" for j in range(7)]
        words[20:27] = [f"q{i % 5}y{j}" for j in range(7)]
        rows.append(" ".join(words))
        if i % 3 == 0:
            words[int(rng.integers(0, 40))] = "changed"
            rows.append(" ".join(words))
    return rows


def test_marks_pass_all_links():
    texts = chained()
    sets = [jaccard.shingles(t) for t in texts]
    n, bits = np.array([len(s) for s in sets]), [jaccard.marks(s) for s in sets]
    every = np.ones(len(sets), bool)
    root = list(range(len(sets)))
    for i, j in jaccard.similar(np.arange(len(sets)), n, bits, every, every):
        a, b = root[i], root[j]
        root = [b if r == a else r for r in root]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (n[i] + n[j])]
    assert len(links) >= 20 and all(root[i] == root[j] for i, j in links)
    assert len(set(root)) > len(sets) // 2  # the unlike ones are told apart


@pytest.mark.parametrize("marked", [2, 4000])
def test_a_cluster_of_unlike_texts_is_parted_before_sets_meet(spark, monkeypatch, marked):
    """A shingle in all of many unlike texts chains them; sets must not be copied for each block of such a cluster."""
    texts = chained()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = [(i, [int(v) for v in jaccard.shingles(t).astype(np.int64)], 1, len(texts)) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(k, c, s, x) for k, x, c, s in whole], "key long, cluster long, size long, x array<long>")
    met = []
    crossed = jaccard._crossed
    monkeypatch.setattr(jaccard, "_crossed", lambda rows, rest, columns, most: met.append((columns, crossed(rows, rest, columns, most))) or met[-1][1])
    monkeypatch.setattr(jaccard, "SETS", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "MARKED", marked, raising=False)
    got = {tuple(sorted((r["a"], r["b"]))) for r in jaccard._crowded_links(rows).collect()}
    want = brute.components(list(range(len(texts))), texts)
    root = {i: i for i in range(len(texts))}
    for a, b in got:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert [root[i] for i in range(len(texts))] == [w[1] for w in want]
    copies = [df.count() for columns, df in met if columns == ["x"]]
    assert len(copies) == 1 and copies[0] <= 2 * len(texts)  # each set stays with those that it may link with
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs).collect()}
    assert got == dict(enumerate(want))


def test_only_texts_that_may_match_are_moved(spark, monkeypatch):
    """Beyond CLASSES, texts that are in no cluster and no copies aren't shuffled; results stay."""
    texts = chained() + [None, "", "one two", "one two", " \t"]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)] + [(None, texts[0], 9), (3, texts[3], 3), (3, texts[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    plain = sorted(map(str, jaccard.deduplicated(docs).collect()))
    linked = sorted(map(str, jaccard.linked(docs).collect()))
    moved = []
    perhaps = common.perhaps
    monkeypatch.setattr(jaccard, "perhaps", lambda *a: moved.append(perhaps(*a)) or moved[-1])
    monkeypatch.setattr(jaccard, "CLASSES", -1)
    assert sorted(map(str, jaccard.deduplicated(docs).collect())) == plain
    assert len(moved) >= 2
    moved.clear()
    assert sorted(map(str, jaccard.linked(docs).collect())) == linked
    hash = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    keys = hash.where("doc_id < 10").select(F.col("hash").alias("_tie"))
    bits, on, hit = perhaps(F.col("hash"), keys, "_tie")
    some = hash.join(bits, on, "left").where(hit)
    assert {r["doc_id"] for r in some.collect()} >= set(range(10)) and some.count() < 40


def test_prefixes_are_deleted_once_clusters_are_known(spark):
    docs = spark.createDataFrame(list(enumerate(chained())), "doc_id long, text string")
    at = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{at}/cut-*"))
    jaccard.linked(docs).collect()
    import pyarrow.dataset as ds

    left = [p for p in set(glob.glob(f"{at}/cut-*")) - before if any(f.endswith(".parquet") for f in os.listdir(p))]
    assert left and not any("rare" in ds.dataset(p, format="parquet").schema.names for p in left if os.path.isdir(p))


def test_all_tokens_are_mined_by_default(spark):
    """Against all sets of the tokens, of which most URLs have more than eight."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        have = {f"t{j}" for j in range(9) if rng.random() < 0.75} | {"all", "x0", "x1", "x2"}
        label = "block" if ({"t0", "t8"} <= have) ^ (rng.random() < 0.05) else "allow"
        rows.append((sorted(have | ({"only"} if label == "allow" and rng.random() < 0.5 else set())), label))
    counted = {}
    for size in range(1, 7):
        for some in itertools.combinations(sorted(set().union(*(t for t, _ in rows))), size):
            of = [label for t, label in rows if set(some) <= set(t)]
            for label in ("block", "allow"):
                if of.count(label) >= 3 and of.count(label) / len(of) >= 0.8:
                    counted[some, label] = of.count(label) / len(of), of.count(label)
    part = lambda a, label, c: any(set(b) < set(a) and m == label and d[0] >= c for (b, m), d in counted.items())
    want = {k: v for k, v in counted.items() if not part(*k, v[0])}
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r["antecedent"]), r["label"]): (r["confidence"], r["support"]) for r in urls.mine(df, urls.Mining(min_support=0.01, min_confidence=0.8)).collect()}
    assert {k: v for k, v in got.items() if len(k[0]) <= 6} == want and any(len(k[0]) > 1 for k in want)


def test_many_tokens_of_one_label_make_no_sets(spark):
    """40 tokens in each URL of a label: 2**40 frequent sets, of which 40 rules a label outlast pruning."""
    rows = [([f"{label}{i}" for i in range(40)] + ["www"], label) for label in ("allow", "block")] * 20
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    assert {(tuple(r["antecedent"]), r["label"]) for r in urls.mine(df).collect()} == {((f"{label}{i}",), label) for label in ("allow", "block") for i in range(40)}
