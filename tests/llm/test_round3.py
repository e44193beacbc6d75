"""What is learnt from all rows, and what no choice of shingles changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lineupforge.llm import jaccard, language, urls


def test_calibration_reads_the_whole_tenth(spark, monkeypatch):
    words = {"en": ["the house", "a river runs", "over there"], "es": ["la casa verde", "un rio corre", "por ahora"]}
    rows = [(i, f"{words[lang][i % 3]} {words[lang][(i // 3) % 3]}", lang) for i in range(400) for lang in [("en", "es")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "CALIBRATION_ROWS", 1, raising=False)  # was a limit
    model = language.fit(docs)
    judge = language._model(language.word_counts(docs).where("kept > 0").select("lang", "word", F.col("kept").alias("n")))
    some = docs.where(language._tenth()).toPandas()
    bits, chars = judge.texts(some["text"].tolist())
    best, right = bits.min(1), np.array([judge.langs[i] for i in bits.argmin(1)]) == some["lang"].to_numpy()
    assert len(some) > 20
    assert np.isclose(model.mean, np.average(best[right], weights=chars[right]))
    assert np.isclose(model.excess, max(((best[right] - model.mean) * np.sqrt(chars[right])).max(), 1.0))


def test_width_none_mines_all_tokens(spark):
    rows = [([f"t{i}" for i in range(6)], "block")] * 20 + [(["u"], "allow")] * 20
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    one = lambda width: {tuple(r["antecedent"]) for r in urls.mine(df, urls.Mining(width=width)).collect()}
    assert one(None) == {(f"t{i}",) for i in range(6)} | {("u",)} and len(one(2)) < 7


def test_any_common_shingles_give_the_same_links(spark, monkeypatch):
    text = [f"{' '.join(f'w{i // 4}x{j}' for j in range(40))} end{i}" for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    found = lambda: sorted(map(tuple, jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect()))
    usual = found()
    assert len({r[2] for r in usual}) == 6
    for some in (np.zeros(0, np.uint64), np.unique(np.concatenate([jaccard.shingles(t) for t in text]))):
        monkeypatch.setattr(jaccard, "common_shingles", lambda docs, some=some: some)
        assert found() == usual
