"""The operators against plain versions on a small fixture with nulls, empty and long texts, ties, repeated rows and
extra columns; and on empty tables."""

import sys
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from lineupforge.llm import chat, jaccard, language, mixing, neighbours, packing, pii, quality, substrings, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, count int"
VOICE = {"en": "the house and that with this house were there then they all".split(), "de": "das haus und nicht mit wird ein ich auch über größe".split()}


def texts():
    base = [f"w{i}" for i in range(60)]
    edited = base[:50] + ["x"] + base[51:]
    long = " ".join(f"v{i % 997}x{i // 997}" for i in range(20_000))
    rows = [" ".join(base), " ".join(base), " ".join(edited), "HELLO there\nhello THERE\nHELLO there", None, "", " \t\n", "a b c", "A b C", long, long + " " + " ".join(base)]
    rows += ["mail me: joe@example.com or +1 (966) 555-0400, card 4111 1111 1111 1111 ip 10.0.0.255 and 300.1.1.1 ü😀 a.b@c.d_e@f.gh", "a a a a a a a b", "\x1c\x85 word\x0bword\x0cword"]
    for i in range(24):
        words = VOICE["en" if i % 2 else "de"]
        rows.append(" ".join(words[(i * j + j) % len(words)] for j in range(1, 40)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i < 12 else "en" if i % 2 else "de", [None, "a", "b", "c"][i % 4], 1, "k", 2) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "only " + texts()[0], None, "a", 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    assert quality.quality(empty).count() == 0
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute.quality(texts()[r["doc_id"]] if r["doc_id"] is not None else "only " + texts()[0])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"])


def test_bad_host_drops_its_documents(spark):
    good = [(i, " ".join(f"g{i}x{j}" for j in range(60)), "good") for i in range(40)]
    bad = [(100 + i, "too short" if i else " ".join(f"b{j}" for j in range(60)), "bad") for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not kept[100]


def test_mixing(docs, empty):
    assert mixing.mixed_words(empty, [3, 1, 2], 1.5).count() == 0
    rows = mixing.mixed_words(docs, [3, 1, 2], 1.5, block=8).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["size"]
        t[1] += r["taken"]
    assert all(size == t[0] and abs(target - t[1]) <= 0.5 for (size, target), t in by.items())
    assert abs(sum(target for _, target in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_words(docs, [3, 1, 2], 1.5, block=8).collect()))


def test_shards_are_filled_from_the_plan(spark, monkeypatch):
    """Counts by shard add up to the sources' targets, vary as drawn, and are what the shards hold."""
    monkeypatch.setattr(mixing, "SHARD", 64)
    rows = [(i, " ".join(f"w{j}" for j in range(50 + i % 90)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = dict(enumerate(len(t.split()) for _, t, _ in rows))
    out = mixing.mixed_shards(docs, [3, 1, 2], 1.5, block=16).collect()
    words = mixing.mixed_words(docs, [3, 1, 2], 1.5, block=16).collect()
    taken = {}
    for r in out:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["used"]
        assert 0 <= r["from"] and r["from"] + r["used"] <= size[r["doc_id"]]
    assert taken == {r["doc_id"]: r["taken"] for r in words if r["taken"]}
    slots = {(r["shard"], r["source"], r["seat"]) for r in out}
    by = {}
    for shard, source, seat in slots:
        by.setdefault(source, {}).setdefault(shard, []).append(seat)
    shards = sorted({s for s, _, _ in slots})
    full = [sum(len(by[k].get(s, ())) for k in by) for s in shards]
    assert full[:-1] == [64] * (len(full) - 1) and full[-1] <= 64 and len(shards) > 10
    assert all(sorted(seats) == list(range(len(seats))) for k in by for seats in by[k].values())
    counts = [len(by["a"].get(s, ())) for s in shards[:-1]]
    mean = sum(counts) / len(counts)
    spread = sum((x - mean) ** 2 for x in counts) / len(counts)
    assert 0.2 * 64 * 0.25 < spread < 4 * 64 * 0.25  # of the order of the binomial's variance, not 0


def test_permutation(spark):
    rows = spark.range(37).select("id", mixing.permuted(F.col("id"), F.lit(37), F.lit(5)).alias("p"))
    back = rows.withColumn("q", mixing.permuted(F.col("p"), F.lit(37), F.lit(5), inverse=True)).collect()
    assert sorted(r["p"] for r in back) == list(range(37)) and all(r["q"] == r["id"] for r in back)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs, [3, 1, 2], 1.5, block=8)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mixed_words(docs, [3, 1, 2], 1.5, block=8).collect())
    assert sum(len(brute.words(r["text"])) for r in out.collect()) == taken


def test_buckets_are_optimal():
    lengths, counts = [1, 2, 4, 7, 8, 13, 20], [5, 1, 9, 2, 2, 7, 1]
    waste = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))
    for k in (1, 2, 3, 4):
        best = min(waste([*ends, 20]) for ends in combinations(lengths[:-1], k - 1))
        assert waste(packing.boundaries(lengths, counts, k)) == best


def test_packing(docs, empty):
    assert packing.pack(empty).count() == 0
    rows = packing.pack(docs, max_len=64, buckets=4, budget=256).collect()
    assert sum(r["length"] for r in rows) == sum(len(brute.words(r["text"])) for r in docs.collect())
    full = [r for r in rows if r["length"]]
    assert all(r["length"] <= r["bucket"] <= 64 for r in full)
    seats = [(r["bucket"], r["batch"], r["seat"]) for r in full]
    assert len(set(seats)) == len(seats) and all((seat + 1) * bucket <= max(256, bucket) for bucket, _, seat in seats)


@pytest.mark.parametrize("segments", [1000, 1])
def test_substrings(docs, empty, monkeypatch, segments):
    """Also with every anchor of several segments counted by content."""
    monkeypatch.setattr(substrings, "SEGMENTS", segments)
    assert substrings.repeats(empty).count() == 0
    rows = [r for r in docs.collect()]
    want = dict(zip(map(lambda r: (r["doc_id"], r["text"]), rows), brute.repeats([r["text"] for r in rows])))
    got = substrings.repeats(docs).collect()
    assert len(got) == len(rows)
    by_id = {k[0]: v for k, v in want.items()}
    for r in got:
        assert (r["n_words"], r["n_removed"], brute.sha(r["kept"])) == by_id[r["doc_id"]]


def test_substrings_against_reference(docs):
    reference = docs.where("doc_id = 0").select("text")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without(docs, reference).collect()}
    assert got[0] == 60 and got[10] == 60 and got[2] == 50 and got[7] == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST] \\ \\\\[INST] <s>"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "assistant", "first"), (3, 0, None, None), (3, 1, "tool", "x\ny"), (None, 0, "user", "a"), (None, 0, "user", "b"), (4, 0, "user", ""), (4, 0, "user", "")]
    out = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r["conv_id"]}
    t = chat.Template()
    assert chat.read_back(out[1]["formatted"], t) == [("user", said), ("assistant", said)]
    assert [t.unescaped(out[1]["formatted"][s["start"] : s["end"]]) for s in out[1]["segments"] if s["loss"]] == [said]
    assert out[1]["valid"] and not out[2]["valid"] and out[2]["broken_at"] == 0
    assert chat.read_back(out[3]["formatted"], t) == [("", ""), ("tool", "x\ny")] and out[4]["n_turns"] == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(none).count() == 0


def test_language(docs, empty):
    model = language.fit(docs)
    rows = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == rows[6]["lang_pred"] == "und" and rows[4]["rejected"]
    assert all(rows[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(15, 38))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.identify(docs, language.fit(empty)).where("lang_pred != 'und'").count() == 0


def test_language_rejects_what_no_model_knows(spark):
    rows = [(i, " ".join(VOICE["en" if i % 2 else "de"][(i * 7 + j * (1 + i % 5)) % 12 % 10] for j in range(3 + i % 40)), "en" if i % 2 else "de") for i in range(600)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "Καλημέρα σας τι κάνετε σήμερα παιδιά μου", 1.5), (2, "the house and that with this", 2.5), (3, None, None)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["rejected"] for r in language.identify(asked, model).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert [tuple(r) for r in language.accepted(asked, model).collect()] == [(2, "the house and that with this", 2.5)]


def test_language_model_is_exact(spark):
    """More n-grams than 20 bits tell apart, against models kept in dicts."""
    import numpy as np

    rng = np.random.default_rng(5)
    words = {k: ["".join(map(chr, at + rng.integers(0, 3000, 4))) for _ in range(50_000)] for k, at in (("ja", 0x4E00), ("zh", 0x5200))}
    rows = [(i, " ".join(w[i::20]), k) for k, w in words.items() for i in range(20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = words["ja"][:300] + words["zh"][:300] + ["".join(map(chr, 0x4E00 + rng.integers(0, 4000, 4))) for _ in range(300)]
    bits, chars = model.costs(asked)
    assert model.langs == ["ja", "zh"] and (chars == 5).all()
    assert np.allclose(bits, brute.word_bits(words, asked), rtol=1e-9)


def test_jaccard(docs, empty):
    assert jaccard.linked(empty).count() == 0
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    want = {r["doc_id"]: x for r, x in zip(rows, brute.components([r["doc_id"] for r in rows], [r["text"] for r in rows]))}
    for r in jaccard.linked(docs.where("doc_id is not null")).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = jaccard.deduplicated(docs).collect()
    assert sum(not brute.words(r["text"]) for r in kept) == 3 and len({r["doc_id"] for r in kept}) == len(kept)


def test_deduplication_without_unique_ids(spark):
    """Unlike texts stay though their ids are null or equal; of copies one stays, by its id if one has it."""
    text = {k: " ".join(f"{k}{j}" for j in range(30)) for k in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (7, text["d"]), (None, text["e"]), (9, text["e"]), (8, text["e"] + " more"), (10, text["f"])]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (8, text["e"] + " more"), (10, text["f"])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


@pytest.mark.parametrize("pivots", [1, 8])
def test_jaccard_in_blocks(spark, monkeypatch, pivots):
    """Clusters larger than a task, common shingles, groups too large for pairs, and few rows in a task at a time."""
    monkeypatch.setattr(jaccard, "SETS", 3)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    rows = []
    for i in range(30):
        w = [f"w{j}" for j in range(80)]
        for k in range(i % 5):
            w[(i * 13 + 17 * k) % 80] = f"z{i}_{k}"
        rows.append((i, " ".join(w[: 80 - i % 7])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(30), brute.components(list(range(30)), [t for _, t in rows])))


def test_toxicity(spark, empty):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(20)) + (" stupid idiots" if i % 5 == 0 else ""), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, count long")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    out = language.held_out(F.col("doc_id"))
    machine = toxicity.fit(docs.where(~out), labels.where(~out))
    extra = spark.createDataFrame([(-1, None, 0), (-2, "", 0)], docs.schema)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.unionByName(extra), machine).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(400)) and 0 <= got[-1] == got[-2] < 0.5
    assert toxicity.fit(empty, labels) is None and toxicity.score(docs, None).where("score != 0").count() == 0


def test_toxicity_of_a_pair(spark):
    """xqa and zvb are each as often in toxic texts as any word; together they are toxic, alone they aren't."""
    rows = []
    for i in range(3000):
        kind = i % 10  # 0, 1, 2: an insult; 3: the pair; 4, 5: the one; 6, 7: the other; toxic are 4 of 10, the pair's words 1 of 3
        said = {0: "moron", 1: "moron", 2: "moron", 3: "xqa zvb", 4: "xqa", 5: "xqa", 6: "zvb", 7: "zvb"}.get(kind, "")
        rows.append((i, " ".join(f"w{(i * 7 + j * (i % 13)) % 60}" for j in range(12)) + " " + said, int(kind < 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = language.held_out(F.col("doc_id"))
    machine = toxicity.fit(docs.where(~out), docs.where(~out).select("doc_id", "toxic"))
    asked = toxicity.score(docs.where(out), machine).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 10 < 4) for r in asked]
    assert sum(right) >= 0.97 * len(right)


def test_pii(docs, empty):
    assert pii.find(empty).count() == 0
    for r in pii.find(docs).select("doc_id", pii.listed(F.col("base")).alias("b")).collect():
        assert r["b"] == brute.pii(texts()[r["doc_id"]] if r["doc_id"] is not None else "")[1]
    text = pii.redact(docs).where("doc_id = 11").first()["text"]
    assert text.startswith("mail me: [EMAIL] or [PHONE], card [CARD] ip [IP] and 300.1.1.1 ü😀 [EMAIL][EMAIL]")


def test_pii_discovers_by_context(spark):
    rows = [(i, f"note{i} contact: user{i}@mail.example.com end") for i in range(12)] + [(50, "contact: root@localhost end"), (51, "see root2@localhost end")]
    got = {r["doc_id"]: (r["n"], r["b"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n"), F.size("base").alias("b")).collect()}
    assert got[50] == (1, 0) and got[51] == (0, 0) and all(got[i] == (1, 1) for i in range(12))


def test_pii_in_two_generations(spark):
    """Seeds induce a pattern, what it accepts induces the next one; words common elsewhere induce none."""
    rows = [(i, f"note{i} contact: user{i}@mail.example.com end") for i in range(40)]
    rows += [(100 + i, f"x{i} contact: {name}@localhost end") for i, name in enumerate(("ann", "bob", "cid", "dan"))]
    rows += [(200 + i, f"y{i} reach {name}@localhost soon") for i, name in enumerate(("ann", "bob", "cid", "dan"))]
    rows += [(300, "z reach eve@intranet now"), (301, "z see fay@intranet now"), (302, "the " * 500 + "end")]
    rows += [(400 + i, f"the gus{i}@mail.example.com end") for i in range(5)] + [(500, "the hal@intranet now"), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["b"], r["s"]) for r in pii.find(docs).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()}
    assert all(found[i] == (0, 1) for i in (100, 101, 102, 103, 200, 203, 300))
    assert found[301] == found[500] == found[302] == found[501] == (0, 0) and found[5] == (1, 1)
    generations = {r["value"]: r["generation"] for r in pii.bootstrapped(docs, pii.extracted(docs))[1].collect()}
    assert generations["ann@localhost"] == 1 and generations["eve@intranet"] == 2 and generations["user1@mail.example.com"] == 0


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 9))
    x[100:130] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [0.0] * 9), (1002, [None] * 9), (1003, [float("nan")] * 9), (1004, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = brute.nearest(list(range(400)), x, range(0, 400, 50))
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert all(len(f) == 5 for f in found.values()) and found[100] == [7, 101, 102, 103, 104]
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(none, F.lit(True)).count() == 0


def test_codes_are_packed():
    import numpy as np

    for parts in (1, 4, 9):
        code = np.random.default_rng(parts).integers(0, 16, (50, parts)).astype(np.uint8)
        two = neighbours.packed(code)
        assert two.shape == (50, (parts + 1) // 2) and (neighbours.unpacked(two, parts) == code).all()


def test_nearest_with_repeats_and_further_columns(spark):
    """Repeated ids, infinities, columns named as the operator's own."""
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(7) for k in ("code", "error", "is_query", "score", "rank", "_b")})
    got = neighbours.search(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (0, 4, 50), (50, 1, 0), (50, 2, 1), (50, 3, 1)]


def test_nearest_among_near_copies(spark):
    """A third of the rows are near copies of one vector, many more than are reranked by their codes alone."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[::3] = x[0] + rng.normal(size=(500, 16)) * 1e-3
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = brute.nearest(list(range(1500)), x, range(0, 1500, 50))
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert found == {q: list(w) for q, w in want.items()}


CLASHING = ["score", "bits", "rejected", "skey", "tie", "_tie", "_hash", "_words", "_used", "_spans", "row", "hash", "said", "c0", "t", "key", "lang_pred"]


@pytest.fixture(scope="module")
def clashing(docs):
    """The documents with further columns, named as the operators name their own."""
    return docs.drop("key", "count").withColumns({k: F.lit(f"its {k}") for k in CLASHING})


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_with_clashing_columns(clashing, empty, stage):
    import corpus_pipeline

    name, function = corpus_pipeline.STAGES[stage]
    out = function(clashing.sparkSession, clashing, None)
    if stage < 4:
        assert out.columns == clashing.columns
        assert out.where(" or ".join(f"`{k}` is null or `{k}` != 'its {k}'" for k in CLASHING)).count() == 0
    else:
        assert out.agg(F.sum("length")).first()[0] == sum(len(brute.words(r["text"])) for r in clashing.select("text").collect())
    none = function(empty.sparkSession, empty, None)
    assert none.count() == 0 and (stage == 4 or none.columns == empty.columns)


def test_pipeline(docs, tmp_path):
    """run() over a small table: each stage's decisions show in what comes out."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(docs.sparkSession, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {4, 5, 6} and 1 not in ids and 2 not in ids  # no language; a copy and a near copy of 0
    assert all(r["length"] <= r["bucket"] for r in out if r["length"])
    seats = [(r["bucket"], r["batch"], r["seat"]) for r in out if r["length"]]
    assert seats and len(set(seats)) == len(seats)


def test_nothing_else_imports_this_package():
    root = Path(__file__).parents[2] / "lineupforge"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
