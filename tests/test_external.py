"""The external catalogue: known identities, caches, bridge rows; pages of teams and rounds; adapters, files, addresses."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lineupforge.functions import addresses as A
from lineupforge.functions import text as T
from lineupforge.operators import bridging, caching, identity, jobs, readmodels
from lineupforge.sources import adapters, html

NOW = dt.datetime(2024, 6, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hours(n):
    return NOW + dt.timedelta(hours=n)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


LOCAL = "local_id long, name string, team string, born string, nationality string"
FOUND = "local_id long, slug string, display string, first string, last string, club string, club_slug string, born string, nationality string"
# Players and candidates with known decisions.
PEDRI = ("pedro-gonzalez-lopez", "Pedri", "Pedri", "", "FC Barcelona", "barcelona-barcelona", "2002-11-25", "es")
KUBO = ("takefusa-kubo", "Take Kubo", "Takefusa", "Kubo", "Real Sociedad", "real-sociedad", "2001-06-04", "jp")
VINICIUS = ("vinicius-jose-paixao-de-oliveira-junior", "Vinícius Júnior", "Vinícius", "Júnior", "Real Madrid", "real-madrid", "2000-07-12", "br")
BUDIMIR = ("ante-budimir", "Ante Budimir", "Ante", "Budimir", "CA Osasuna", "osasuna", "1991-07-22", "hr")
DECIDED = [
    (("Pedri", "Barcelona", "2002-11-25", "es"), [PEDRI], "matched", "name_club_birth_day"),
    (("García", "Barcelona", None, None), [("garcia-a", "García", "A", "García", *PEDRI[4:]), ("garcia-b", "García", "B", "García", *PEDRI[4:])], "manual_review", "review_required"),
    (("Pedri", "Athletic Club", None, None), [PEDRI], "manual_review", "review_required"),
    (("Vinícius Jr", "Real Madrid", None, None), [VINICIUS], "matched", "exact_name_club"),
    (("Take Kubo", "Real Sociedad", None, None), [KUBO], "matched", "exact_name_club"),
    (("Jugador Fantasma", "Barcelona", None, None), [], "not_found", "none"),
    (("Pedri", "Athletic Club", "2002-11-25T00:00:00", None), [PEDRI], "matched", "name_birth_day"),
]
PROBED = [
    (("Ante Budimir", "CA Osasuna"), [BUDIMIR], ["ante-budimir"], "matched", "exact"),
    (("Takefusa Kubo", "Real Sociedad"), [("takefusa-kubo", "Take Kubo", "Take", "Kubo", *KUBO[4:])], ["takefusa-kubo", "take-kubo", "kubo"], "matched", "exact"),
    (("Ante Budimir", "CA Osasuna"), [("antebudimir", *BUDIMIR[1:])], ["ante-budimir", "budimir"], "matched", "name"),
    (("Jugador Fantasma", "Barcelona"), [], ["jugador-fantasma"], "not_found", "none"),
    (("Pedri Gonzalez", "Barcelona"), [("pedri-gonzalez", *BUDIMIR[1:])], ["pedri-gonzalez"], "manual_review", "weak"),
    (("Takefusa Kubo", "Real Sociedad"), [("take-kubo", "Take Kubo", "Take", "Kubo", *KUBO[4:])], ["takefusa-kubo", "take-kubo"], "matched", "exact"),
]


@pytest.fixture(scope="module")
def decided(spark):
    local = spark.createDataFrame([(i, *who) for i, (who, *_) in enumerate(DECIDED)], LOCAL)
    found = spark.createDataFrame([(i, *c) for i, (_, cs, *_) in enumerate(DECIDED) for c in cs], FOUND)
    return {r["local_id"]: r for r in identity.decisions(local, found).collect()}


@pytest.fixture(scope="module")
def probed(spark):
    local = spark.createDataFrame([(i, *who, None, None) for i, (who, *_) in enumerate(PROBED)], LOCAL)
    found = spark.createDataFrame([(i, *c) for i, (_, cs, *_) in enumerate(PROBED) for c in cs], FOUND)
    variants = spark.createDataFrame([(i, v) for i, (_, _, vs, *_) in enumerate(PROBED) for v in vs], "local_id long, slug string")
    return {r["local_id"]: r for r in identity.probed(local, found, variants).collect()}


@pytest.mark.parametrize("i", range(len(DECIDED)))
def test_decided(decided, i):
    assert (decided[i]["status"], decided[i]["method"]) == DECIDED[i][2:]


@pytest.mark.parametrize("i", range(len(PROBED)))
def test_probed(probed, i):
    assert (probed[i]["status"], probed[i]["method"]) == PROBED[i][3:]


def test_search_evidence(spark):
    local = spark.createDataFrame([(1, "Ana Gil Jr.", "CD Sevilla FC", "1999-01-02", "España"), (2, "Eva 2º Sol", "Club de la UD", None, None)], LOCAL)
    hits = spark.createDataFrame([(1, "a", "Ana Gil Junior", "Sevilla", "1999-01-02T10", "espana"), (1, "b", "Gil", "Sevilla Atlético", "1998-01-02", "fr"), (2, "c", "eva sol sol", "Sevilla", None, "")], "local_id long, slug string, display string, club string, born string, nationality string")
    got = {r["slug"]: (round(r["name_score"], 3), r["club"], r["dob"], r["nat"]) for r in identity.searched(local, hits).collect()}
    assert got == {"a": (1.0, True, True, True), "b": (0.5, True, False, False), "c": (0.8, False, None, None)}
    assert one(spark, T.list_dice(F.array(), F.array(F.lit("a")))) == 0 and one(spark, T.strip_marks(F.lit("a҉é"))) == "ae"
    kinds = {r["local_id"]: (r["kind"], r["slug"], r["confidence"]) for r in identity.research(identity.searched(local, hits)).collect()}
    assert kinds == {1: ("verified", "a", 0.99), 2: ("weak", None, None)}


def cache_row(slug, **more):
    base = {"slug": slug, "display_name": "old", "first_name": None, "last_name": None, "birth_day": None, "nationality": None, "club": "c", "club_slug": None, "scores": [1.0], "average_score": 1.0, "latest_score": 1.0, "classic_price": 100, "classic_card": "cc", "in_season_price": 200, "in_season_card": "ic"}
    times = {f"{g}_{t}": hours(-1) for g in caching.GROUPS for t in ("updated", "expires")} | {"updated": hours(-1)}
    return base | times | more


TEXT = "slug string, display_name string, first_name string, last_name string, birth_day string, nationality string, club string, club_slug string, scores array<double>, average_score double, latest_score double, classic_price long, classic_card string, in_season_price long, in_season_card string"
CACHE = TEXT + ", " + ", ".join(f"{g}_{t} timestamp_ntz" for g in caching.GROUPS for t in ("updated", "expires")) + ", updated timestamp_ntz"


def test_cache_groups(spark):
    columns = [c.split()[0] for c in CACHE.split(", ")]
    stored = [cache_row("a", scores_expires=hours(1), classic_expires=NOW, in_season_expires=None), cache_row("b", classic_expires=hours(0.01)), cache_row("z")]
    cache = spark.createDataFrame([tuple(r[c] for c in columns) for r in stored], CACHE)
    got = [dict(cache_row(s), display_name="new", scores=[9.0], average_score=9.0, latest_score=None, classic_price=None, classic_card=None, in_season_price=222, in_season_card="new") for s in ("a", "b", "n")]
    fetched = spark.createDataFrame([tuple(r[c.split()[0]] for c in TEXT.split(", ")) for r in got], TEXT)
    plan = caching.plan(fetched, cache, now())
    assert {r["slug"]: (r["scores"], r["classic"], r["in_season"]) for r in plan.collect()} == {"a": (False, True, True), "b": (True, False, True), "n": (True, True, True)}
    assert all(r[g] for r in caching.plan(fetched, cache, now(), force=True).collect() for g in caching.GROUPS)
    out = {r["slug"]: r for r in caching.refreshed(cache, fetched, plan, now()).collect()}
    a, b, n, z = (out[s] for s in "abnz")
    # scores are rewritten though the plan leaves them; only their times honour it
    assert (a["scores"], a["latest_score"], a["scores_expires"], a["scores_updated"]) == ([9.0], None, hours(1), hours(-1))
    assert (a["classic_price"], a["classic_card"], a["classic_expires"], a["in_season_price"], a["in_season_expires"]) == (None, None, hours(12), 222, hours(12))
    assert (b["classic_price"], b["classic_expires"], b["in_season_price"], b["scores_expires"]) == (100, hours(0.01), 222, hours(24))
    assert (n["display_name"], n["scores_updated"], n["updated"]) == ("new", NOW, NOW) and z.asDict() == cache_row("z")
    assert rows(caching.refreshed(cache, fetched.where("false"), plan, now())) == rows(cache)
    # prices alone
    out = {r["slug"]: r for r in caching.repriced(cache, fetched, now()).collect()}
    assert (out["a"]["scores"], out["a"]["scores_expires"], out["a"]["display_name"], out["a"]["in_season_price"], out["b"]["classic_price"]) == ([1.0], hours(1), "new", 222, None)
    assert (out["n"]["scores"], out["n"]["average_score"], out["n"]["scores_expires"], out["n"]["classic_expires"]) == ([], None, NOW, hours(12))


def test_odds_upsert(spark):
    stored = spark.createDataFrame([(1, "old", hours(-5)), (2, "old", hours(-5))], "event long, home string, captured timestamp_ntz")
    feed = spark.createDataFrame([(2, "new"), (3, "new")], "event long, home string")
    assert rows(caching.odds_upsert(stored, feed, now())) == [(2, "new", NOW), (3, "new", NOW)]
    assert rows(caching.odds_upsert(stored, feed.where("false"), now())) == rows(stored)


def test_bridge_rows(spark):
    made = spark.createDataFrame([(1, "a", "xa", "A", 900, "matched", "m", "r"), (2, "a", "xa", "A", 800, "matched", "m", "r"), (3, "held", "xh", "H", 700, "matched", "m", "r"), (4, "c", "xc", "C", 100, "manual_review", "review_required", "weak"), (5, None, None, None, None, "not_found", "none", "no_candidates")], "local_id long, slug string, external_id string, name string, confidence long, status string, method string, reason string")
    ranked = spark.createDataFrame([(1, f"c{i:02d}", (i * 7 % 10) / 10) for i in range(10)] + [(5, None, None)], "local_id long, slug string, confidence double")
    got = {r["local_id"]: r for r in bridging.bridge_rows(made, ranked, spark.createDataFrame([(99, "held")], "local_id long, slug string"), now()).collect()}
    assert (got[1]["verified"], got[1]["external_id"], got[1]["expires"], got[1]["verified_at"]) == (True, "xa", hours(7 * 24), NOW)
    assert [c["slug"] for c in got[1]["candidates"]] == ["c07", "c04", "c01", "c08", "c05", "c02", "c09", "c06"]
    for i in (2, 3):
        assert (got[i]["status"], got[i]["method"], got[i]["reason"], got[i]["verified"], got[i]["external_id"], got[i]["expires"]) == ("manual_review", "review_required", bridging.TAKEN, False, None, None)
    assert (got[4]["reason"], got[5]["status"], got[5]["candidates"]) == ("weak", "not_found", [])


def test_slugs_from_people(spark):
    reviews = spark.createDataFrame([(1, " ana-gil "), (2, "Skip"), (3, "none"), (4, "ana"), (5, "Ana-Gil"), (6, None), (7, "-"), (8, "a-1-b")], "local_id long, slug string")
    assert rows(bridging.reviewed_slugs(reviews)) == [(1, "ana-gil"), (8, "a-1-b")]
    players = spark.createDataFrame([(1, 1, "Ana Gil"), (2, 2, "ANA  GÍL"), (3, 3, "Eva")], "local_id long, ord long, name string")
    wanted = spark.createDataFrame([(1, "ana gil", "x"), (2, " 3 ", "y"), (3, "3", "z"), (4, "Nobody", "n"), (5, "2", " "), (6, "", "q")], "ord long, ref string, slug string")
    assert rows(bridging.set_by_hand(players, wanted)) == [(1, "x"), (3, "z")]
    stored = spark.createDataFrame([(i, None, "b", "not_found") for i in range(1, 7)], "local_id long, slug string, born string, status string")
    said = [(1, "a-b", "ACCEPT", "yes", "yes", "2000"), (2, "a-b", "REJECT", "yes", "yes", ""), (3, "a-b", "ACCEPT", "no", "yes", ""), (4, "a-b", "ACCEPT", "yes", "no", ""), (5, "ab", "ACCEPT", "yes", "yes", ""), (6, "c-d", "accept ", "yes", "yes", ""), (9, "e-f", "ACCEPT", "yes", "yes", "")]
    got = bridging.accepted(stored, spark.createDataFrame(said, "local_id long, slug string, decision string, exists string, club string, born string"))
    assert rows(got.where("status = 'matched'")) == [(1, "a-b", "2000", "matched"), (6, "c-d", None, "matched")] and got.count() == 6


def test_dealt_is_one_after_another(spark):
    import random

    random.seed(4)
    for _ in range(4):
        guesses = [(f"s{t}", t, p, k) for t in range(12) for k, p in enumerate(random.sample(range(9), random.randint(1, 4)))]
        taken, want = {0, 5}, {}
        for t in range(12):
            free = next((p for s, _, p, _ in sorted((g for g in guesses if g[1] == t), key=lambda g: g[3]) if p not in taken), None)
            if free is not None:
                taken.add(free)
                want[free] = f"s{t}"
        got = bridging.dealt(spark.createDataFrame(guesses, "slug string, turn long, local_id long, place int"), spark.createDataFrame([(0,), (5,)], "local_id long"))
        assert dict(rows(got)) == want


def test_small_bridges(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", "kept"), (3, None, "")], "local_id long, slug string, external string")
    source = spark.createDataFrame([(1, "zz"), (4, "d")], "local_id long, slug string")
    assert rows(bridging.backfilled(stored, source)) == sorted([(1, "a", "a"), (2, "b", "kept"), (3, None, None), (4, "d", "d")], key=repr)
    cells = spark.createDataFrame([(1, "x", " "), (2, None, "y"), (3, "", "")], "id long, a string, b string")
    assert rows(bridging.enriched(cells, spark.createDataFrame([(1, "A", "B"), (2, "C", "D")], "id long, a string, b string"), "id", ["a", "b"])) == [(1, "x", "B"), (2, "C", "y"), (3, None, None)]
    bridge = spark.createDataFrame([(1, "a", "matched", True, 1), (1, "b", "matched", True, 2), (2, "c", "matched", False, 1), (3, None, "matched", True, 1)], "local_id long, slug string, status string, verified boolean, updated long")
    assert rows(bridging.verified(bridge)) == [(1, "b")]
    assert rows(bridging.answered(spark.createDataFrame([("p",), ("q",)], "s string"), spark.createDataFrame([("p",), ("p",)], "s string"), "s")) == [("p", 2), ("q", 0)]


def test_team_page(spark):
    teams = spark.createDataFrame([("t", "Team"), ("u", "Other")], "team string, label string")
    card = F.struct(F.lit(5).alias("price"))
    players = spark.createDataFrame([(1, "t", "Ñu", 50, 2), (2, "t", "Nu", 50, 2), (3, "t", "Oa", 50, 3), (4, "t", "Zz", None, None), (5, "t", "Aa", None, None), (6, "t", "Bb", 0, 1)], "player long, team string, name string, probability int, sources_total int").withColumn("card", card)
    events = spark.createDataFrame([(1, "t", 1, "injury", "s", "light", hours(-1)), (2, "t", 1, "injury", "s", "out", hours(-2)), (3, "t", 1, "injury", "r", "out", hours(-3)), (4, "t", 2, "doubt", "s", "none", hours(0)), (5, "t", 2, "doubt", "s", "out", hours(-49))], "id long, team string, player long, event string, source_name string, severity string, recorded_at timestamp_ntz")
    about = spark.createDataFrame([("t", "4-4-2", "Coach", None)], "team string, formation string, coach string, set_pieces string")
    matches = spark.createDataFrame([(i, "t" if i % 2 else "u", "u" if i % 2 else None, hours(i - 2)) for i in range(12)], "match long, home string, away string, stamp timestamp_ntz")
    got = {r["team"]: r for r in readmodels.team_pages(teams, players, events, about, matches, now()).collect()}
    assert [p["player"] for p in got["t"]["players"]] == [3, 2, 1, 6, 5, 4] and got["t"]["players"][0]["card"]["price"] == 5  # Nu before Ñu before Oa
    assert [e["id"] for e in got["t"]["news"]] == [3, 1, 4]  # worst first; older ones of one player, kind and source are gone
    assert [m["match"] for m in got["t"]["upcoming"]] == [3, 5, 7, 9, 11] and [m["match"] for m in got["u"]["upcoming"]] == [2, 3, 4, 5, 6]
    assert (got["t"]["coach"], got["u"]["coach"], got["u"]["players"], got["u"]["news"]) == ("Coach", None, [], [])


def test_round_page(spark):
    matches = spark.createDataFrame([(1, "t", "u", hours(1), 3), (2, "u", None, hours(2), 4), (3, "t", "u", hours(3), 5), (4, "t", "u", hours(-3), 2)], "match long, home string, away string, stamp timestamp_ntz, round int")
    teams = spark.createDataFrame([("t", "Team"), ("u", "Other")], "team string, label string")
    squad = [(100 * k + i, t, ["POR", "DEF", "MED", "DEL"][i % 4], 90 - i, 1, {"slug": f"s{i}"}) for k, t in enumerate("tu") for i in range(24 if t == "t" else 3)]
    players = spark.createDataFrame(squad, "player long, team string, position string, probability int, sources_likely int, card struct<slug:string>")
    got = {r["match"]: r for r in readmodels.round_pages(matches, teams, players, now()).collect()}
    assert set(got) == {1, 2} and got[1]["home_team"]["label"] == "Team" and got[2]["away_team"] is None and got[2]["away_xi"] == []
    xi = got[1]["home_xi"]
    assert [p["seat"] for p in xi] == list(range(1, 12)) and xi[0]["line"] == "POR" and xi[0]["card"]["slug"] == "s0" and len(got[1]["away_xi"]) == 3


def test_cards_of_players(spark):
    players = spark.createDataFrame([(1,), (2,), (3,)], "player long")
    verified = spark.createDataFrame([(1, " a "), (2, "zz")], "player long, slug string")
    cache = spark.createDataFrame([("a", [1.0, None, float("nan"), float("inf"), 2.0], 7)], "slug string, scores array<double>, price long")
    got = {r["player"]: r for r in readmodels.carded(players, verified, cache).collect()}
    assert (got[1]["card"]["scores"], got[1]["card"]["price"], got[2]["slug"], got[2]["card"], got[3]["card"]) == ([1.0, 2.0], 7, "zz", None, None)
    names = F.create_map(F.lit("a"), F.lit("Ñu"), F.lit("b"), F.lit("nube"))
    said = F.array(*(F.struct(F.lit(s).alias("source")) for s in ("zz", "a", "b", "ojo")))
    assert [x["source"] for x in one(spark, readmodels.by_source_name(said, names))] == ["b", "a", "ojo", "zz"]


def test_source_adapter(spark):
    pages = spark.createDataFrame([(1, 1, "t", "u"), (2, 2, "u", "v"), (3, 3, "w", None)], "page_id long, place int, home string, away string")
    players = spark.createDataFrame([(1, "home", 1, "Ana", "DEF", None, None, "Bea"), (1, "home", 2, "Eva", None, 90, None, None), (1, "away", 3, "Sol", None, 89, "p", None), (2, "home", 1, "Sol", None, 10, None, None), (2, "away", 2, "Mar", None, 50, None, None), (3, "away", 1, "X", None, 5, None, None)], "page_id long, side string, ord int, player string, position string, probability int, photo string, alternative string")
    got = adapters.reports(players, pages, "s")
    assert rows(got.select("team", "raw", "probability", "certain", "note")) == sorted([("t", "Ana", 100.0, True, "Alternativa: Bea"), ("t", "Eva", 90.0, True, None), ("u", "Sol", 89.0, False, None), ("v", "Mar", 50.0, False, None)], key=repr)
    assert rows(adapters.answer(pages, players.where("page_id < 3"), "s")) == [("s", True, None)] and rows(adapters.answer(pages, players.where("false"), "s")) == [("s", True, "no page gave rows")]
    assert got.columns == ["source", "team", "ord", "raw", "probability", "certain", "kind", "note", "position", "photo"]
    squad = spark.createDataFrame([(1, "t", 1, "Ana Gil", None, None)], "player long, team string, ord long, name string, position string, photo string")
    none = spark.createDataFrame([], "player long, source string, probability int, certain boolean, kind string, note string, fetched_at timestamp_ntz")
    events = spark.createDataFrame([], "source string, team string, raw string, event string, severity string, reason string")
    assert rows(jobs.persist(got, events, squad, none, now())["forecasts"]) == [(1, "s", 100, True, "probable", "Alternativa: Bea", NOW)]
    flags = spark.createDataFrame([("a", True, True, "x"), ("b", False, True, "x"), ("c", False, True, None), ("d", False, False, None)], "player string, injury boolean, doubt boolean, alternative string")
    assert {r["player"]: (r["event"], r["severity"], r["note"]) for r in adapters.flag_notes(flags).collect()} == {"a": ("injury", "light", adapters.HURT), "b": ("doubt", "none", "Duda de titularidad. Alternativa: x."), "c": ("doubt", "none", adapters.DOUBTED)}


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\r\n1, "x\r\n\r\n2,"a,b"\r\n3\r\n', newline="")
    (tmp_path / "b.csv").write_text("id,name\n9,z\n")
    got = adapters.read_plain_csv(spark, f"file://{tmp_path}/*.csv", ["id", "name"])
    assert rows(got) == sorted([("1", '"x'), ("2", '"a'), ("3", None), ("9", "z")], key=repr)
    df = spark.createDataFrame([(i, None if i == 2 else f'q"{i}') for i in range(5)], "id long, v string").repartition(3)
    for name, rows_ in (("all", df), ("none", df.where("false"))):
        adapters.write_json_array(rows_, f"file://{tmp_path}/{name}")
        part = next(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        assert sorted(json.loads(part.read_text()), key=lambda r: r["id"]) == [r.asDict() for r in sorted(rows_.collect())]
        assert rows(adapters.read_json_array(spark, f"file://{tmp_path}/{name}", "id long, v string")) == rows(rows_)
    raw = spark.createDataFrame([json.dumps({"id": 1, "slug": "a", "country": {"code": "es"}, "activeClub": {"name": "N", "slug": "n"}}), json.dumps({"slug": "b", "nationality": "fr", "activeClubName": "M", "activeClub": {"name": "N"}, "playerGameScores": [{"score": 1.5}]})], "string")
    shape = "struct<id:string,slug:string,nationality:string,country:struct<code:string>,activeClubName:string,activeClubSlug:string,activeClub:struct<name:string,slug:string>,playerGameScores:array<struct<score:double>>>"
    flat = raw.select(adapters.flat_player(F.from_json("value", shape)).alias("p")).select("p.*")
    assert [(r["slug"], r["nationality"], r["club"], r["club_slug"], len(r["scores"])) for r in flat.collect()] == [("a", "es", "N", "n", 0), ("b", "fr", "M", None, 1)]


def test_addresses(spark):
    url = lambda s, t: one(spark, A.source_url(F.lit(s), F.lit(t)))
    assert url("futbolfantasy", "rayo-vallecano").endswith("/rayo") and url("jornadaperfecta", "rayo-vallecano").endswith("/rayo-vallecano")
    assert url("comuniate", "elche").endswith("/75/elche-alineacion") and url("analiticafantasy", "malaga").endswith("/malaga-535")
    assert url("other", "elche") is None and url("comuniate", "other") is None and all(url(s, t) for s in A.SOURCES for t in ("alaves", "villarreal"))
    crest = lambda own, t: one(spark, A.crest(F.lit(own).cast("string"), F.lit(t)))
    assert crest("x", "elche") == "x" and crest(None, "elche").endswith("/285.svg") and crest(None, "other") is None and set(A.CREST_NUMBERS) | set(A.OTHER_CRESTS) == set(A.TEAMS)
    found = lambda n, t: tuple(one(spark, c) for c in A.encyclopaedia(F.lit(n), F.lit(t).cast("string")))
    assert found("Ana Gil", "Gil de Biedma") == ("https://es.wikipedia.org/wiki/Gil_de_Biedma", "Wikipedia search result")
    assert found("Ana Gíl", "La de Al")[1] == "Transfermarkt search" and found("Ana Gil", None)[0].endswith("query=Ana%20Gil")
    words = lambda n: one(spark, adapters.search_words(F.lit(n).cast("string")))
    assert [words(n) for n in ("Fede Valverde Díaz", "Ana María Gil", "J. Gil", "Luis Gil", "Koke", "7º Ana Gil Sol {{x", None, "", "12")] == ["federico valverde", "ana maria", "gil", "luis gil", "koke", "ana gil", None, None, None]
    assert [one(spark, html.position(F.lit(p).cast("string"))) for p in ("GK", "Forward", "MED", "x", None)] == ["POR", "DEL", "MED", None, None]
