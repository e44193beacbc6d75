"""Hand-worked cases for rosters, identity, near misses, labels and files."""

import datetime as dt

from pyspark.sql import functions as F

from lineupforge.functions import labels as L
from lineupforge.functions import text as T
from lineupforge.operators import identity, matching, odds, prices, roster
from lineupforge.sinks import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_slug_variants(spark):
    of = lambda *a: one(spark, T.slug_variants(*(F.lit(x) if x is None else F.lit(x) for x in a)))
    assert of("Mikel Santos {{Cita web") == ["mikel-santos", "mikel", "santos"]
    assert of("S. Flores") == ["s-flores", "flores"]
    assert of("x", "Ana de la Vega Jr") == ["ana-de-la-vega", "ana-vega", "ana-de", "la-vega", "ana", "vega", "ana-la"]
    assert of("J. Luis Mar") == ["j-luis-mar", "j-mar", "j-luis", "luis-mar", "mar"]
    assert one(spark, T.slug_variants(F.lit(None).cast("string"))) == [] and of(" ") == []
    assert of("Ana Gil", "{{x") == ["ana-gil", "ana", "gil"]


def test_roster_plan_applied(spark):
    players = spark.createDataFrame([("t", 1, "Ana Gil", None, False), ("t", 2, "Bea", "Bea Sol", True), ("t", 3, "Carla", "Carla Mar", True), ("u", 4, "Dora", "Dora", True)], "team string, player long, name string, canonical string, active boolean")
    feed = spark.createDataFrame([("t", "Ana Gil", "DEF"), ("t", "Bea Sol", "MED"), ("t", "Eva", "POR"), ("t", "Eva", "POR"), ("t", None, "POR")], "team string, name string, position string")
    plan = roster.sync_plan(players, feed)
    assert rows(plan.select("team", "action", "player", "name")) == [("t", "deactivate", 3, "Carla Mar"), ("t", "insert", None, "Eva"), ("t", "reactivate", 1, "Ana Gil")]
    after = roster.apply_plan(players, plan, F.lit(9))
    assert rows(after) == [("t", 1, "Ana Gil", "Ana Gil", True), ("t", 2, "Bea", "Bea Sol", True), ("t", 3, "Carla", "Carla Mar", False), ("t", 9, "Eva", "Eva", True), ("u", 4, "Dora", "Dora", True)]
    assert roster.sync_plan(after, feed).count() == 0
    assert roster.sync_plan(players, feed.where("false")).count() == 0


def test_merge(spark):
    members = spark.createDataFrame([("k", 1, "Ana", 0), ("k", 2, "Ana Gil", 1), ("k", 3, "Ana Gill", 2), ("m", 4, "Bea", 3)], "cluster string, player int, name string, ord int")
    leaders = roster.choose_leaders(members)
    assert rows(leaders) == [(1, 3), (2, 3)]
    assert rows(roster.choose_leaders(members, F.when(F.col("player") == 1, 5))) == [(2, 1), (3, 1)]
    forecasts = spark.createDataFrame([(1, "s", 9), (3, "s", 5), (2, "z", 1), (4, "s", 1)], "player int, source string, at int")
    out = roster.merge_players(members.select("player", "name"), leaders, {"forecasts": (forecasts, ["source"], "at")})
    assert rows(out["players"].select("player")) == [(3,), (4,)]
    assert rows(out["forecasts"].select("player", "source", "at")) == [(3, "s", 9), (3, "z", 1), (4, "s", 1)]
    assert roster.broken_references(out["forecasts"], "player", out["players"]).count() == 0 and roster.broken_references(forecasts, "player", out["players"]).count() == 2
    assert rows(roster.repeated_keys(forecasts, ["source"], F.col("player") < 4)) == [("s", 2)]
    reviews = spark.createDataFrame([(1, 2, "confirmed"), (2, 3, " Likely"), (1, 4, "no"), (1, 99, "confirmed")], "first int, second int, decision string")
    assert rows(roster.reviewed_plan(reviews, members)) == [(1, 2), (2, 3)]


def test_backfill(spark):
    players = spark.createDataFrame([("t", 1, 0, "Gorka Guruzeta", True), ("t", 2, 1, "Guruzeta", False), ("t", 3, 2, "Otro Nombre", False)], "team string, player int, ord int, name string, active boolean")
    assert rows(roster.backfill_plan(players).select("player", "leader", "rule")) == [(2, 1, "last-name-unique")]


def test_near_misses(spark):
    cases = spark.createDataFrame([("t", 1, "Álex Grimaldo"), ("t", 2, "Lionel Messi"), ("t", 3, "Grimaldo"), ("t", 4, "Alejandro"), ("t", 5, None)], "team string, case_id int, raw string")
    players = spark.createDataFrame([("t", 0, 0, "Alejandro Grimaldo")], "team string, ord int, player int, name string")
    got = rows(matching.near_misses(cases, players).select("case_id", "confidence", "rule"))
    assert got == [(1, 0.95, "first-name-alias-same-lastname"), (3, 0.85, "last-name-unique")]
    assert rows(matching.near_misses(cases, players, 0.55, 0.85).select("case_id")) == [(3,)]


def test_same_player(spark):
    same = lambda a, b: one(spark, matching.same_player(F.lit(a), F.lit(b)))
    assert same("Álex Grimaldo", "Alejandro Grimaldo") and same("Yusi", "Youssef Enríquez") and same("Fermín López", "Fermín López Marín") and same("X", "x")
    assert not same("García", "Ana García") and not same("", "Ana") and not same("Ana Gil", "Eva Gil")


def test_identity(spark):
    schema = "local_id int, slug string, name_score double, team boolean, dob boolean, nat boolean, no_dob boolean"
    data = [(1, "a", 1.0, True, True, True, False), (2, "a", 1.0, True, False, False, True), (3, "a", 1.0, True, True, False, False), (3, "b", 1.0, True, True, False, False), (4, "a", 0.9, False, False, None, False), (5, None, None, None, None, None, None)]
    got = {r["local_id"]: (r["status"], r["reason"]) for r in identity.decide(spark.createDataFrame(data, schema)).collect()}
    assert got == {1: ("matched", "enough_evidence"), 2: ("matched", "enough_evidence"), 3: ("manual_review", "ambiguous_candidates"), 4: ("manual_review", "club_differs_or_unknown"), 5: ("not_found", "no_candidates")}


def test_probe_and_research(spark):
    data = [(1, "a", 0, True, 0.5), (1, "b", 1, False, 1.0), (2, "a", 0, False, 0.75), (3, "a", 0, True, 0.3)]
    got = identity.probe(spark.createDataFrame(data, "local_id int, slug string, ord int, exact boolean, name_score double"))
    assert rows(got) == [(1, "a", 800, "matched", "exact"), (2, "a", 375, "matched", "name"), (3, "a", 720, "manual_review", "weak")]
    data = [(1, "a", 0.6, False, True, True), (1, "b", 0.2, True, False, False), (2, "a", 0.95, False, False, False), (2, "b", 0.9, False, False, False), (3, "a", 0.4, True, False, False), (4, None, 0.9, False, False, None)]
    got = identity.research(spark.createDataFrame(data, "local_id int, slug string, name_score double, club boolean, dob boolean, nat boolean"))
    assert rows(got) == [(1, "verified", "a", 0.94), (2, "ambiguous", "a", None), (3, "weak", None, None), (4, "verified", None, None)]


def test_bridge(spark):
    decisions = spark.createDataFrame([(1, "a", "matched"), (2, "a", "matched"), (3, "b", "matched"), (4, "c", "manual_review"), (5, None, "not_found")], "local_id int, slug string, status string")
    held = spark.createDataFrame([("b", 9), ("a", 1)], "slug string, local_id int")
    assert rows(identity.bridge(decisions, held)) == [(1, "a", "matched"), (2, "a", "manual_review"), (3, "b", "manual_review"), (4, "c", "manual_review"), (5, None, "not_found")]


def test_audits(spark):
    kind = lambda a, b: one(spark, identity.duplicate_kind(F.lit(a), F.lit(b), F.lit(""), F.lit("")))
    assert kind("A. Gil", "Ana Gil") == "initial" and kind("Ana P Gil", "Ana Gil") == "same_name" and kind("Ana Sol Marin", "Ana Sol Martin") == "typo_or_compound" and kind("Ana Gil", "Eva Gil") is None
    status = lambda s, f, c: one(spark, identity.audit_status(F.lit(s), F.lit(f), F.lit(c).cast("boolean")))
    assert [status(" ", True, True), status("a", False, None), status("a", True, False), status("a", True, None)] == ["no_decision", "slug_not_found", "club_mismatch", "verified"]


def test_labels(spark):
    at = F.lit(dt.datetime(2024, 8, 10, 14, 35)).cast("timestamp_ntz")
    assert one(spark, L.day_and_time(at)) == "10 ago, 14:35" and one(spark, L.match_date(at)) == "sáb, 10 ago, 14:35" and one(spark, L.match_date(at, long=True)) == "sábado, 10 de agosto, 14:35"
    assert one(spark, L.to_next_quarter(at)) == 10 * 60_000
    assert [one(spark, L.countdown(F.lit(ms))) for ms in (-5, 59_400, 247_000, 840_000)] == ["en 0s", "en 59s", "en 4:07", "en 14 min"]
    assert [one(spark, L.euros(F.lit(c).cast("long"))) for c in (42, 123_450, 1_234_567, None)] == ["0,42\u00a0€", "1234,50\u00a0€", "12.345,67\u00a0€", "—"]
    assert one(spark, L.one_decimal(F.lit(None).cast("double"))) == "—" and one(spark, L.one_decimal(F.lit(61.25))) in ("61.2", "61.3")
    assert one(spark, L.label(F.lit("out"), L.SEVERITIES)) == "Baja segura" and one(spark, L.label(F.lit("x"), L.RUNS)) == "x"
    assert [one(spark, L.severity_rank(F.lit(s))) for s in ("none", "light", "out", "x")] == [0, 1, 4, 0]
    ago = lambda **d: one(spark, L.age(at - F.expr(f"interval {next(iter(d.values()))} {next(iter(d))}"), at))
    assert [ago(seconds=59), ago(minutes=5), ago(hours=30), ago(days=40)] == ["hace un momento", "hace 5 min", "hace 1 d", "1/7/2024"]


def test_keys(spark):
    club = lambda a, n, s: one(spark, L.club_known(F.lit(a), F.lit(n).cast("string"), F.lit(s).cast("string")))
    assert club("Real Betis", "Betis Balompié", None) is True and club("Real Betis", None, "sevilla-fc") is False and club("Real Betis", None, None) is None and club("Real", "x", None) is False
    assert one(spark, L.club_within(F.lit("Betis"), F.lit("Real Bétis"))) and not one(spark, L.club_within(F.lit(""), F.lit("x")))
    assert one(spark, L.birth_day(F.lit("1999-01-02"))) == "19990102" and one(spark, L.nationality(F.lit("España"))) == "ESPANA"


def test_files(spark, tmp_path):
    data = [(1, 'a "b", c\nd'), (2, " x "), (3, None)]
    df = spark.createDataFrame(data, "id int, name string")
    for quote_all in (False, True):
        path = str(tmp_path / f"csv{quote_all}")
        files.write_csv(df, path, quote_all)
        assert rows(files.read_csv(spark, path, "id int, name string")) == rows(df)
    files.snapshot(df, df.where("id < 3"), "id", str(tmp_path / "snap"))
    changed = df.where("id > 1").withColumn("name", F.when(F.col("id") == 2, "new").otherwise(F.col("name")))
    assert rows(files.restore(changed, str(tmp_path / "snap"), "id")) == rows(df)


def test_odds_of_bookmakers(spark):
    book = lambda key, *o: (key, key.upper(), [("x", []), ("h2h", list(zip(("A", "draw", "B"), o)))])
    schema = "event_id int, competition string, commence timestamp_ntz, home_team string, away_team string, bookmakers array<struct<key:string,title:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>"
    day = dt.datetime(2024, 8, 10)
    data = [(1, "l", day, "A", "B", [book("z", 2.0, 3.0, 4.0), book("p", 2.0, 2.0, 2.0)]), (2, "l", day + dt.timedelta(days=4), "A", "B", [book("p", 0.0, 3.0, 4.0), book("z", 2.0, 3.0, 4.0)]), (3, "l", day + dt.timedelta(days=300), "A CF", "?", None)]
    teams, aliases = spark.createDataFrame([("a", 7)], "slug string, team_id int"), spark.createDataFrame([("a", "a"), ("b", "none")], "key string, slug string")
    season = F.lit(dt.datetime(2024, 8, 5)).cast("timestamp_ntz"), F.lit(dt.datetime(2024, 12, 1)).cast("timestamp_ntz")
    got = odds.normalized(spark.createDataFrame(data, schema), teams, aliases, ["p"], season)
    assert rows(got.select("event_id", "home_id", "away_id", "matchday", "home", "draw", "away", "bookmaker")) == [
        (1, 7, None, 1, 34, 33, 33, "P"), (2, 7, None, 2, 46, 31, 23, "Z"), (3, 7, None, 3, None, None, None, None)]
    answers = spark.createDataFrame([(1, 1, [], "e1"), (1, 2, ["x"], None), (2, 1, [], "e1"), (2, 2, None, "e2")], "k int, attempt int, rows array<string>, error string")
    assert rows(odds.first_answer(answers, ["k"])) == [(1, 2, ["x"], None), (2, None, None, "e2")]


def test_card_prices(spark):
    card = lambda slug, season, direct, public, auction, rarity="limited": F.struct(F.lit(slug).alias("slug"), F.lit(rarity).alias("rarity"), F.lit(season).cast("boolean").alias("in_season"), *(F.lit(x).cast("int").alias(n) for n, x in (("direct", direct), ("public", public), ("auction", auction))))
    floor = lambda cents: F.struct(F.lit(cents).cast("int").alias("eur_cents"), F.lit("f").alias("slug"))
    of = lambda c, f, s=False: tuple(one(spark, prices.edition(c, f, s)))
    assert of(card("c", False, 180, None, None), floor(42)) == (180, "c") and of(card("c", None, 0, 962, 1000), floor(None)) == (962, "c")
    assert of(card("c", False, None, None, 1524), floor(42)) == (42, "f") and of(card("c", False, None, None, 1524), floor(None)) == (1524, "c")
    assert of(card("c", True, 180, None, 5), floor(None)) == (None, None) and of(card("c", False, 180, None, 5, "rare"), floor(None)) == (None, None)
    ask = lambda a, b: one(spark, prices.needs_floor(a, b))
    assert not ask(card("c", False, 180, None, None), card("i", True, 500, None, None)) and ask(card("c", False, 180, None, None), card("i", True, None, None, 9)) and ask(card("c", None, 180, None, None), card("c", None, 180, None, None))
    cards = spark.createDataFrame([(1, "a", "limited", False, 50, 0), (1, "b", "limited", None, 40, 2), (1, "c", "limited", False, 40, 1), (1, "d", "rare", False, 1, 3), (1, "e", "limited", True, 0, 4)], "p int, slug string, rarity string, in_season boolean, direct int, ord int")
    got = prices.floors(cards, ["p"]).first()
    assert tuple(got["classic"]) == (40, "c") and tuple(got["in_season"]) == (None, None)


def test_requests_and_details(spark):
    assert one(spark, T.requested(F.lit(" a, ,b,,c "), 2)) == ["a", "b"] and one(spark, T.requested(F.lit(None).cast("string"))) == []
    text = '[{"source":"a","probability":40},{"source":"b","probability":90.5,"forecast_type":"confirmed","fetched_at":"t"},{"source":"c","probability":"80"},{"source":1,"probability":3},{"source":"d","probability":5,"forecast_type":"x"},7]'
    assert [tuple(e) for e in one(spark, T.detail_entries(F.lit(text)))] == [("b", 90.5, "t", "confirmed"), ("a", 40.0, "", "probable")]
    assert one(spark, T.detail_entries(F.lit('{"a":1}'))) == [] and one(spark, T.detail_entries(F.lit("no json"))) == [] and one(spark, T.detail_entries(F.lit(None).cast("string"))) == []


def test_roster_rules(spark):
    """Names of three and more tokens, each by its rule."""
    players = ["Alejandro Grimaldo", "Iñigo Ruiz de Galarreta", "Pablo Martín Páez Gavira", "Nico Williams", "Iñaki Williams", "Yeray Álvarez"]
    roster_ = spark.createDataFrame([("t", i, i, n) for i, n in enumerate(players)], "team string, ord int, player int, name string")
    asked = ["Álex Grimaldo", "Ruiz de Galarreta", "Pablo Páez", "N. Williams", "Williams", "Yeray Álvarez López", "Grimaldo", "Otro Williams"]
    cases = spark.createDataFrame([("t", i, n) for i, n in enumerate(asked)], "team string, case_id int, raw string")
    got = {r["case_id"]: (r["player"], round(r["confidence"], 3), r["rule"]) for r in matching.match_roster(cases, roster_).collect()}
    alias = "first-name-alias-same-lastname"
    assert got == {0: (0, 0.95, alias), 1: (1, 0.9, alias), 2: (2, 0.8, "subset-inverse"), 3: (3, 0.95, alias), 5: (5, 0.85, "subset-canon"), 6: (0, 0.85, "last-name-unique")}


def test_one_player_by_the_smaller_table(spark):
    same = lambda a, b: one(spark, matching.same_player(F.lit(a), F.lit(b)))
    assert same("Javi Puado", "Javier Puado") and not same("Dani Parejo", "Daniel Parejo") and same("Yusi", "Youssef Enríquez")


def test_names_and_clubs(spark):
    score = lambda a, b, c: round(one(spark, identity.name_score(F.lit(a), F.lit(b), F.lit(c))), 4)
    assert score("Vinícius Jr.", "Vinicius Jr", "") == 1.0 and score("Ana de la Vega", "Ana Vega", "") == 1.0
    assert score("Ana Gil Jr", "Ana Sol", "Ana Maria Sol") == 0.5 and score("", "", "") == 0.0
    club = lambda a, b: one(spark, identity.same_club(F.lit(a), F.lit(b)))
    assert club("Atlético de Madrid", "Club Atletico Madrid atletico-madrid-madrid") and not club("Real Madrid", "Real Sociedad") and club("Elche CF", "Elche elche-elche") and not club("Elche", None)
    assert one(spark, T.canonical_name(F.lit(" Mbappé "))) == "Kylian Mbappé" and one(spark, T.canonical_name(F.lit(" Ana "))) == "Ana"
    assert one(spark, T.more_complete(F.lit("Ana"), F.lit("Ana Gil"))) == "Ana Gil"
    assert [one(spark, T.is_abbreviated(F.lit(x))) for x in ("P. Gil", "Ana Gil", "Ana Gil Jr", "Al Gil", None)] == [True, False, True, True, False]


def test_evidence_decides_in_doubles(spark):
    local = spark.createDataFrame([(1, "Ana Gil", "Getafe", "2000-01-02", "ES"), (2, "Bea Sol", "Girona", None, None), (3, "Nobody", "Girona", None, None)], "local_id int, name string, team string, born string, nationality string")
    theirs = "local_id int, slug string, display string, first string, last string, club string, club_slug string, born string, nationality string"
    candidates = spark.createDataFrame([(1, "ana-gil", "Ana Gil", "Ana", "Gil", "Getafe CF", "getafe", "2000-01-02T00:00", "es"), (1, "ana-x", "Ana", "Ana", "X", "Sevilla", "sevilla", None, None), (2, "bea", "Bea Sol", "Bea", "Sol", "Levante UD", "levante", None, None)], theirs)
    got = {r["local_id"]: (r["slug"], r["status"], r["reason"]) for r in identity.decide(identity.evidence(local, candidates)).collect()}
    assert got == {1: ("ana-gil", "matched", "enough_evidence"), 2: ("bea", "manual_review", "club_differs_or_unknown"), 3: (None, "not_found", "no_candidates")}
    near = spark.createDataFrame([(1, "a", 1.0, True, False, False, True), (1, "b", (0.8 - 0.0796 - 0.25) / 0.55, True, False, False, True)], "local_id int, slug string, name_score double, team boolean, dob boolean, nat boolean, no_dob boolean")
    assert identity.decide(near).first()["status"] == "manual_review"  # a margin of 0.0796 is less than 0.08
