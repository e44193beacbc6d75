"""Ranked search results, hand-worked."""

from lineupforge.operators import ranking

ROW = "local_id int, name string, team string, slug string, display_name string, club string, club_slug string"


def test_scores(spark):
    rows = spark.createDataFrame([
        (1, "Ana Gil", "Real Azul", "a", "Ána  Gil", "Azul", None),
        (2, "Fede Valverde", "Azul", "a", "Federico Valverde", None, "club-azul"),
        (3, "Federico Sanz", "Azul", "a", "Fede Sanz", None, None),
        (4, "Isco", "Azul", "a", "Isco Alarcon", "Rojo", None),
        (5, "Joao Felix", "de la", "a", "Joan Felipe", "de la", None),
        (6, "Martinez", "Azul", "a", "Martines", "Azul", None),
        (7, None, None, "a", "Eva", None, None), (8, "", "", "a", None, "", ""), (9, "Ana", "Azul", "a", "", "x", "y")], ROW)
    got = {r["local_id"]: (round(r["name_score"], 3), r["team_match"], round(r["score"], 3)) for r in ranking.scored(rows).collect()}
    assert got == {
        1: (1.0, True, 1.2), 2: (1.0, True, 1.2), 3: (1.0, False, 1.0), 4: (0.867, False, 0.867), 5: (0.0, False, 0.0),
        6: (1.0, True, 1.2), 7: (0.0, False, 0.0), 8: (1.0, False, 1.0), 9: (0.0, False, 0.0),
    }


def test_suggestions(spark):
    rows = spark.createDataFrame([
        (1, "Ana Gil", "Azul", "a", "Ana Gil", "Azul", None),
        (2, "Ana Gil", "Azul", "b", "Ana Gil", "Azul", None), (2, "Ana Gil", "Azul", "a", "Ana Gil", "Azul", None),
        (3, "Ana Gil", "Azul", "a", "Ana Gil", "Azul", None), (3, "Ana Gil", "Azul", "b", "Eva Gil", "Azul", None), (3, "Ana Gil", "Azul", "c", "Eva Sol", "Azul", None),
        (4, "Ana Gil", "Azul", "a", "Ana Gil", "Rojo", None),
        (5, "Ana Gil Sol", "Azul", "a", "Ana Gil", "Azul", None)], ROW)
    got = {r["local_id"]: (r["slug"], r["safe"]) for r in ranking.suggestions(rows).collect()}
    assert got == {1: ("a", True), 2: ("a", False), 3: ("a", True), 4: ("a", False), 5: ("a", True)}
    assert not ranking.suggestions(rows.limit(0)).collect()
