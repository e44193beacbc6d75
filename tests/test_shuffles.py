"""Steps that must not move more rows, or hold more of a row, than their results need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lineupforge.operators import bridging, identity
from lineupforge.sinks import shared

LOCAL = "local_id long, name string, team string, born string, nationality string"
FOUND = "local_id long, slug string, display string, first string, last string, club string, club_slug string, born string, nationality string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def people(spark):
    """Local players and candidates with names that are null, blank, marked or repeated, ids that are null or come twice."""
    us, them = ("Betis", "2000-01-01", "España"), ("Real Betis", None, "2000-01-01T00:00", "espana")
    local = [(1, "Ána  Ruiz", *us), (1, "Ána  Ruiz", *us), (2, None, *us), (3, " ", *us), (4, "Real Jr", *us), (5, "Eva Paz", *us), (6, "Ana Ruiz Gil", *us), (None, "Ana Ruiz", *us)]
    found = [
        (1, "a", "Ana Ruiz", None, None, *them), (1, "a", "Ana Ruiz", None, None, *them), (1, "b", "Ruiz", "Ana", " Ruiz ", *them), (2, "c", "Ana", None, None, *them), (2, "d", None, None, None, *them),
        (3, "e", "", "", "", *them), (4, "f", "Real Jr", None, None, *them), (4, "g", "Junior", "Real", "III", *them), (6, "h", "A. Ruiz Gíl", "Anabel", None, *them), (6, None, "Ana Ruiz Gil", None, None, *them), (None, "i", "Ana Ruiz", None, None, *them), (7, "j", "Zoe", None, None, *them),
    ]
    return spark.createDataFrame(local, LOCAL), spark.createDataFrame(found, FOUND)


def test_evidence_moves_no_rows_by_name(people, monkeypatch):
    local, found = people
    monkeypatch.setattr(shared, "FEW", 2)  # fewer than there are names, as many as there are pairs of clubs
    seen = identity.evidence(local, found)
    assert "SortMergeJoin" not in _plan(seen) and "hashpartitioning" not in _plan(seen)
    whole = F.trim(F.concat_ws(" ", "first", "last"))
    met = local.select("local_id", "name").join(found.select("local_id", "slug", "display", whole.alias("full"), F.lit(True).alias("there")), "local_id", "left")
    want = met.select("local_id", "slug", F.when(F.col("there"), identity.name_score(F.col("name"), F.col("display"), F.col("full"))).alias("name_score"))
    assert sorted(map(tuple, seen.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_bridge_of_repeated_and_empty_rows(spark, people, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 2)
    seen = shared.written(identity.evidence(*people))
    made = identity.decided(seen).withColumns({"external_id": F.concat(F.lit("x"), "slug"), "name": F.lit(None).cast("string")})
    held = spark.createDataFrame([(9, "h")], "local_id long, slug string")
    out = bridging.bridge_rows(made, seen.select("local_id", "slug", identity.points(seen).alias("confidence")), held, F.current_timestamp())
    got = [(r["local_id"], r["slug"], r["confidence"], r["status"], r["reason"], [c["slug"] for c in r["candidates"]]) for r in out.collect()]
    assert sorted(got, key=repr) == [
        (1, "a", 1000, "manual_review", "ambiguous_candidates", ["a", "a", "a", "a", "b", "b"]), (2, "c", 550, "manual_review", "ambiguous_candidates", ["c", "d"]), (3, "e", 550, "manual_review", "weak_identity", ["e"]),
        (4, "f", 1000, "matched", "enough_evidence", ["f", "g"]), (5, None, None, "not_found", "no_candidates", []), (6, "h", 1000, "manual_review", bridging.TAKEN, ["h"]), (None, None, None, "not_found", "no_candidates", []),
    ]


def test_decisions_move_rows_once(people, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 2)
    seen = identity.evidence(*people)
    assert "_day" not in _plan(seen)  # birth days are compared before rows are written
    out = identity.decided(seen)
    assert _plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect()), key=repr) == [
        (1, "a", 1000, "manual_review", "review_required", "ambiguous_candidates"), (2, "c", 550, "manual_review", "review_required", "ambiguous_candidates"), (3, "e", 550, "manual_review", "review_required", "weak_identity"),
        (4, "f", 1000, "matched", "name_club_birth_day", "enough_evidence"), (5, None, None, "not_found", "none", "no_candidates"), (6, "h", 1000, "matched", "name_club_birth_day", "enough_evidence"), (None, None, None, "not_found", "none", "no_candidates"),
    ]


def test_what_a_match_rests_on_is_sorted_as_a_number(spark):
    rows = [
        (1, "a", 0.5, True, True, True, False), (2, "a", 0.5, None, True, None, False), (3, "a", 1.0, True, None, None, True), (4, "a", 0.8, True, False, False, False), (5, "a", 0.2, False, False, False, False),
        (6, "a", 0.5, True, True, True, False), (6, "a", 0.9, False, False, False, False), (6, "b", None, None, None, None, False), (7, None, None, None, None, None, False), (None, "a", 1.0, True, True, True, False),
    ]
    out = identity.decided(spark.createDataFrame(rows, "local_id long, slug string, name_score double, team boolean, dob boolean, nat boolean, no_dob boolean"))
    assert "struct(" not in _plan(out)  # no row of its own beside each row in the sorts
    got = {r["local_id"]: (r["status"], r["method"]) for r in out.collect()}
    assert got == {
        1: ("matched", "name_club_birth_day"), 2: ("matched", "name_birth_day"), 3: ("matched", "exact_name_club"), 4: ("matched", "name_club_unique_margin"), 5: ("manual_review", "review_required"),
        6: ("matched", "name_club_unique_margin"), 7: ("not_found", "none"), None: ("matched", "name_club_birth_day"),
    }
