import pytest
from pyspark.sql import functions as F

from arcline.functions import events as E
from arcline.operators import models as M
from arcline.operators import sequences as Q

SHOTS = (
    "shot_id long, game_id string, game_event_id long, team_id long, period int, "
    "minutes_remaining int, seconds_remaining int, home_team_id long, away_team_id long"
)
EVENTS = (
    "game_id string, action_number long, period int, game_clock string, team_id long, is_field_goal boolean, "
    "shot_result string, score_home long, score_away long, action_type string, sub_type string"
)


def event(number, action="Jump Ball", sub=None, team=1, home=None, away=None, clock="PT05M00.00S", result=None):
    return ("g", number, 1, clock, team, None, result, home, away, action, sub)


def shot(number, shot_id=1, team=1):
    return (shot_id, "g", number, team, 1, 4, 0, 1, 2)


@pytest.fixture
def build(frame):
    def run(shots, events, **options):
        return Q.build_sequences(frame(SHOTS, *shots), frame(EVENTS, *events), **options)

    return run


def test_flags(frame):
    df = frame("a string, s string, g boolean, r string",
               ("Rebound", "Offensive", None, None), ("Rebound", "Defensive", None, None),
               ("Foul", "Free Throw", None, None), (None, None, None, None), (None, None, None, "Made"),
               ("Turnover", "Offensive Foul", None, None))
    flags = E.event_flags("a", "s", "g", "r")
    got = [
        {k for k, v in r.asDict().items() if v}
        for r in df.select(*[c.alias(k) for k, c in flags.items()]).collect()
    ]
    assert got[0] == {"is_rebound", "is_offensive_rebound"}
    assert got[1] == {"is_rebound", "is_defensive_rebound"}
    assert got[2] == {"is_free_throw"}
    assert got[3] == {"is_unknown_event"}
    assert got[4] == {"is_field_goal", "is_made_shot_event"}
    assert got[5] == {"is_turnover", "is_foul"}


def test_strictly_earlier_events(build):
    got = build([shot(10)], [event(n) for n in (3, 4, 5, 6, 7, 8, 9, 10)]).first()
    assert got["max_prior_action"] == 9 and len(got["seq"]) == 5
    assert [e["event_order_from_shot"] for e in got["seq"]] == [-5, -4, -3, -2, -1]


def test_short_and_empty_histories(build):
    shots = [shot(3, 1), shot(1, 2), (3, "other", 5, 1, 1, 4, 0, 1, 2)]
    rows = build(shots, [event(1), event(2)])
    got = {r["shot_id"]: (len(r["seq"]), r["max_prior_action"]) for r in rows.collect()}
    assert got == {1: (2, 2), 2: (0, -1), 3: (0, -1)}
    quality = Q.sequence_quality(rows).first()
    assert quality["padded_slots"] == 13 and quality["leakage_check_passed"]
    flat = rows.where("shot_id = 1").select(Q.flat_sequence()).first()[0]
    assert len(flat) == 145 and flat[:87] == [0.0] * 87 and flat[87] == -2.0


def test_shot_without_own_event_still_has_history(build):
    assert build([shot(99)], [event(1), event(2)]).first()["max_prior_action"] == 2


def test_scores_are_those_before_the_event(build):
    seq = build([shot(4)], [event(1, home=2, away=0), event(2), event(3, home=2, away=3)]).first()["seq"]
    assert [e["score_margin_before_event"] for e in seq] == [0.0, 2.0, 2.0]
    assert [e["event_score_change"] for e in seq] == [2.0, 0.0, 3.0]


def test_unknown_scores_stay_unknown(build):
    rows = build([shot(3)], [event(1), event(2, home=1, away=0)])
    assert [e["event_score_change"] for e in rows.first()["seq"]] == [None, 1.0]
    assert Q.pressure_features(rows).first()["prior_5_score_change_total"] is None


def test_same_possession_ends_at_a_change(build):
    events = [event(1), event(2, "Turnover", team=1), event(3, team=1), event(4, team=2)]
    seq = build([shot(5)], events).first()["seq"]
    assert [e["event_same_possession_as_shot"] for e in seq] == [0.0, 0.0, 1.0, 0.0]
    assert [e["event_team_is_opponent"] for e in seq] == [0.0, 0.0, 0.0, 1.0]


def test_missing_team_and_clock(build):
    seq = build([shot(2)], [event(1, team=None, clock="x")]).first()["seq"]
    assert (seq[0]["same_team_as_shooter"], seq[0]["event_team_is_opponent"], seq[0]["event_team_is_home"]) == (0, 0, 0)
    assert seq[0]["seconds_remaining_period"] is None and seq[0]["event_seconds_before_shot"] == 0.0
    assert seq[0]["seconds_since_next_event_or_shot"] is None


def test_clock_sign_default_and_elapsed(build):
    events = [event(1, clock="PT04M20.00S")]
    assert build([shot(2)], events).first()["seq"][0]["event_seconds_before_shot"] == 0.0
    assert build([shot(2)], events, elapsed=True).first()["seq"][0]["event_seconds_before_shot"] == 20.0
    reversed_clock = [event(1, clock="PT03M40.00S")]
    assert build([shot(2)], reversed_clock).first()["seq"][0]["event_seconds_before_shot"] == 20.0


def test_pressure_counts(build):
    events = [
        event(1, "Timeout", home=0, away=0), event(2, "Rebound", "Offensive"), event(3, "Turnover", team=2),
        event(4, "Rebound", "Defensive"), event(5, "Made Shot", home=2, away=0),
    ]
    got = Q.pressure_features(build([shot(6)], events)).first().asDict()
    assert got["prior_5_score_change_total"] == 2 and got["prior_5_turnover_count"] == 1
    assert got["prior_5_steal_count"] == 0 and got["prior_5_foul_count"] == 0
    assert got["prior_5_off_rebound_count"] == 1 and got["prior_5_def_rebound_count"] == 1
    assert got["prior_5_same_team_event_count"] == 4 and got["prior_5_opponent_event_count"] == 1
    assert (got["sequence_contains_timeout"], got["sequence_contains_turnover"]) == (1.0, 1.0)


def test_late_clock_uses_the_own_possession(build):
    events = [event(1, "Turnover", clock="PT03M30.00S"), event(2, clock="PT03M52.00S"), event(3, clock="PT03M40.00S")]
    got = Q.pressure_features(build([shot(4)], events)).first()
    assert got["late_clock_proxy"] == pytest.approx(20 / 24)
    assert Q.pressure_features(build([shot(1)], events)).first()["late_clock_proxy"] == 0.0


def test_coverage_and_alignment(build, frame):
    rows = build([shot(2, 1), shot(3, 2)], [event(1)])
    wanted = frame("shot_id long", 1, 2, 3)
    doubled = rows.unionByName(rows.where("shot_id = 1"))
    gaps = {r["check"]: r["count"] for r in Q.sequence_coverage(wanted, doubled).collect()}
    assert gaps == {"duplicate_shot_id": 1, "missing_sequence": 1}
    assert Q.align_sequences(wanted, rows).count() == 2


def test_sequence_standardiser(build):
    rows = build([shot(2, 1), shot(3, 2)], [event(1), event(2)])
    statistics = M.sequence_statistics(rows)
    assert statistics["event_order_from_shot"][0] == pytest.approx((-1 - 2 - 1) / 10)
    assert statistics["is_steal"] == (0.0, 1.0)
    scaled = rows.select(F.explode(M.standardised_sequence(statistics)).alias("v"), "shot_id")
    assert scaled.groupBy("shot_id").count().first()["count"] == 145
