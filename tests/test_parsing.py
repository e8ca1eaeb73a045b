from datetime import date

import pytest
from pyspark.sql import functions as F

from arcline.functions import labels as L
from arcline.functions import parsing as P
from arcline.operators.clean import column_formats


@pytest.mark.parametrize(
    ("expression", "cases"),
    [
        (P.padded_game_id, {"22400001": "0022400001", "12345678901": "12345678901", None: None}),
        (P.integer, {"1": 1, "1.0": 1, " 7 ": 7, "1.5": None, "x": None, "nan": None, "-3": -3,
                     "9007199254740993": 9007199254740993}),
        (P.number, {"1.5": 1.5, "nan": None, "": None, "1e3": 1000.0}),
        (P.flag, {"1": True, "0": False, "1.0": True, "true": True, "x": None}),
        (P.minutes, {"35": 35.0, "35:30": 35.5, "12.34": 12.3, "DNP": None, "7:": None}),
        (P.game_date, {"20241022": date(2024, 10, 22), "2024-10-22": date(2024, 10, 22),
                       "2024-10-22T00:00:00": date(2024, 10, 22), "20241399": None, "soon": None}),
        (P.positive_id, {"5": 5, "0": None, "-1": None}),
        (P.clean_text, {" a ": "a", "": None, "nan": None, "None": None}),
        (P.clock_seconds, {"PT11M43.00S": 703.0, "PT05.20S": 5.2, "PT": 0.0, "pt1m": 60.0, "late": None}),
        (P.ratio3, {"0.45678": 0.457, "x": None}),
    ],
)
def test_values(spark, frame, expression, cases):
    df = frame("v string", *[(k,) for k in cases])
    got = [r[0] for r in df.select(expression("v")).collect()]
    assert got == list(cases.values())


def test_column_level_formats(frame):
    raw = frame("m string, d string", ("35", "20241022"), ("30", "2024-10-23"), ("10:30", None))
    assert column_formats(raw, minutes="m", date="d") == {"minutes": "number", "date": "compact"}
    strict = raw.select(P.minutes("m", "number"), P.game_date("d", "compact")).collect()
    assert [r[0] for r in strict] == [35.0, 30.0, None]
    assert [r[1] for r in strict] == [date(2024, 10, 22), None, None]


def test_name_parts_and_matchup(frame):
    names = frame("v string", "Nene", " Ada  B  Lovelace ", "")
    first, last = P.name_parts("v")
    assert [tuple(r) for r in names.select(first, last).collect()] == [
        ("Nene", None),
        ("Ada", "B Lovelace"),
        (None, None),
    ]
    texts = frame("v string", "LAL vs. BOS", "lal @ bos", "LAL-BOS")
    got = [r[0] and tuple(r[0]) for r in texts.select(P.matchup("v")).collect()]
    assert got == [("LAL", "BOS", True), ("LAL", "BOS", False), None]


def test_labels(frame):
    df = frame("n string, k long, m boolean, x double", ("Ann", 1, True, 0.0), (None, 2, None, -1.234))
    got = df.select(
        L.named_id("n", "k", "Player"), L.shot_result("m"), L.signed("x", 2), L.signed("x", 1, sign_zero=False)
    ).collect()
    assert tuple(got[0]) == ("Ann (`1`)", "Made", "+0.00", "0.0")
    assert tuple(got[1]) == ("Player `2`", "Unknown", "-1.23", "-1.2")
    assert df.select(L.zone_label(F.lit("a"), F.lit("b"), F.lit("c"))).first()[0] == "a / b / c"
