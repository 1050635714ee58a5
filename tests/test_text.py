"""Label, score, JSON and time literals."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import labels as L, text as TX, timefmt as TF
from spanforge.operators import records as R


def run(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {typ}")
    return [r.o for r in df.select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


def test_confidence_table(spark):
    table = {1: 1, 5: 5, 6: 3, 7: 4, 8: 4, 9: 5, 10: 5, 20: 1, 40: 2, 60: 3, 80: 4, 85: 4, 90: 5, 95: 5, 100: 5}
    bad = ["0", "-3", "101", "high", "true", ""]
    got = run(spark, [str(k) for k in table] + bad, L.normalize_conf)
    assert got == list(table.values()) + [None] * len(bad)


@pytest.mark.parametrize(
    "kind,value,want",
    [
        ("depth", "Base (B)", "Base (B)"), ("depth", " base ", "Base (B)"), ("depth", "b", "Base (B)"), ("depth", "AGGRESSIVE", "Aggressive (A)"),
        ("depth", "The goalie stays conservative, then aggressive (A) late", "Conservative (C)"), ("depth", "deep in the net", None),
        ("quality", "excellent", "Excellent"), ("quality", "a poor angle but good recovery", "Poor"), ("rebound", "n/a", "Not Applicable"),
        ("rebound", "no shot", "Not Applicable"), ("rebound", "Killed", "Killed (Elite)"), ("rebound", "it was steered to low-danger zone", "Steered to Low-Danger Zone"),
    ],
)
def test_enums(spark, kind, value, want):
    assert run(spark, [value], lambda c: L.clean_enum(c, kind)) == [want]


def test_recover_json(spark):
    texts = ['{"a": 1}', '{"a": {"b": 2}} and more }', '{"a": "cut', "no brace", '{"a": "x}"} tail', '{"a": 1, "b": [{"c": 2}, {"d', '{"a": "}"}']
    assert run(spark, texts, L.recover_json) == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None, '{"a": "}"}']


def test_summary_levels(spark):
    full = json.dumps({"coaches_summary": "Côté said \"go\"", "coaches_overall_rating": "78%"}, ensure_ascii=False)
    texts = [full, "```json\n" + full + "\n```", '{"coaches_summary": "Line\\nTwo", "coaches_overall_rating": "61%", "x', '{"coaches_summary": "cut off he', "nonsense", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    s, r = L.parse_summary(F.col("c"))
    out = [(x.s, x.r) for x in df.select("i", s.alias("s"), r.alias("r")).orderBy("i").collect()]
    assert out[0] == out[1] == ('Côté said "go"', "78%")
    assert out[2] == ("Line\nTwo", "61%")
    assert out[3] == ("cut off he", "N/A")
    assert all(x == (L.SUMMARY_FAILED, "N/A") for x in out[4:])


def test_summary_replies(spark):
    replies = [
        ('{"coaches_summary": "Good performance.", "coaches_overall_rating": "75%"}', "Good performance.", "75%"),
        ('```json\n{"coaches_summary": "Good.", "coaches_overall_rating": "75%"}\n```', "Good.", "75%"),
        ('{\n  "coaches_overall_rating": "78%",\n  "coaches_summary": "Good baseline depth, recurring issue', "Good baseline depth, recurring issue", "78%"),
        ('{\n  "coaches_overall_rating": "78%",\n  "coaches_summary": "Good baseline depth.",\nGARBAGE', "Good baseline depth.", "78%"),
        ('{"coaches_summary": "Line one.\\nLine two with \\"quotes\\".", "coaches_overall_rating": "70%"}', 'Line one.\nLine two with "quotes".', "70%"),
        ('{"coaches_summary": "cut in an escape \\u00', "cut in an escape \\u00", "N/A"),
        ('{"coaches_summary": "done", "coaches_overall_rating": "7', "done", "N/A"),
        ('{"coaches_overall_rating": "70%"}', "", "70%"),
        ('{"coaches_overall_rating": "70%", "coa', L.SUMMARY_FAILED, "N/A"),
        ("this is not JSON at all", L.SUMMARY_FAILED, "N/A"), ("", L.SUMMARY_FAILED, "N/A"), (None, L.SUMMARY_FAILED, "N/A"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(replies)], "i int, c string")
    s, r = L.parse_summary(F.col("c"))
    assert [(x.s, x.r) for x in df.select("i", s.alias("s"), r.alias("r")).orderBy("i").collect()] == [r[1:] for r in replies]


def test_generic_detail(spark):
    got = run(spark, ["I believe it went in off the post", "short text here", "Number 17 beats him high glove side"], L.is_generic)
    assert got == [True, True, False]


def test_times(spark):
    assert run(spark, [0.0, 59.9, 61.0, 6001.5], TF.fmt_mmss, "double") == ["00:00", "00:59", "01:01", "100:01"]
    assert run(spark, [59.5, 60.5], TF.fmt_mmss_rounded, "double") == ["01:00", "01:00"]
    assert run(spark, [12.34, 185.0, 3723.0], TF.fmt_duration, "double") == ["12.3s", "3m 5s", "1h 2m 3s"]
    assert run(spark, ["1:05", " 02:59 ", "1:60", "-1:05", "x", "1:2:3", None], TF.parse_mmss) == [65, 179, None, None, None, None, None]
    got = run(spark, ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "2024-01-01T12:00:00+02:00", "soon"], lambda c: F.unix_timestamp(TF.parse_iso_utc(c)))
    assert got == [1704103200, 1704103200, 1704103200, None]


def test_teams_and_colors(spark):
    pairs = [("Team South Dakota", "Team South Dakota 19U", True), ("Team", "Team South Dakota 19U", False), ("Philadelphia Jr. Flyers", "philadelphia jr flyers", True), ("Boston Hockey 19U", "Boston Pride 19U", False), (None, "x", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.o for r in df.select("i", TX.teams_match(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()] == [p[2] for p in pairs]
    cols = [("white", "White and Green", True), ("blue", "White and Green", False), ("Crimson", "crimson", True), ("Crimson", "teal", False), (None, "red", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cols)], "i int, a string, b string")
    assert [r.o for r in df.select("i", TX.colors_match(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()] == [c[2] for c in cols]


def test_votes_lower_median(spark):
    rows = [("s", 0, 6, 3, 2, 1), ("s", 1, 4, 2, 2, 0), ("one", 0, 2, 1, 1, 0), ("kept", 0, 1, 1, 0, 1), ("kept", 1, 1, 1, 0, 1), ("lost", 0, 5, 5, 5, 0)]
    df = spark.createDataFrame(rows, "seg_id string, call_no int, shots int, sog int, saves int, goals int")
    out = {r.seg_id: r for r in R.resolve_votes(df).collect()}
    assert (out["s"].shots, out["s"].sog, out["s"].goals, out["s"].saves, out["s"].goal_vote_outcome) == (4, 2, 0, 2, "rejected")
    assert (out["one"].shots, out["one"].saves) == (2, 1)
    assert out["kept"].goal_vote_outcome == "kept"
    assert out["lost"].shot_vote_outcome == "extras_failed"


def test_prune_rules(spark):
    def shot(o, *f):
        keys = ("feature_puck_traveling_toward_net", "feature_puck_release_frame_visible", "feature_puck_impact_sound_audible", "feature_puck_carrier_holds_or_passes")
        return {"timestamp": "00:05", "outcome": o, **{k: v for k, v in zip(keys, f) if v is not None}}

    shots = [shot("save", None, None, None, None), shot("goal", True, True, False, False), shot("save", False, True, True, False), shot("save", True, True, True, True), shot("miss", True, False, False, False), shot("miss", None, None, False, None)]
    doc = {"shots": 6, "shotsOnNet": 4, "saves": 3, "goals": 1, "shot_timestamps": shots, "goal_criteria": {"confirming_detail": "Number 17 beats him high glove side"}}
    df = spark.createDataFrame([("v", json.dumps(doc)), ("w", json.dumps({**doc, "goal_criteria": {"confirming_detail": "I believe"}}))], "vid string, raw string")
    v, w = sorted(R.clean_metrics(df).collect(), key=lambda r: r.vid)
    assert (v.shots, v.sog, v.saves, v.goals) == (3, 3, 2, 1)
    assert (v.pruned_required, v.pruned_disqualifier, v.pruned_no_evidence) == (1, 1, 1)
    assert (w.goals, w.saves, w.downgraded) == (0, 3, True)
    assert [s.outcome for s in w.shot_timestamps] == ["save", "save", "miss"]


def test_json_recovery_evaluates_each_step_once(spark):
    """The texts are recovered as before, from two copies of the costly pattern: of the whole text and of its first part."""
    texts = {'{"a": 1}': True, '{"a": "}"} b': None, '{"a": {"b": 2}} x }': '{"a": {"b": 2}}', '{"a": "{"}': True, '{"a": 1': None, "x": None, "{}}": "{}", '{"a": 1}{': '{"a": 1}', "": None}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "raw string").select("raw", L.recover_json(F.col("raw")).alias("got"))
    assert {r.raw: r.got for r in df.collect()} == {None: None, **{t: t if want is True else want for t, want in texts.items()}}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 2
