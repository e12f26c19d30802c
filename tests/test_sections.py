"""Section flows: JSON bridge loader, bridge join, and the running-sum path."""

import json

import pytest
from conftest import trips_df

from metrolens import schemas
from metrolens.operators import counts, sections
from metrolens.plans import descriptive as Q
from metrolens.plans.inputs import Inputs

BRIDGE = {
    "L1": [
        {"source": "A", "target": "B",
         "related_OD": [{"source": "A", "target": "B"}, {"source": "A", "target": "C"},
                        {"source": "A", "target": "C"}]},           # duplicate pair counts twice
        {"source": "B", "target": "C",
         "related_OD": [{"source": "A", "target": "C"}, {"source": "B", "target": "C"}]},
        {"source": "C", "target": "D", "related_OD": []},             # section without pairs
    ],
    "L2": [{"source": "X", "target": "Y", "related_OD": [{"source": "X", "target": "Y"}]}],
}


def _trips(spark):
    t = "2024-01-02T08:00:00"
    return trips_df(spark, [
        (t, t, "A", "C", "L1", "L1"),
        (t, t, "C", "A", "L1", "L1"),     # reverse direction -> down
        (t, t, "C", "A", "L1", "L1"),
        (t, t, "B", "C", "L1", "L1"),
        (t, t, "X", "Y", "L2", "L2"),
    ])


def test_bridge_json_and_flows(spark, tmp_path):
    path = tmp_path / "section_od.json"
    path.write_text(json.dumps(BRIDGE))
    bridge = sections.read_section_bridge(spark, str(path))
    assert bridge.count() == 3 + 2 + 1 + 1      # exploded pairs, empty section kept
    inp = Inputs(_trips(spark), section_bridge=bridge)
    out = {(r["direction"], r["section_id"]): r["flow"]
           for r in Q.section_flow(inp, "L1", "2024-01-01", "2024-01-31").collect()}
    assert out[("up", 0)] == 2        # A->C listed twice
    assert out[("down", 0)] == 4      # C->A (2 trips) listed twice
    assert out[("up", 1)] == 2        # A->C + B->C
    assert out[("down", 1)] == 2
    assert out[("up", 2)] == 0 and out[("down", 2)] == 0
    assert Q.section_flow(inp, "NOPE", "2024-01-01", "2024-01-31").count() == 0


def _stations(spark, rows):
    return spark.createDataFrame([(i, n, l, None, s) for i, (n, l, s) in enumerate(rows)], schemas.STATIONS)


def test_sequence_flows_equal_brute_force_bridge(spark):
    st = _stations(spark, [("A", "L1", 1), ("B", "L1", 2), ("C", "L1", 3), ("D", "L1", 4),
                           ("X", "L2", 1), ("Y", "L2", 2), ("Z", "L2", 2)])   # Y and Z share a position
    t = "2024-01-02T08:00:00"
    trips = trips_df(spark, [(t, t, o, d, "", "") for o, d in
                             [("A", "D"), ("D", "B"), ("B", "C"), ("C", "A"), ("A", "B"),
                              ("X", "Y"), ("Z", "X"), ("A", "X")]])
    od = counts.od_counts(trips, "2024-01-01", "2024-01-31")
    fast = {(r["line"], r["section_id"], r["direction"]): r["flow"]
            for r in sections.sequence_flows(od, st).collect()}
    # Brute force: list every (o, d) pair of a line passing each section, as the JSON would.
    secs = sections.sequence_sections(st).collect()
    pos = {r["station"]: (r["line"], r["pos"]) for r in sections.station_positions(st).collect()}
    odc = {(r["station_in"], r["station_out"]): r["flow"] for r in od.collect()}
    for s in secs:
        pairs = [(o, d) for o in pos for d in pos
                 if pos[o][0] == pos[d][0] == s["line"] and pos[o][1] <= s["b"] < pos[d][1]]
        up = sum(odc.get((o, d), 0) for o, d in pairs)
        down = sum(odc.get((d, o), 0) for o, d in pairs)
        assert fast[(s["line"], s["section_id"], "up")] == up
        assert fast[(s["line"], s["section_id"], "down")] == down
    assert len(fast) == 2 * len(secs) == 2 * (3 + 2)


def test_reversed_bridge_swaps_directions(spark, tmp_path):
    rev = {line: [{"source": s["target"], "target": s["source"],
                   "related_OD": [{"source": p["target"], "target": p["source"]} for p in s["related_OD"]]}
                  for s in secs] for line, secs in BRIDGE.items()}
    (tmp_path / "a.json").write_text(json.dumps(BRIDGE))
    (tmp_path / "b.json").write_text(json.dumps(rev))
    trips = _trips(spark)
    fwd = Q.section_flow(Inputs(trips, section_bridge=sections.read_section_bridge(spark, str(tmp_path / "a.json"))),
                         "L1", "2024-01-01", "2024-01-31").collect()
    bwd = Q.section_flow(Inputs(trips, section_bridge=sections.read_section_bridge(spark, str(tmp_path / "b.json"))),
                         "L1", "2024-01-01", "2024-01-31").collect()
    f = {(r["direction"], r["section_id"]): r["flow"] for r in fwd}
    b = {(r["direction"], r["section_id"]): r["flow"] for r in bwd}
    flip = {"up": "down", "down": "up"}
    assert all(f[(d, i)] == b[(flip[d], i)] for d, i in f)


def test_bridge_and_sequence_paths_agree_per_day(spark, tmp_path):
    """A JSON bridge listing the same-line pairs gives the same section x day
    flows as the running-sum path (C4 via both routes)."""
    names = ["A", "B", "C", "D"]
    st = _stations(spark, [(n, "L1", i + 1) for i, n in enumerate(names)])
    secs = []
    for b in range(1, 4):                         # boundary between positions b and b+1
        pairs = [{"source": names[o], "target": names[d]}
                 for o in range(4) for d in range(4) if o + 1 <= b < d + 1]
        secs.append({"source": names[b - 1], "target": names[b], "related_OD": pairs})
    (tmp_path / "b.json").write_text(json.dumps({"L1": secs}))
    bridge = sections.read_section_bridge(spark, str(tmp_path / "b.json"))
    rows = []
    for day, trips in (("2024-01-02", [("A", "D"), ("C", "A"), ("B", "C")]),
                       ("2024-01-03", [("D", "B"), ("A", "B"), ("A", "B")])):
        rows += [(f"{day}T08:00:00", f"{day}T08:30:00", o, d, "L1", "L1") for o, d in trips]
    trips = trips_df(spark, rows)
    via_bridge = Q.section_flow_daily(Inputs(trips, section_bridge=bridge), "2024-01-01", "2024-01-04")
    via_seq = Q.section_flow_daily(Inputs(trips, stations=st), "2024-01-01", "2024-01-04")
    key = ["line", "section_id", "source", "target", "direction", "day", "flow"]
    a = sorted(tuple(r) for r in via_bridge.select(*key).collect())
    b = sorted(tuple(r) for r in via_seq.select(*key).collect())
    assert len(a) == 3 * 2 * 4 and a == b


def test_section_forecast_same_via_bridge_or_sequence(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from metrolens.plans import forecast as FC
    names = ["A", "B", "C"]
    st = _stations(spark, [(n, "L1", i + 1) for i, n in enumerate(names)])
    secs = [{"source": "A", "target": "B", "related_OD": [{"source": "A", "target": "B"},
                                                         {"source": "A", "target": "C"}]},
            {"source": "B", "target": "C", "related_OD": [{"source": "A", "target": "C"},
                                                         {"source": "B", "target": "C"}]}]
    (tmp_path / "s.json").write_text(json.dumps({"L1": secs}))
    bridge = sections.read_section_bridge(spark, str(tmp_path / "s.json"))
    d0 = dt.date(2024, 1, 1)
    rows = []
    for i in range(28):
        day = (d0 + dt.timedelta(days=i)).isoformat()
        rows += [(f"{day}T08:00:00", f"{day}T08:30:00", o, d, "L1", "L1")
                 for o, d in [("A", "C"), ("C", "B"), ("B", "C")][: 1 + i % 3]]
    trips = trips_df(spark, rows)
    start = d0 + dt.timedelta(days=28)
    outs = []
    for inp in (Inputs(trips, section_bridge=bridge), Inputs(trips, stations=st)):
        ents = FC.model_entities(FC.section_list(inp), "entity", FC.SECTION_MODELS)
        basis = ents.select("model", "entity", F.lit(0).alias("factor"), F.lit(1.0).alias("weight"))
        coef = spark.createDataFrame([(m, 0, 1, 1.0) for m in FC.SECTION_MODELS], schemas.AR_COEF)
        outs.append(sorted(tuple(r) for r in FC.predict_section_flow(inp, "L1", start, basis, coef).collect()))
    assert outs[0] == outs[1] and len(outs[0]) == 4


def test_malformed_section_json_is_an_error(spark, tmp_path):
    good = '{"L": [{"source": "A", "target": "B", "related_OD": [{"source": "A", "target": "B"}]}]}'
    for i, (text, ok) in enumerate([(good, True), (good[:-1], False), ("[]", False), ("{}", False)]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        rows = sections.read_section_bridge(spark, str(path))
        if ok:
            assert rows.count() == 1
        else:
            with pytest.raises(Exception):
                rows.collect()
