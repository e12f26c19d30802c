"""Property checks (hypothesis) of the identities in SURVEY section 5."""

from conftest import trips_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from metrolens import schemas
from metrolens.operators import counts, sections
from metrolens.plans import descriptive as Q
from metrolens.plans.inputs import Inputs

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

layouts = st.lists(st.tuples(st.sampled_from(["L1", "L2"]), st.integers(1, 5)), min_size=2, max_size=8)
trip_rows = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 3), st.integers(0, 23)),
                     min_size=1, max_size=40)


@SETTINGS
@given(layout=layouts, trips=trip_rows)
def test_sequence_flows_match_pair_listing(spark, layout, trips):
    names = [f"S{i}" for i in range(len(layout))]
    st_df = spark.createDataFrame([(i, names[i], ln, None, seq) for i, (ln, seq) in enumerate(layout)],
                                  schemas.STATIONS)
    rows = [(f"2024-01-0{1 + d}T{h:02d}:00:00", f"2024-01-0{1 + d}T{h:02d}:30:00",
             names[o % len(names)], names[t % len(names)], "", "") for o, t, d, h in trips]
    od = counts.od_counts(trips_df(spark, rows), "2024-01-01", "2024-01-31")
    fast = {(r["line"], r["section_id"], r["direction"]): r["flow"]
            for r in sections.sequence_flows(od, st_df).collect()}
    pos = {r["station"]: (r["line"], r["pos"]) for r in sections.station_positions(st_df).collect()}
    odc = {(r["station_in"], r["station_out"]): r["flow"] for r in od.collect()}
    secs = sections.sequence_sections(st_df).collect()
    assert len(fast) == 2 * len(secs)
    for s in secs:
        pairs = [(o, d) for o in pos for d in pos
                 if pos[o][0] == pos[d][0] == s["line"] and pos[o][1] <= s["b"] < pos[d][1]]
        assert fast[(s["line"], s["section_id"], "up")] == sum(odc.get(p, 0) for p in pairs)
        assert fast[(s["line"], s["section_id"], "down")] == sum(odc.get((d, o), 0) for o, d in pairs)


@SETTINGS
@given(trips=trip_rows)
def test_flow_totals_agree(spark, trips):
    rows = [(f"2024-01-0{1 + d}T{h:02d}:00:00", f"2024-01-0{1 + (d + 1) % 4}T{h:02d}:30:00",
             f"S{o}", f"S{t}", f"L{o % 2}", f"L{t % 2}") for o, t, d, h in trips]
    inp = Inputs(trips_df(spark, rows))
    lo, hi = "2024-01-01", "2024-01-03"
    n_in = sum(1 for _, _, d, _ in trips if d <= 2)
    l2l = sum(r["flow"] for r in Q.line_to_line_flow(inp, lo, hi).collect())
    q6 = sum(r["flow_in"] for r in Q.all_stations_flow(inp, lo, hi).collect())
    od = Q.od_flow(inp, lo, hi).collect()
    assert l2l == q6 == sum(r["flow"] for r in od) == n_in
    # Sum of the OD matrix over destinations is the entry count of each origin
    by_origin = {}
    for r in od:
        by_origin[r["station_in"]] = by_origin.get(r["station_in"], 0) + r["flow"]
    assert by_origin == {r["station"]: r["flow_in"] for r in Q.all_stations_flow(inp, lo, hi).collect()}
    # Peak counts never exceed the all-day counts
    allday = {r["station"]: r["flow_in"] for r in Q.all_stations_flow(inp, lo, hi).collect()}
    for r in Q.peak_flow(inp, lo, hi).collect():
        assert r["flow_in"] <= allday[r["station"]]
