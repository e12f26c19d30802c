"""Section flows over the station graph against a path walk."""

import random

import pytest

from metrolens.operators import network

STATIONS = "id int, station_name string, line_name string, district string, sequence int"


def brute(links, od):
    """Walk every pair's shortest path; ties go to the first predecessor by name."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    loads = {}
    for (o, d), flow in od.items():
        dist, parent, level = {o: 0}, {}, [o]
        while level:
            found = {}
            for a in level:
                for b in near.get(a, ()):
                    if b not in dist:
                        found[b] = min(found.get(b, a), a)
            dist |= {b: dist[level[0]] + 1 for b in found}
            parent |= found
            level = list(found)
        while d in parent:
            loads[parent[d], d] = loads.get((parent[d], d), 0) + flow
            d = parent[d]
    return loads


@pytest.mark.parametrize("seed", [1, 2])
def test_loads_equal_walked_paths(spark, seed):
    rng = random.Random(seed)
    names = [f"S{i:02d}" for i in range(18)]
    rows = [(i, s, f"L{i % 3}", None, i // 3) for i, s in enumerate(names)]
    rows += [(90, "P1", "L9", None, 1), (91, "P2", "L9", None, 1), (92, "P3", "L9", None, 2), (93, "far", "L8", None, 1)]  # parallel; alone
    transfers = [("S03", "S04"), ("S04", "S05"), ("S12", "S14"), ("S09", "P1"), ("S09", "P2"), ("S03", "S04"), ("S01", "S01")]
    stations = [r[1] for r in rows]
    od = {(rng.choice(stations), rng.choice(stations)): rng.randrange(1, 50) for _ in range(150)}
    od |= {(None, "S01"): 5, ("S01", None): 7, ("unknown", "S01"): 3, ("S01", "unknown"): 2, ("S02", "S02"): 9}
    links = [(a, b) for (_, a, la, _, p) in rows for (_, b, lb, _, q) in rows if la == lb and q == p + 1] + transfers
    want = brute({(a, b) for a, b in links if a != b}, {k: v for k, v in od.items() if None not in k})
    frame = spark.createDataFrame(rows, STATIONS)
    got = network.network_flows(spark.createDataFrame([(*k, v) for k, v in od.items()], "station_in string, station_out string, flow long"),
                                frame, spark.createDataFrame(transfers, "a string, b string")).collect()
    sections = {(r["source"], r["target"]) for r in got}
    assert len(got) == 2 * len(sections) == 2 * (15 + 2)
    for r in got:
        a, b = (r["source"], r["target"]) if r["direction"] == "up" else (r["target"], r["source"])
        assert r["flow"] == want.get((a, b), 0), (a, b)
    assert any(w for (a, b), w in want.items() if (a, b) in {("S03", "S04"), ("S04", "S03")})      # transfers are used


def test_same_line_journeys_equal_running_sums(spark):
    """Without transfers only journeys within a line have a path."""
    from metrolens.operators import sections
    rng = random.Random(5)
    rows = [(i, f"S{i:02d}", f"L{i % 2}", None, i) for i in range(12)]
    od = spark.createDataFrame([(f"S{rng.randrange(12):02d}", f"S{rng.randrange(12):02d}", rng.randrange(9)) for _ in range(80)],
                               "station_in string, station_out string, flow long")
    stations = spark.createDataFrame(rows, STATIONS)
    cols = ["line", "section_id", "source", "target", "direction", "flow"]
    assert sorted(network.network_flows(od, stations).select(*cols).collect()) == \
        sorted(sections.sequence_flows(od, stations).select(*cols).collect())


def test_shared_ids_are_transfers_and_empty_matrix(spark):
    stations = spark.createDataFrame([(1, "A", "x", None, 1), (2, "B", "x", None, 2), (2, "C", "y", None, 1), (3, "D", "y", None, 2)], STATIONS)
    od = spark.createDataFrame([("A", "D", 4)], "station_in string, station_out string, flow long")
    assert sorted((r["source"], r["direction"], r["flow"]) for r in network.network_flows(od, stations).collect()) == [
        ("A", "down", 0), ("A", "up", 4), ("C", "down", 0), ("C", "up", 4)]
    assert {r["flow"] for r in network.network_flows(od.limit(0), stations).collect()} == {0}
