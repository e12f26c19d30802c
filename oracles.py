"""DuckDB oracle SQL for every registered query (see ``__spark_entry__``).

Each statement rebuilds the test views of FIXTURES.md from the raw tables
and answers the query the plain way the original application did it (for
example: sections by listing every related OD pair, forecasts by explicit
recursion), so it checks the Spark plans rather than repeating them.
"""

from __future__ import annotations

import datetime as dt

from metrolens.sources.testdata import FIXTURE_AR, FIXTURE_BRIDGE, FIXTURE_MOD, FIXTURE_TOTAL, QUIET_STATION, TRANSFER_POS

# Query parameters shared with __spark_entry__ (fixed values of the checks).
EV_START, EV_END = "2024-01-01", "2024-01-30"      # whole event history
EV_MONTH = "2024-01"
EV_STATION = "S42"
EV_LINE = "L3"
BARE_SECTION = "L3/1"                              # has related pairs and flow, but no basis row
OD_LINE = "ASIA"
EV_FORECAST_START = "2024-01-31"                   # day after the history
OD_START, OD_END = "1900-01-01", "2099-12-31"      # any date: the whole order history
OD_TRAIN_END = "2001-08-01"                        # last order date
OD_FORECAST_START = "2001-08-02"                   # day after it
OD_RANK = 4                                        # columns of the fitted basis
WITHDRAWN_DAY, OD_WITHDRAWN_DAY = "2024-01-10", "1997-03-12"
FORECAST_STEPS = 7
WINDOW = 28

TRIPS_EV = """
ev as (
  select event_id, user_id, ts, cast(json_extract_string(props, '$.k') as int) as k from events),
legs as (
  select event_id as trip_id, user_id, ts as time_in, k as k_in,
         lead(ts) over w as time_out, lead(k) over w as k_out
  from ev window w as (partition by user_id order by ts, event_id)),
trips_ev as (
  select trip_id, user_id, time_in, time_out,
         'S' || lpad(cast(k_in as varchar), 2, '0') as station_in,
         'L' || cast(k_in % 10 as varchar) as line_in,
         'S' || lpad(cast(k_out as varchar), 2, '0') as station_out,
         'L' || cast(k_out % 10 as varchar) as line_out
  from legs where time_out is not null)"""

TRIPS_OD = """
trips_od as (
  select o.o_custkey as user_id, o.o_orderdate as time_in, l.l_shipdate as time_out,
         cn.n_name as station_in, cr.r_name as line_in,
         sn.n_name as station_out, sr.r_name as line_out
  from lineitem l
  join orders   o  on l.l_orderkey   = o.o_orderkey
  join customer cu on cu.c_custkey   = o.o_custkey
  join supplier su on su.s_suppkey   = l.l_suppkey
  join nation   cn on cn.n_nationkey = cu.c_nationkey
  join region   cr on cr.r_regionkey = cn.n_regionkey
  join nation   sn on sn.n_nationkey = su.s_nationkey
  join region   sr on sr.r_regionkey = sn.n_regionkey)"""

STATIONS_EV = """
stations_ev as (
  select distinct k as id, 'S' || lpad(cast(k as varchar), 2, '0') as station_name,
         'L' || cast(k % 10 as varchar) as line_name, cast(k // 10 as integer) as sequence
  from ev where k is not null
  union all select {}, '{}', '{}', {})""".format(*QUIET_STATION)

STATIONS_OD = """
stations_od as (
  select n.n_nationkey as id, n.n_name as station_name, r.r_name as line_name,
         cast(row_number() over (partition by r.r_name order by n.n_nationkey) as integer) as sequence
  from nation n join region r on n.n_regionkey = r.r_regionkey)"""

USERS_V = """
users_v as (
  select cast(c_custkey % 2 as integer) as sex, cast(1915 + c_custkey % 110 as integer) as birth_year
  from customer)"""

WORKDAYS_V = """
cal_bounds as (select min(cast(ts as date)) as lo, max(cast(ts as date)) as hi from events),
workdays_v as (
  select cast(g.d as date) as time,
         case when cast(g.d as date) = DATE '2024-01-01' or isodow(g.d) >= 6 then 0 else 1 end as workday
  from cal_bounds, unnest(generate_series(cast(lo as timestamp), cast(hi + 31 as timestamp),
                                          interval 1 day)) as g(d)
  where cast(g.d as date) <> DATE '2024-01-15')"""


def d(s: str) -> str:
    return f"DATE '{s}'"


def days_before(start: str, n: int) -> str:
    return (dt.date.fromisoformat(start) - dt.timedelta(days=n)).isoformat()


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


def stations_flow(trips: str, lo: str, hi: str) -> str:
    return with_(TRIPS_EV if trips == "trips_ev" else TRIPS_OD, f"""
i as (select station_in as station, count(*) as flow_in from {trips}
      where cast(time_in as date) between {d(lo)} and {d(hi)} group by station_in)""", f"""
o as (select station_out as station, count(*) as flow_out from {trips}
      where cast(time_out as date) between {d(lo)} and {d(hi)} group by station_out)""") + """
select i.station, i.flow_in, o.flow_out
from i left join o on i.station is not distinct from o.station"""


def dstr(expr: str) -> str:
    return f"strftime(cast({expr} as date), '%Y-%m-%d')"


def in_range(col: str, lo: str, hi: str) -> str:
    return f"cast({col} as date) between {d(lo)} and {d(hi)}"


def month_flow() -> str:
    return with_(TRIPS_EV) + f"""
select {dstr('time_in')} as time, count(*) as flow from trips_ev
where {in_range('time_in', EV_MONTH + '-01', EV_MONTH + '-31')} group by 1"""


def day_type_flow() -> str:
    return with_(TRIPS_EV, WORKDAYS_V, f"""
daily as (select cast(time_in as date) as time, count(*) as flow from trips_ev
          where {in_range('time_in', EV_START, EV_END)} group by 1)""", """
t as (select daily.flow, w.workday = 1 as is_workday from daily left join workdays_v w on daily.time = w.time)""") + """
select round(coalesce(avg(case when is_workday then flow end), 0.0), 6) as workday,
       round(coalesce(avg(case when not is_workday then flow end), 0.0), 6) as weekend
from t"""


def station_flow() -> str:
    s = EV_STATION
    return with_(TRIPS_EV) + f"""
select '{s}' as station, 'in' as direction, {dstr('time_in')} as time, count(*) as flow
from trips_ev where station_in = '{s}' and {in_range('time_in', EV_START, EV_END)} group by 3
union all
select '{s}' as station, 'out' as direction, {dstr('time_out')} as time, count(*) as flow
from trips_ev where station_out = '{s}' and {in_range('time_out', EV_START, EV_END)} group by 3"""


def age_structure() -> str:
    return with_(USERS_V, """
a as (select sex, 2021 - birth_year as age from users_v)""", """
b as (select sex, cast(ceil(age / 10.0) as integer) as bin from a
      where age > 0 and age <= 100 and sex in (0, 1))""", """
n as (select sex, bin, count(*) as n from b group by sex, bin)""", """
grid as (select s.sex, cast(g.bin as integer) as bin
         from (values (0), (1)) s(sex), range(1, 11) g(bin))""") + """
select case when grid.sex = 0 then 'male' else 'female' end as sex, grid.bin,
       cast(coalesce(n.n, 0) as bigint) as n
from grid left join n on grid.sex = n.sex and grid.bin = n.bin"""


def peak_flow() -> str:
    parts = [TRIPS_EV]
    bands = {"morning": (7, 8), "evening": (16, 18)}
    for p, (h0, h1) in bands.items():
        parts.append(f"""
{p}_i as (select station_in as station, count(*) as flow_in from trips_ev
          where {in_range('time_in', EV_START, EV_END)} and hour(time_in) between {h0} and {h1} group by 1)""")
        parts.append(f"""
{p}_o as (select station_out as station, count(*) as flow_out from trips_ev
          where {in_range('time_out', EV_START, EV_END)} and hour(time_out) between {h0} and {h1} group by 1)""")
    sel = "\nunion all\n".join(f"""
select '{p}' as period, i.station, i.flow_in, coalesce(o.flow_out, 0) as flow_out
from {p}_i i left join {p}_o o on i.station is not distinct from o.station""" for p in bands)
    return with_(*parts) + sel


def line_flow() -> str:
    return with_(TRIPS_OD) + f"""
select line_in as source, line_out as target, count(*) as flow from trips_od
where {in_range('time_in', OD_START, OD_END)} group by 1, 2"""


def od_flow() -> str:
    return with_(TRIPS_EV) + f"""
select station_in, station_out, count(*) as flow from trips_ev
where {in_range('time_in', EV_START, EV_END)} group by 1, 2"""


# Sections listed the plain way: every OD pair of a line whose journey
# passes a section, then looked up in the OD matrix (up) and reversed (down).
BRIDGE_EV = """
st as (select station_name as station, line_name as line,
              dense_rank() over (partition by line_name order by sequence) as pos from stations_ev),
sec as (select a.line, a.station as source, b.station as target, a.pos as b,
               cast(row_number() over (partition by a.line order by a.pos, a.station, b.station) - 1
                    as integer) as section_id
        from st a join st b on a.line = b.line and b.pos = a.pos + 1),
bridge as (select s.line, s.section_id, s.source, s.target, o.station as o_station, t.station as d_station
           from sec s join st o on o.line = s.line and o.pos <= s.b
                      join st t on t.line = s.line and t.pos > s.b)"""


def section_flow(bridge: str = BRIDGE_EV) -> str:
    od = f"""
od as (select station_in, station_out, count(*) as flow from trips_ev
       where {in_range('time_in', EV_START, EV_END)} group by 1, 2)"""
    sel = []
    for direction, o, t in (("up", "o_station", "d_station"), ("down", "d_station", "o_station")):
        sel.append(f"""
select '{direction}' as direction, section_id, source, target, cast(coalesce(sum(od.flow), 0) as bigint) as flow
from bridge left join od on od.station_in = bridge.{o} and od.station_out = bridge.{t}
where bridge.line = '{EV_LINE}' group by section_id, source, target""")
    return with_(TRIPS_EV, STATIONS_EV, bridge, od) + "\nunion all\n".join(sel)


def section_flow_network() -> str:
    """Every pair's shortest path walked link by link from its end."""
    return with_recursive(TRIPS_EV, STATIONS_EV, BRIDGE_EV, f"""
one_way as (select source as a, target as b from sec
            union select h.station_name, s.station_name from stations_ev h join stations_ev s on s.sequence = h.sequence
            where h.line_name = 'L0' and h.sequence = {TRANSFER_POS} and s.line_name <> 'L0')""", """
links as (select a, b from one_way union select b, a from one_way)""", """
reach(o, v, dist) as (
  select station_name, station_name, 0 from stations_ev
  union
  select r.o, l.b, r.dist + 1 from reach r join links l on l.a = r.v where r.dist < 30)""", """
near as (select o, v, min(dist) as dist from reach group by o, v)""", """
tree as (select n.o, n.v, min(l.a) as parent from near n join links l on l.b = n.v
         join near p on p.o = n.o and p.v = l.a and p.dist + 1 = n.dist group by n.o, n.v)""", f"""
od as (select station_in as o, station_out as d, count(*) as flow from trips_ev
       where {in_range('time_in', EV_START, EV_END)} group by 1, 2)""", """
walk(o, d, v, flow) as (
  select o, d, d, flow from od
  union all
  select w.o, w.d, t.parent, w.flow from walk w join tree t on t.o = w.o and t.v = w.v)""", """
loads as (select t.parent as a, t.v as b, sum(w.flow) as flow from walk w join tree t on t.o = w.o and t.v = w.v group by 1, 2)""") + f"""
select x.direction, s.section_id, s.source, s.target, cast(coalesce(loads.flow, 0) as bigint) as flow
from sec s cross join (values ('up'), ('down')) x(direction)
left join loads on loads.a = case when x.direction = 'up' then s.source else s.target end
               and loads.b = case when x.direction = 'up' then s.target else s.source end
where s.line = '{EV_LINE}'"""


def dimensions_round_trip() -> str:
    return f"""
select sex, bin, cast(n as double) as value from ({age_structure()})
union all select 'workday', 0, workday from ({day_type_flow()})
union all select 'weekend', 0, weekend from ({day_type_flow()})"""


def basis_from_numpy() -> str:
    return with_(TRIPS_EV, STATIONS_EV, _station_ents({"station_in": None}), *_lowrank_ctes("ents", 0)[:3]) + """
select model, entity, cast(factor as integer) as factor, w as weight from b"""


def _bridge_json() -> str:
    """The fixture's list of related pairs, a section without pairs once with nulls."""
    rows = [(line, i, sec["source"], sec["target"], *od) for line, secs in FIXTURE_BRIDGE.items()
            for i, sec in enumerate(secs) for od in (sec["related_OD"] or [(None, None)])]
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"""
bridge as (select line, cast(section_id as integer) as section_id, source, target, o_station, d_station
           from (values {values}) v(line, section_id, source, target, o_station, d_station)),
sec as (select distinct line, section_id, source, target from bridge)"""


def section_bridge() -> str:
    return with_(_bridge_json()) + "select * from bridge"


def section_flow_bridge() -> str:
    return section_flow(_bridge_json())


def section_flow_bridge_daily() -> str:
    return section_flow_daily(_bridge_json())


def forecast_sections_bridge() -> str:
    return forecast_sections(_bridge_json(), BARE_SECTION)


def stations_csv() -> str:
    return with_(STATIONS_OD) + """
select id, station_name, line_name, line_name as district, sequence from stations_od"""


def section_flow_od() -> str:
    bridge = BRIDGE_EV.replace("from stations_ev", "from stations_od")
    od = f"""
od as (select station_in, station_out, count(*) as flow from trips_od
       where {in_range('time_in', OD_START, OD_END)} group by 1, 2)"""
    sel = []
    for direction, o, t in (("up", "o_station", "d_station"), ("down", "d_station", "o_station")):
        sel.append(f"""
select '{direction}' as direction, section_id, source, target, cast(coalesce(sum(od.flow), 0) as bigint) as flow
from bridge left join od on od.station_in = bridge.{o} and od.station_out = bridge.{t}
where bridge.line = '{OD_LINE}' group by section_id, source, target""")
    return with_(TRIPS_OD, STATIONS_OD, bridge, od) + "\nunion all\n".join(sel)


def section_flow_daily(bridge: str = BRIDGE_EV) -> str:
    od = f"""
od as (select station_in, station_out, cast(time_in as date) as day, count(*) as flow from trips_ev
       where {in_range('time_in', EV_START, EV_END)} group by 1, 2, 3)"""
    days = f"""
days as (select cast(g.d as date) as day from unnest(generate_series(
           cast({d(EV_START)} as timestamp), cast({d(EV_END)} as timestamp), interval 1 day)) as g(d))"""
    sel = []
    for direction, o, t in (("up", "o_station", "d_station"), ("down", "d_station", "o_station")):
        sel.append(f"""
select br.line, br.section_id, br.source, br.target, '{direction}' as direction,
       strftime(days.day, '%Y-%m-%d') as day, cast(coalesce(sum(od.flow), 0) as bigint) as flow
from bridge br cross join days
left join od on od.day = days.day and od.station_in = br.{o} and od.station_out = br.{t}
group by br.line, br.section_id, br.source, br.target, days.day""")
    return with_(TRIPS_EV, STATIONS_EV, bridge, od, days) + "\nunion all\n".join(sel)


def with_recursive(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n"


def plus_days(start: str, n: int) -> str:
    return (dt.date.fromisoformat(start) + dt.timedelta(days=n)).isoformat()


def days_cte(name: str, lo: str, hi: str) -> str:
    return f"""
{name} as (select cast(g.d as date) as day from unnest(generate_series(
    cast({d(lo)} as timestamp), cast({d(hi)} as timestamp), interval 1 day)) as g(d))"""


def flit(x: float) -> str:
    return f"cast({x!r} as double)"


def station_counts_cte(lo: str, hi: str, series: dict, trips: str = "trips_ev") -> str:
    """(model, entity, day, flow) like counts.station_day_counts."""
    parts = []
    for name, (side, band) in series.items():
        ts, st = ("time_in", "station_in") if side == "in" else ("time_out", "station_out")
        cond = in_range(ts, lo, hi) + f" and {st} is not null"
        if band:
            cond += f" and hour({ts}) between {band[0]} and {band[1]}"
        parts.append(f"select '{name}' as model, {st} as entity, cast({ts} as date) as day, count(*) as flow "
                     f"from {trips} where {cond} group by 1, 2, 3")
    return "\ncnt as (" + "\nunion all\n".join(parts) + ")"


def station_day_matrix() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), days_cte("days", lo, hi), """
grid as (select m.model, s.station_name as entity, days.day
         from stations_ev s, (values ('station_in'), ('station_out')) m(model), days)""") + """
select grid.model, grid.entity, strftime(grid.day, '%Y-%m-%d') as day, cast(coalesce(cnt.flow, 0) as bigint) as flow
from grid left join cnt on grid.model = cnt.model and grid.entity = cnt.entity and grid.day = cnt.day"""


def station_day_pivot() -> str:
    lo = dt.date.fromisoformat(days_before(EV_FORECAST_START, WINDOW))
    cols = []
    for i in range(WINDOW):
        day = (lo + dt.timedelta(days=i)).isoformat()
        cols.append(f"cast(coalesce(sum(case when day = {d(day)} then flow end), 0) as bigint) as \"{day}\"")
    series = {"station_in": ("in", None)}
    return with_(TRIPS_EV, station_counts_cte(lo.isoformat(), days_before(EV_FORECAST_START, 1), series)) + \
        "select entity as station, " + ", ".join(cols) + " from cnt group by entity"


def od_daily_resample() -> str:
    return with_(TRIPS_EV, f"""
od as (select station_in, station_out, cast(time_in as date) as day, count(*) as flow from trips_ev
       where {in_range('time_in', EV_START, EV_END)} group by 1, 2, 3)""", """
span as (select station_in, station_out, min(day) as lo, max(day) as hi from od group by 1, 2)""", """
grid as (select station_in, station_out, cast(g.d as date) as day
         from span, unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as g(d))""") + """
select grid.station_in, grid.station_out, strftime(grid.day, '%Y-%m-%d') as day,
       cast(coalesce(od.flow, 0) as bigint) as flow
from grid left join od on grid.station_in = od.station_in and grid.station_out = od.station_out
                      and grid.day = od.day"""


def lag_features() -> str:
    lags = (1, 4, 7, 14, 21, 28)
    cols = ", ".join(f"lag(flow, {n}) over w as lag_{n}" for n in lags)
    return with_(TRIPS_OD, f"""
cnt as (select station_in as station, cast(time_in as date) as day, count(*) as flow from trips_od
        where {in_range('time_in', OD_START, OD_END)} and station_in is not null group by 1, 2)""", """
span as (select station, min(day) as lo, max(day) as hi from cnt group by 1)""", """
grid as (select station, cast(g.d as date) as day
         from span, unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as g(d))""", """
dense as (select grid.station, grid.day, cast(coalesce(cnt.flow, 0) as bigint) as flow
          from grid left join cnt on grid.station = cnt.station and grid.day = cnt.day)""") + f"""
select station, strftime(day, '%Y-%m-%d') as day, flow, {cols},
       lag(flow, 1) over w - lag(flow, 29) over w as trend
from dense window w as (partition by station order by day)"""


def _total_step_expr() -> str:
    w = {k: float(FIXTURE_TOTAL.get(k, 0.0)) for k in
         ("intercept", "is_workday", "lag_1", "lag_4", "lag_7", "lag_14", "lag_21", "lag_28", "trend")}
    e = f"{flit(w['intercept'])} + {flit(w['is_workday'])} * fl[i + 1]"
    for m in (1, 4, 7, 14, 21, 28):
        e += f" + {flit(w[f'lag_{m}'])} * h[-{m}]"
    e += f" + {flit(w['trend'])} * (h[-1] - h[-29])"
    return f"round_even({e}, 0)"


def _recursive_total(keyed: bool) -> str:
    n, start = FORECAST_STEPS, EV_FORECAST_START
    lo, hi = days_before(start, 29), days_before(start, 1)
    key = "station_in" if keyed else "'total'"
    daily = f"""
daily as (select {key} as series, cast(time_in as date) as day, count(*) as flow from trips_ev
          where {in_range('time_in', lo, hi)} {'and station_in is not null' if keyed else ''} group by 1, 2)"""
    ents = "select station_name as series from stations_ev" if keyed else "select 'total' as series"
    init = """
flags as (select fd.day, coalesce(w.wd, 0.0) as wd from fd left join
          (select time, max(cast(workday = 1 as double)) as wd from workdays_v group by time) w on w.time = fd.day)""", f"""
init as (select s.series,
                list(cast(coalesce(daily.flow, 0) as double) order by hd.day) as h,
                (select list(wd order by day) from flags) as fl
         from ({ents}) s cross join hd
         left join daily on daily.series = s.series and daily.day = hd.day
         group by s.series)""", f"""
steps(series, i, h, fl) as (
  select series, 0, h, fl from init
  union all
  select series, i + 1, list_append(h, {_total_step_expr()}), fl from steps where i < {n})"""
    sel = f"""
select {'series as station, ' if keyed else ''}strftime({d(start)} + cast(j - 1 as integer), '%Y-%m-%d') as time,
       cast(fl[j] as integer) as is_workday, cast(h[29 + j] as bigint) as flow
from steps, range(1, {n + 1}) t(j) where i = {n}"""
    return with_recursive(TRIPS_EV, STATIONS_EV, WORKDAYS_V, daily, days_cte("hd", lo, hi),
                          days_cte("fd", start, plus_days(start, n - 1)), *init) + sel


def _ar_weight(day_col: str, target: str) -> str:
    cases = " ".join(f"when {lag} then {flit(w)}" for lag, w in sorted(FIXTURE_AR.items()))
    return f"case datediff('day', {day_col}, {d(target)}) {cases} else 0.0 end"


def _lowrank_ctes(ents: str, steps: int) -> list[str]:
    """Fixture basis (entity i of a model: weights 1 and i % 3), whose
    pseudo-inverse is the plain 2 x 2 inverse of its normal equations; AR step
    and clip/round, unrolled ``steps`` times.
    Needs ``ents(model, entity)`` and ``cnt(model, entity, day, flow)``."""
    start = EV_FORECAST_START
    ctes = [f"""
c as (select model, entity, cast((row_number() over (partition by model order by entity) - 1) % {FIXTURE_MOD} as double)
             as c from ents)""", """
g as (select model, count(*) as n, sum(c) as s, sum(c * c) as ss from c group by 1)""", """
b as (select model, entity, 0 as factor, 1.0::double as w, (ss - s * c) / (n * ss - s * s) as pw from c join g using (model)
      union all
      select model, entity, 1, c, (n * c - s) / (n * ss - s * s) from c join g using (model))""", f"""
h0 as (select cnt.model, b.factor, cnt.day, sum(cnt.flow * b.pw) as q
       from cnt join b on cnt.model = b.model and cnt.entity = b.entity
       where cnt.day between {d(days_before(start, WINDOW))} and {d(days_before(start, 1))}
       group by cnt.model, b.factor, cnt.day)"""]
    for i in range(steps):
        t = plus_days(start, i)
        ctes.append(f"""
qn{i} as (select model, factor, sum(q * {_ar_weight('day', t)}) as q from h{i} group by 1, 2)""")
        ctes.append(f"""
a{i} as (select b.model, b.entity, {d(t)} as day,
                round_even(greatest(sum(b.w * coalesce(qn.q, 0.0)), 0.0), 0) as flow
         from b left join qn{i} qn on qn.model = b.model and qn.factor = b.factor group by b.model, b.entity)""")
        if i < steps - 1:
            ctes.append(f"""
h{i + 1} as (select * from h{i}
          union all
          select a.model, b.factor, a.day, sum(a.flow * b.pw) as q
          from a{i} a join b on a.model = b.model and a.entity = b.entity
          group by a.model, b.factor, a.day)""")
    return ctes


def _station_ents(models, stations: str = "stations_ev") -> str:
    vals = ", ".join(f"('{m}')" for m in models)
    return f"""
ents as (select m.model, s.station_name as entity from {stations} s, (values {vals}) m(model))"""


def fit_ar_one_lag() -> str:
    """One lag without intercept, per factor: sum(x y) / sum(x x) over the
    dense factor series of the whole order history."""
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    lowrank = _lowrank_ctes("ents", 0)
    h0 = lowrank[-1].replace(f"where cnt.day between {d(days_before(EV_FORECAST_START, WINDOW))} "
                             f"and {d(days_before(EV_FORECAST_START, 1))}", "")
    return with_(TRIPS_OD, STATIONS_OD, station_counts_cte(OD_START, OD_TRAIN_END, series, "trips_od"),
                 _station_ents(series, "stations_od"), *lowrank[:-1], h0, """
span as (select model, min(day) as lo, max(day) as hi from h0 group by 1)""", """
days as (select model, cast(g.d as date) as day from span,
         unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as g(d))""", """
dense as (select days.model, f.factor, days.day, coalesce(h0.q, 0.0) as y
          from days join (select distinct model, factor from b) f on f.model = days.model
          left join h0 on h0.model = days.model and h0.factor = f.factor and h0.day = days.day)""", """
lagged as (select *, lag(y) over (partition by model, factor order by day) as x from dense)""") + """
select model, factor, cast(1 as integer) as lag, round(sum(x * y) / sum(x * x), 6) as weight
from lagged where x is not null group by model, factor"""


def _solved(name: str, source: str, n: int) -> list[str]:
    """Gauss-Jordan elimination: ``source(key, i, j, a)`` holds per key the n
    equations i with the coefficients j = 1..n and the right side j = n + 1;
    ``name(key, i, x)`` is the solution."""
    return [f"""
{name}_r as (select key, i, list(a order by j) as r from {source} group by key, i)""", f"""
{name}_m as (select key, list(r order by i) as m from {name}_r group by key)""", f"""
{name}_g(key, k, m) as (
  select key, 0, m from {name}_m
  union all
  select key, k + 1, list_transform(m, lambda r, i: case when i = k + 1
      then list_transform(r, lambda x: x / m[k + 1][k + 1])
      else list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end)
  from {name}_g where k < {n})""", f"""
{name} as (select key, i, m[i][{n + 1}] as x from {name}_g, range(1, {n + 1}) t(i) where k = {n})"""]


_FEATURES = ("is_workday", "lag_1", "lag_4", "lag_7", "lag_14", "lag_21", "lag_28", "trend")
WORKDAYS_OD = WORKDAYS_V.replace("from events", "from orders").replace("cast(ts as date)", "cast(o_orderdate as date)") \
    .replace("workdays_v", "workdays_od")


def _regression_ctes(keyed: bool) -> list[str]:
    """Normal equations of label ~ 1 + features over the order history, of the
    total series or of all stations pooled; ``sol(key, i, x)``: intercept, then
    the features in order."""
    key = "station_in" if keyed else "'total'"
    lags = ", ".join(f"lag(flow, {n}) over w as lag_{n}" for n in (1, 4, 7, 14, 21, 28))
    return [f"""
cnt as (select {key} as series, cast(time_in as date) as day, count(*) as flow from trips_od
        where {in_range('time_in', OD_START, OD_TRAIN_END)} {'and station_in is not null' if keyed else ''} group by 1, 2)""", """
span as (select series, min(day) as lo, max(day) as hi from cnt group by 1)""", """
grid as (select series, cast(g.d as date) as day
         from span, unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as g(d))""", """
dense as (select grid.series, grid.day, cast(coalesce(cnt.flow, 0) as double) as flow
          from grid left join cnt on grid.series = cnt.series and grid.day = cnt.day)""", f"""
feat as (select series, day, flow, {lags}, lag(flow, 1) over w - lag(flow, 29) over w as trend
         from dense window w as (partition by series order by day))""", f"""
xs as (select list_concat([1.0, cast(coalesce(w.wd, 0) as double)], [{', '.join(_FEATURES[1:])}, flow]) as x
       from feat left join (select time, max(cast(workday = 1 as integer)) as wd from workdays_od group by time) w on w.time = feat.day
       where trend is not null)""", """
eq as (select 'all' as key, i, j, sum(x[i] * x[j]) as a from xs, range(1, 10) t(i), range(1, 11) u(j) group by i, j)""",
            *_solved("sol", "eq", 9)]


def fit_regression(keyed: bool) -> str:
    names = "['intercept', " + ", ".join(f"'{f}'" for f in _FEATURES) + "]"
    return with_recursive(TRIPS_OD, WORKDAYS_OD, *_regression_ctes(keyed)) + f"""
select {names}[i] as feature, round(x, 6) + 0.0 as weight from sol"""


def forecast_regression(keyed: bool) -> str:
    """The fitted weights folded over the days after the order history."""
    start, n = OD_FORECAST_START, FORECAST_STEPS
    step = "c[1] + c[2] * fl[i + 1] + " + " + ".join(f"c[{k + 3}] * h[-{m}]" for k, m in enumerate((1, 4, 7, 14, 21, 28))) \
        + " + c[9] * (h[-1] - h[-29])"
    return with_recursive(
        TRIPS_OD, STATIONS_OD, WORKDAYS_OD, *_regression_ctes(keyed),
        days_cte("hd", days_before(start, 29), days_before(start, 1)), days_cte("fd", start, plus_days(start, n - 1)), """
flags as (select fd.day, coalesce(w.wd, 0.0) as wd from fd left join
          (select time, max(cast(workday = 1 as double)) as wd from workdays_od group by time) w on w.time = fd.day)""", f"""
init as (select s.series, list(cast(coalesce(cnt.flow, 0) as double) order by hd.day) as h,
                (select list(wd order by day) from flags) as fl, (select list(x order by i) from sol) as c
         from (select {"station_name as series from stations_od" if keyed else "'total' as series"}) s cross join hd
         left join cnt on cnt.series = s.series and cnt.day = hd.day group by s.series)""", f"""
steps(series, i, h, fl, c) as (
  select series, 0, h, fl, c from init
  union all
  select series, i + 1, list_append(h, round_even({step}, 0)), fl, c from steps where i < {n})""") + f"""
select {'series as station, ' if keyed else ''}strftime({d(start)} + cast(j - 1 as integer), '%Y-%m-%d') as time,
       cast(fl[j] as integer) as is_workday, cast(h[29 + j] as bigint) as flow
from steps, range(1, {n + 1}) t(j) where i = {n}"""


def _factor_series_od() -> list[str]:
    """dense(model, factor, day, y): the fixture basis' factor series over the order history."""
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    lowrank = _lowrank_ctes("ents", 0)
    h0 = lowrank[-1].replace(f"where cnt.day between {d(days_before(EV_FORECAST_START, WINDOW))} "
                             f"and {d(days_before(EV_FORECAST_START, 1))}", "")
    return [TRIPS_OD, STATIONS_OD, station_counts_cte(OD_START, OD_TRAIN_END, series, "trips_od"),
            _station_ents(series, "stations_od"), *lowrank[:-1], h0, """
span as (select model, min(day) as lo, max(day) as hi from h0 group by 1)""", """
days as (select model, cast(g.d as date) as day from span,
         unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as g(d))""", """
dense as (select days.model, f.factor, days.day, coalesce(h0.q, 0.0) as y
          from days join (select distinct model, factor from b) f on f.model = days.model
          left join h0 on h0.model = days.model and h0.factor = f.factor and h0.day = days.day)"""]


def fit_factor_ar(lags: int) -> str:
    """Normal equations per (model, factor): own values 1..lags days before."""
    return with_recursive(*_factor_series_od(), f"""
lagged as (select model, factor, list(y) over (partition by model, factor order by day rows between {lags} preceding and current row) as x
           from dense)""", f"""
eq as (select (model, factor) as key, i, j, sum(x[{lags + 1} - i] * case when j > {lags} then x[{lags + 1}] else x[{lags + 1} - j] end) as a
       from lagged, range(1, {lags + 1}) t(i), range(1, {lags + 2}) u(j) where len(x) = {lags + 1} group by all)""",
                          *_solved("sol", "eq", lags)) + """
select key[1] as model, cast(key[2] as integer) as factor, cast(i as integer) as lag, round(x, 6) + 0.0 as weight from sol"""


def fit_cross_one_lag() -> str:
    """One lag across the fixture basis' two factors: two equations for each target."""
    return with_recursive(*_factor_series_od(), """
wide as (select model, day, list(y order by factor) as y from dense group by model, day)""", """
pairs as (select model, y, lag(y) over (partition by model order by day) as x from wide)""", """
eq as (select (model, f) as key, i, j, sum(x[i] * case when j = 3 then y[f + 1] else x[j] end) as a
       from pairs, range(2) t(f), range(1, 3) u(i), range(1, 4) v(j) where x is not null group by all)""",
                          *_solved("sol", "eq", 2)) + """
select key[1] as model, cast(key[2] as integer) as factor, cast(1 as integer) as lag, cast(i - 1 as integer) as source,
       round(x, 6) + 0.0 as weight from sol"""


def fit_basis_products() -> str:
    return f"""
select m.model, cast(i.f as integer) as f1, cast(j.f as integer) as f2, cast(i.f = j.f as double) as dot
from (values ('station_in'), ('station_out')) m(model), range({OD_RANK}) i(f), range({OD_RANK}) j(f)"""


def basis_project() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), _station_ents(series),
                 *_lowrank_ctes("ents", 0)) + """
select model, strftime(day, '%Y-%m-%d') as day, factor, round(q, 6) + 0.0 as q from h0"""


def basis_reconstruct() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), _station_ents(series),
                 *_lowrank_ctes("ents", 0)) + """
select b.model, b.entity, strftime(h0.day, '%Y-%m-%d') as day, round(sum(b.w * h0.q), 6) + 0.0 as value
from b join h0 on h0.model = b.model and h0.factor = b.factor group by b.model, b.entity, h0.day"""


def forecast_stations() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), _station_ents(series),
                 *_lowrank_ctes("ents", 1)) + """
select entity as station,
       cast(max(case when model = 'station_in' then flow end) as bigint) as flow_in,
       cast(max(case when model = 'station_out' then flow end) as bigint) as flow_out
from a0 group by entity"""


def forecast_station_7d() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    series = {"station_in": ("in", None), "station_out": ("out", None)}
    n = FORECAST_STEPS
    union = " union all ".join(f"select * from a{i}" for i in range(n))
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), _station_ents(series),
                 *_lowrank_ctes("ents", n)) + f"""
select entity as station, case when model = 'station_in' then 'in' else 'out' end as direction,
       strftime(day, '%Y-%m-%d') as time, cast(flow as bigint) as flow
from ({union}) where entity = '{EV_STATION}'"""


def forecast_peak() -> str:
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    bands = {"morning": (7, 8), "evening": (16, 18)}
    series = {f"peak_{p}_{s}": (s, b) for p, b in bands.items() for s in ("in", "out")}
    return with_(TRIPS_EV, STATIONS_EV, station_counts_cte(lo, hi, series), _station_ents(series),
                 *_lowrank_ctes("ents", 1)) + """
select split_part(model, '_', 2) as period, entity as station,
       cast(max(case when split_part(model, '_', 3) = 'in' then flow end) as bigint) as flow_in,
       cast(max(case when split_part(model, '_', 3) = 'out' then flow end) as bigint) as flow_out
from a0 group by 1, 2"""


def forecast_sections(bridge: str = BRIDGE_EV, without: str = "") -> str:
    """``without``: a section that the basis has no rows for; it is answered with 0."""
    lo, hi = days_before(EV_FORECAST_START, WINDOW), days_before(EV_FORECAST_START, 1)
    od = f"""
od as (select station_in, station_out, cast(time_in as date) as day, count(*) as flow from trips_ev
       where {in_range('time_in', lo, hi)} group by 1, 2, 3)"""
    parts = []
    for direction, o, t in (("up", "o_station", "d_station"), ("down", "d_station", "o_station")):
        parts.append(f"""
select 'section_{direction}' as model, br.line || '/' || cast(br.section_id as varchar) as entity,
       od.day, sum(od.flow) as flow
from bridge br join od on od.station_in = br.{o} and od.station_out = br.{t} group by 1, 2, 3""")
    cnt = "\ncnt as (" + "\nunion all\n".join(parts) + ")"
    ents = """
secs as (select distinct line, section_id, source, target, line || '/' || cast(section_id as varchar) as entity
         from sec),
asked as (select m.model, s.* from secs s, (values ('section_up'), ('section_down')) m(model)),
ents as (select model, entity from asked where entity <> '""" + without + """')"""
    return with_(TRIPS_EV, STATIONS_EV, bridge, od, cnt, ents, *_lowrank_ctes("ents", 1)) + f"""
select replace(asked.model, 'section_', '') as direction, section_id, source, target,
       cast(coalesce(a0.flow, 0) as bigint) as flow
from asked left join a0 on asked.entity = a0.entity and asked.model = a0.model where line = '{EV_LINE}'"""


SIDES_EV = """
sides as (
  select 'in' as side, time_in as ts, station_in as station, line_in as line,
         station_out as peer_station, line_out as peer_line from trips_ev
  union all
  select 'out' as side, time_out as ts, station_out as station, line_out as line,
         station_in as peer_station, line_in as peer_line from trips_ev)"""


def daily_rollup() -> str:
    return with_(TRIPS_EV, SIDES_EV) + """
select side, strftime(cast(ts as date), '%Y-%m-%d') as day, cast(hour(ts) as integer) as hour,
       station, line, peer_station, peer_line, count(*) as n
from sides
group by side, cast(ts as date), hour(ts), station, line, peer_station, peer_line"""


def rollup_refresh_withdrawn() -> str:
    """No trip that enters or leaves on the withdrawn day is left."""
    left = f"""
left_ev as (select * from trips_ev where cast(time_in as date) <> {d(WITHDRAWN_DAY)}
            and cast(time_out as date) <> {d(WITHDRAWN_DAY)})"""
    return daily_rollup().replace(SIDES_EV.strip(), left.strip() + "," + SIDES_EV.replace("trips_ev", "left_ev"))


def rollup_refresh_month() -> str:
    sides = SIDES_EV.replace("trips_ev", "left_od")
    left = f"""
left_od as (select * from trips_od where cast(time_in as date) <> {d(OD_WITHDRAWN_DAY)}
            and cast(time_out as date) <> {d(OD_WITHDRAWN_DAY)})"""
    return daily_rollup().replace(TRIPS_EV.strip(), TRIPS_OD.strip()).replace(SIDES_EV.strip(), left.strip() + "," + sides)


def oracle_sql() -> dict[str, str]:
    return {
        "stations_flow": stations_flow("trips_ev", EV_START, EV_END),
        "stations_flow_od": stations_flow("trips_od", OD_START, OD_END),
        "month_flow": month_flow(),
        "day_type_flow": day_type_flow(),
        "station_flow": station_flow(),
        "age_structure": age_structure(),
        "peak_flow": peak_flow(),
        "line_flow": line_flow(),
        "od_flow": od_flow(),
        "section_flow": section_flow(),
        "stations_csv": stations_csv(),
        "section_flow_od": section_flow_od(),
        "section_flow_network": section_flow_network(),
        "section_flow_daily": section_flow_daily(),
        "station_day_matrix": station_day_matrix(),
        "station_day_pivot": station_day_pivot(),
        "od_daily_resample": od_daily_resample(),
        "lag_features": lag_features(),
        "forecast_total": _recursive_total(keyed=False),
        "forecast_panel": _recursive_total(keyed=True),
        "basis_project": basis_project(),
        "basis_reconstruct": basis_reconstruct(),
        "forecast_stations": forecast_stations(),
        "forecast_station_7d": forecast_station_7d(),
        "forecast_sections": forecast_sections(),
        "forecast_peak": forecast_peak(),
        "daily_rollup": daily_rollup(),
        "stations_flow_from_rollup": stations_flow("trips_ev", EV_START, EV_END),
        "peak_flow_from_rollup": peak_flow(),
        "month_flow_from_rollup": month_flow(),
        "station_flow_from_rollup": station_flow(),
        "section_flow_from_rollup": section_flow(),
        "line_flow_from_rollup": line_flow(),
        "fit_ar_one_lag": fit_ar_one_lag(),
        "fit_basis_products": fit_basis_products(),
        "fit_total_forecast": fit_regression(keyed=False),
        "fit_total_saved": fit_regression(keyed=False),
        "fit_pooled": fit_regression(keyed=True),
        "forecast_total_fitted": forecast_regression(keyed=False),
        "forecast_panel_fitted": forecast_regression(keyed=True),
        "fit_factor_ar": fit_factor_ar(WINDOW),
        "fit_ar_two_lags": fit_factor_ar(2),
        "fit_cross_one_lag": fit_cross_one_lag(),
        "month_flow_by_day": month_flow(),
        "dimensions_round_trip": dimensions_round_trip(),
        "peak_records": peak_flow(),
        "basis_from_numpy": basis_from_numpy(),
        "section_bridge": section_bridge(),
        "section_flow_bridge": section_flow_bridge(),
        "section_flow_bridge_daily": section_flow_bridge_daily(),
        "forecast_sections_bridge": forecast_sections_bridge(),
        "day_type_flow_from_rollup": day_type_flow(),
        "forecast_total_from_rollup": _recursive_total(keyed=False),
        "forecast_stations_from_rollup": forecast_stations(),
        "forecast_peak_from_rollup": forecast_peak(),
        "rollup_refresh": daily_rollup(),
        "rollup_refresh_withdrawn": rollup_refresh_withdrawn(),
        "rollup_refresh_month": rollup_refresh_month(),
        "stations_flow_by_day": stations_flow("trips_ev", EV_START, EV_END),
        "peak_flow_by_day": peak_flow(),
        "station_flow_by_day": station_flow(),
        "forecast_stations_by_day": forecast_stations(),
        "forecast_peak_by_day": forecast_peak(),
        "stream_rollup": daily_rollup(),
        "stream_windows": daily_rollup(),
    }
