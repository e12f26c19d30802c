"""Low-rank entity x day forecasting (M5-M9) as joins and aggregations.

A panel A (entities x days, long form ``model, entity, day, flow``) is
projected onto a basis P (``model, entity, factor, weight``):
Q = pinv(P) A, one k-vector per day. An autoregression over the last
``window`` days gives the next day's factor vector q, and the forecast is
``round_half_even(max(P q, 0))`` for every entity of P.

pinv(P) comes from an orthogonal factorisation of P itself, never from
P^T P: every block of rows is reduced by QR to a triangle, keeping the block's
orthonormal rows; the triangles of a model are reduced together and their SVD
R = U S V^T gives pinv(P)^T row by row as q U S^-1 V^T, where q is the
entity's row of the joined Q. Small singular values are cut where numpy's
``pinv`` cuts them, so ill-conditioned bases give what numpy gives.

The rank k of a basis is bounded by ``MAX_RANK``; whatever is held per model -
the triangles (k x k per ``BLOCK_ROWS`` entities), a factor vector, the factor
history - is bounded by parameters and never by the data. The panel itself is
never gathered, and nothing is collected while a plan is built: the recursion
over several days is a chain of joins and sums over one row of state per model.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolens.functions.dates import as_date
from metrolens.functions.numeric import clip_round
from metrolens.session import scratch_path

WINDOW_DAYS = 28
MAX_RANK = 256
BLOCK_ROWS = 65_536       # entities that one task reduces to a triangle
_RCOND = 1e-15            # numpy.linalg.pinv's default


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_basis(basis: DataFrame) -> DataFrame:
    """(model, entity, factors, w): one row per entity with its dense weights
    in the order of the model's factor numbers. All-zero rows are kept."""
    factors = basis.groupBy("model").agg(F.sort_array(F.collect_set("factor")).alias("factors"))
    checked = factors.select("model", F.when(
        F.size("factors") > MAX_RANK, F.raise_error(F.lit(f"a basis has more than {MAX_RANK} factors")).cast("array<int>"))
        .otherwise(F.col("factors")).alias("factors"))
    rows = basis.groupBy("model", "entity").agg(
        F.map_from_entries(F.collect_list(F.struct("factor", "weight"))).alias("m"))
    # one row of at most MAX_RANK numbers per model: a bounded broadcast
    return rows.join(F.broadcast(checked), "model").select(
        "model", "entity", "factors",
        F.transform("factors", lambda f: F.coalesce(F.element_at("m", f), F.lit(0.0))).alias("w"))


_BLOCKS = "model string, block string, entity string, factors array<int>, w array<double>, q array<double>, r array<double>"


def _block_qr(batches):
    """mapInArrow step: QR of the rows of each model, block by block. Every row
    keeps its row of the block's Q; the first one also carries the triangle."""
    import uuid

    import pyarrow as pa

    held: dict[str, list] = {}

    def reduced(model):
        rows = held.pop(model)
        q, r = np.linalg.qr(np.array([x[2] for x in rows], float))
        block = uuid.uuid4().hex
        return pa.RecordBatch.from_pydict({
            "model": pa.array([model] * len(rows)), "block": pa.array([block] * len(rows)), "entity": pa.array([x[0] for x in rows], pa.string()),
            "factors": pa.array([x[1] for x in rows], pa.list_(pa.int32())), "w": pa.array([x[2] for x in rows], pa.list_(pa.float64())),
            "q": pa.array(list(q), pa.list_(pa.float64())),
            "r": pa.array([r.ravel().tolist()] + [None] * (len(rows) - 1), pa.list_(pa.float64()))})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("model", "entity", "factors", "w")]
        for model, *row in zip(*columns):
            held.setdefault(model, []).append(row)
            if len(held[model]) == BLOCK_ROWS:
                yield reduced(model)
    for model in list(held):
        yield reduced(model)


def _joined_inverse(table):
    """applyInArrow step: a model's triangles -> per block the matrix that turns
    its rows of Q into columns of pinv(P)."""
    import pyarrow as pa

    k = len(table.column("factors")[0])
    triangles = [np.array(r).reshape(-1, k) for r in table.column("r").to_pylist()]
    q, r = np.linalg.qr(np.vstack(triangles))
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    keep = s > _RCOND * s.max(initial=0.0)
    right = (u[:, keep] / s[keep]) @ vt[keep]
    stops = np.cumsum([len(t) for t in triangles])
    turns = [q[stop - len(t):stop] @ right for t, stop in zip(triangles, stops)]
    return pa.table({"model": table.column("model"), "block": table.column("block"),
                     "lead": pa.array([i == 0 for i in range(len(turns))]), "turn": pa.array([t.ravel().tolist() for t in turns], pa.list_(pa.float64()))})


def basis_blocks(basis: DataFrame) -> DataFrame:
    """The packed basis with its block-wise QR, written, so that the rows and
    the triangle of a block belong together."""
    return _written(packed_basis(basis).mapInArrow(_block_qr, _BLOCKS), "basis-blocks")


def packed_weights(blocks: DataFrame) -> DataFrame:
    """(model, entity, factors, w, pw, lead) with pw the entity's column of
    pinv(P); ``lead`` marks one entity of each model."""
    heads = blocks.where("r IS NOT NULL").select("model", "block", "factors", "r")
    turns = heads.groupBy("model").applyInArrow(_joined_inverse, "model string, block string, lead boolean, turn array<double>")
    k, m = F.size("factors"), F.size("q")
    column = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.aggregate(
        F.sequence(F.lit(0), m - 1), F.lit(0.0), lambda s, i: s + F.get("q", i) * F.get("turn", i * k + j)))
    # k x k numbers per BLOCK_ROWS entities: joined by block
    return blocks.join(turns, ["model", "block"]).select(
        "model", "entity", "factors", "w", column.alias("pw"), (F.col("lead") & F.col("r").isNotNull()).alias("lead"))


def projection_weights(basis: DataFrame) -> DataFrame:
    """(model, entity, factor, pw) with pw = pinv(P)^T, so Q = sum_e pw * A."""
    zipped = F.explode(F.arrays_zip("factors", "pw"))
    return (packed_weights(basis_blocks(basis)).select("model", "entity", zipped.alias("z"))
            .select("model", "entity", F.col("z.factors").alias("factor"), F.col("z.pw").alias("pw")))


def project(panel: DataFrame, pw: DataFrame) -> DataFrame:
    """Q = pinv(P) A as (model, day, factor, q) (M5). Zero cells may be absent."""
    return (panel.join(pw, ["model", "entity"])
            .groupBy("model", "day", "factor")
            .agg(F.sum(F.col("flow") * F.col("pw")).alias("q")))


def reconstruct(factors: DataFrame, basis: DataFrame) -> DataFrame:
    """P q per entity, unrounded, as (model, entity, value) (M7 before clip/round).

    Every entity of the basis gets a value; factors without a row count 0.
    """
    # factors: one row per (model, factor) - bounded by models x k, broadcast.
    return (basis.join(F.broadcast(factors), ["model", "factor"], "left")
            .groupBy("model", "entity")
            .agg(F.sum(F.col("weight") * F.coalesce(F.col("q"), F.lit(0.0))).alias("value")))


def reconstruct_panel(factors: DataFrame, basis: DataFrame) -> DataFrame:
    """P Q for every day of a factor panel: (model, entity, day, value) (M7).

    Only (entity, day) cells whose factors have a row are produced; the
    projection of an all-zero day is zero and stays absent.
    """
    # factors: models x k x days rows (days = the window) - bounded, broadcast.
    return (basis.join(F.broadcast(factors), ["model", "factor"])
            .groupBy("model", "entity", "day")
            .agg(F.sum(F.col("weight") * F.col("q")).alias("value")))


def next_factors(history: DataFrame, coef: DataFrame, target) -> DataFrame:
    """AR step (M6): q[target] of every factor as the weighted sum of the last
    days' factors. ``coef``: (model, factor, lag, weight), or with a column
    ``source``, the factor that the weight applies to (without it: itself)."""
    t = F.lit(as_date(target))
    lagged = history.select("model", F.col("factor").alias("source"), F.datediff(t, F.col("day")).cast("int").alias("lag"), "q")
    # coef: models x k x lags (x k) rows - a bounded parameter table, broadcast.
    return (lagged.join(F.broadcast(_with_source(coef)), ["model", "source", "lag"])
            .groupBy("model", "factor").agg(F.sum(F.col("q") * F.col("weight")).alias("q")))


def _with_source(coef: DataFrame) -> DataFrame:
    source = "source" if "source" in coef.columns else "factor"
    return coef.select("model", "factor", "lag", F.col(source).alias("source"), "weight")


def _states(blocks: DataFrame, packed: DataFrame, coef: DataFrame, known: DataFrame, start: dt.date, window: int) -> DataFrame:
    """(model, factors, rules, days): one row per model. ``rules``: per factor
    the (lag, place of the source, weight) of its AR step; ``days``: the factor
    vectors of the ``window`` days before ``start``, the oldest first."""
    order = blocks.groupBy("model").agg(F.first("factors").alias("factors"))
    weights = _with_source(coef).groupBy("model").agg(F.collect_list(F.struct("factor", "lag", "source", "weight")).alias("coefs"))
    cells = known.join(packed, ["model", "entity"]).select("model", "day", "flow", F.posexplode("pw").alias("place", "pw")) \
        .groupBy("model", "day", "place").agg(F.sum(F.col("flow") * F.col("pw")).alias("q")) \
        .groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(
            F.struct(F.datediff("day", F.lit(start - dt.timedelta(days=window))).alias("day"), "place"), "q"))).alias("cells"))
    places = F.sequence(F.lit(0), F.size("factors") - 1)
    days = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda d: F.transform(
        places, lambda p: F.coalesce(F.element_at("cells", F.struct(d.alias("day"), p.alias("place"))), F.lit(0.0))))
    rules = F.transform("factors", lambda f: F.transform(
        F.filter("coefs", lambda c: (c["factor"] == f) & F.array_contains("factors", c["source"]) & (c["lag"] <= window)),
        lambda c: F.struct(c["lag"].alias("lag"), (F.array_position("factors", c["source"]) - 1).cast("int").alias("place"),
                           c["weight"].alias("weight"))))
    # one row of at most k x k x window numbers per model on either side
    return order.join(weights, "model", "left").join(cells, "model", "left").select("model", "factors", rules.alias("rules"), days.alias("days"))


def _step(days: Column, rules: Column) -> Column:
    """The next day's factor vector from the days so far."""
    def term(c: Column) -> Column:
        return c["weight"] * F.get(F.element_at(days, -c["lag"]), c["place"])
    return F.transform(rules, lambda own: F.aggregate(F.coalesce(own, F.array()), F.lit(0.0), lambda s, c: s + term(c)))


def low_rank_forecast(panel: DataFrame, basis: DataFrame, coef: DataFrame, start, n: int = 1,
                      window: int = WINDOW_DAYS) -> DataFrame:
    """n-step forecast for every (model, entity) of the basis.

    ``panel``: (model, entity, day, flow) - only days in
    ``[start - window, start - 1]`` are used; missing cells are zeros.
    Each step's clipped, rounded forecast is projected back and appended
    to the factor history, as the reference re-projected its own
    predictions. The basis is factorised and written once; the state is one row per
    model with its AR weights and factor history, and a step joins it to the
    basis, sums the projected forecast and appends the sum: one plan for all
    steps, in which each step uses the one before once.
    Returns (model, entity, day, flow) with flow a long.
    """
    start = as_date(start)
    known = panel.where(F.col("day").between(F.lit(start - dt.timedelta(days=window)),
                                             F.lit(start - dt.timedelta(days=1))))
    blocks = basis_blocks(basis)
    packed = packed_weights(blocks) if n == 1 else _written(packed_weights(blocks), "packed-basis")
    state = _states(blocks, packed, coef, known, start, window).withColumn("q", _step(F.col("days"), F.col("rules"))) \
        .withColumn("ahead", F.array("q")).drop("factors")
    flow = lambda q: clip_round(_dot(F.col("w"), q)).cast("long")
    for _ in range(n - 1):
        # the state: one row per model, a bounded broadcast; one entity of the model passes it on
        cells = packed.select("model", "w", "pw", "lead").join(F.broadcast(state), "model").select(
            "model", flow(F.col("q")).alias("flow"), "pw", F.when(F.col("lead"), F.struct("rules", "days", "ahead")).alias("state")) \
            .select("model", "flow", F.posexplode("pw").alias("place", "pw"), "state")
        held = F.when(F.col("place") == 0, F.col("state"))
        state = cells.groupBy("model", "place").agg(F.sum(F.col("flow") * F.col("pw")).alias("s"), F.first(held, True).alias("state")) \
            .groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("seen"),
                                  F.first("state", True).alias("state")) \
            .select("model", "state.rules", F.concat("state.days", F.array("seen")).alias("days"), F.col("state.ahead").alias("ahead")) \
            .withColumn("q", _step(F.col("days"), F.col("rules"))).withColumn("ahead", F.concat("ahead", F.array("q")))
    # at most n vectors of k numbers per model: a bounded broadcast
    steps = blocks.select("model", "entity", "w").join(F.broadcast(state.select("model", "ahead")), "model") \
        .select("model", "entity", "w", F.posexplode("ahead").alias("i", "q"))
    return steps.select("model", "entity", F.date_add(F.lit(start), F.col("i")).alias("day"), flow(F.col("q")).alias("flow"))
