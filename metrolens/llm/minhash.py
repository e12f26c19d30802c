"""Near-duplicate groups by SuperMinHash (operator 2).

1. Equal shingle sets form one class each, named by its smallest doc_id, so
   exact copies never meet in a bucket.
2. Every class gets a SuperMinHash signature: each shingle draws its own
   permutation of the signature's places together with a random fraction, and
   a place keeps the least rank + fraction. Ranks of one shingle are all
   different, which lowers the variance; a set stops as soon as the next rank
   exceeds everything its signature holds.
3. Bands of the signature are bucket keys. Each member of a bucket is paired
   with the bucket's smallest member - never all with all - and verified by
   the exact Jaccard similarity of the full sets.
4. Verified links are grouped by union-find (:mod:`components`).
5. Buckets that still hold several groups are completed: members of different
   groups are compared by signature, in blocks; those whose estimate is not
   far below the threshold form neighbourhoods, within which such pairs are
   verified on their full sets, again in blocks. Tasks give spanning forests,
   never all pairs. After that every pair that shares a bucket is known to be
   linked, in one group already, or different.

``band_plan`` picks the bands so that a pair at the threshold misses every
bucket with a probability below 1e-5.

Rows without words are linked with nothing. Rows that share a doc_id count as
one document. Rows without doc_id are described but not linked: component_id
is null and they are kept. Repeated rows, ties and empty tables are fine;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import binary_rows, map_arrow, map_sorted_groups, narrowed, stored
from metrolens.llm.components import Forest, components
from metrolens.llm.text import Words, mix64, shingles

PLACES = 100           # signature length
ESTIMATE_SLACK = 0.2   # over 5 standard deviations of an estimate from 100 places
BLOCK = 1000           # signatures of one side of a block comparison
SET_BLOCK = 256        # sets of one side of an exact block comparison,
SET_SHINGLES = 1 << 20  # and about the shingles they hold together
_CHUNK = 200_000       # shingles whose permutations are held at once
_UNSET = np.uint64(2**64 - 1)


def band_plan(percent: int, places: int = PLACES, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have so that all bands of a
    pair at the threshold differ with a probability below ``miss``."""
    for rows in range(8, 0, -1):
        bands = places // rows
        if (1 - (percent / 100) ** rows) ** bands < miss:
            return bands, rows
    return places, 1


def superminhash(hashes: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """(sets, places) signatures of the sets ``hashes[offsets[i]:offsets[i + 1]]``.

    Round j gives every shingle of the live sets its j-th place by one step of
    its Fisher-Yates shuffle; the value is (j, 32 random bits) in one integer.
    """
    n = len(offsets) - 1
    out = np.full((n, places), _UNSET, np.uint64)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _CHUNK, "right")) - 1)
        part = hashes[offsets[start]:offsets[stop]]
        for at in range(0, len(part), _CHUNK):        # one very long set goes in pieces: minima merge
            owner = np.repeat(np.arange(start, stop), np.diff(offsets[start:stop + 1]))[at:at + _CHUNK]
            _fill(out, part[at:at + _CHUNK], owner, places)
        start = stop
    return out


def _fill(out: np.ndarray, h: np.ndarray, owner: np.ndarray, places: int) -> None:
    flat = out.reshape(-1)
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(h), 1))
    for j in range(places):
        if not len(h):
            return
        draw = mix64(h + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        k = j + ((draw >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(h))
        place = order[rows, k]
        order[rows, k] = order[:, j]
        value = np.uint64(j << 32) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner * places + place, value)
        ids = np.unique(owner)
        live = ids[out[ids].max(axis=1) >= np.uint64((j + 1) << 32)]
        if len(live) < len(ids):
            keep = np.isin(owner, live)
            h, owner, order = h[keep], owner[keep], order[keep]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key + signature[:, b * rows + r])
        keys[:, b] = key
    return keys.view(np.int64)


def set_digest(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    import hashlib
    return [hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else None
            for a, b in zip(offsets[:-1], offsets[1:])]


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)),
                                    type=pa.list_(pa.field("element", pa.int64())))


def sketches(docs: DataFrame, n: int, bands: int, rows: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: set size, digest of the set, folded signature and band keys."""

    def run(part):
        h, offsets = shingles(Words(part.column("text"), lower=True), n)
        signature = superminhash(h, offsets)
        keys = band_keys(signature, bands, rows)
        folded = (mix64(signature) & np.uint64(0xFF)).astype(np.uint8)
        return {"n_shingles": np.diff(offsets), "digest": set_digest(h, offsets),
                "signature": [f.tobytes() for f in folded],
                "bands": _list_array(keys.reshape(-1), np.arange(len(keys) + 1) * bands)}

    return map_arrow(docs.select(*keep, "text"), run,
                     "n_shingles long, digest binary, signature binary, bands array<long>", keep=keep)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of each row of ``docs`` (node, text)."""

    def run(part):
        h, offsets = shingles(Words(part.column("text"), lower=True), n)
        return {"shingles": _list_array(h, offsets)}

    return map_arrow(docs, run, "shingles array<long>", keep=("node",))


def verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, exactly. Both joins are
    on plain tables, so a hot node's rows are split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b").where(100 * small >= percent * large)
            .where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def near_groups(spark: SparkSession, nodes: DataFrame, fetch, percent: int,
                slack: float = ESTIMATE_SLACK) -> DataFrame:
    """Groups among ``nodes`` (node, signature, bands; one row per set):
    (node, component) as :func:`components`. ``fetch(wanted)`` gives
    (node, shingles) for a table of wanted nodes; ``slack`` is how far below
    the threshold a signature's estimate may lie."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")) \
        .where("head <> last").select("key", "head")
    members = stored(spark, keyed.join(buckets, "key"), "bucket-members")
    pairs = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    pairs = stored(spark, pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(spark, wanted, "wanted")
    sets = stored(spark, fetch(wanted), "sets")
    first = components(spark, verified(spark, pairs, sets, percent))
    close = components(spark, across_groups(members, nodes, first, percent / 100 - slack))
    if close.isEmpty():
        return first
    close = close.union(close.select("component", "component").distinct())
    need = stored(spark, close.select("node").distinct(), "wanted-across")
    more = stored(spark, fetch(need.join(sets.select("node"), "node", "left_anti")), "sets-across")
    links = exact_links(close, first, nodes, sets.union(more), percent, percent / 100 - slack)
    return components(spark, links.union(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def across_groups(members: DataFrame, nodes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect all members of a bucket which are in different
    groups and whose signatures agree in ``least`` of their places. A bucket's
    largest group needs no comparison within itself: it forms the right side
    only, the others both sides. Sides are cut in blocks of about ``BLOCK``
    members, a task compares one pair of blocks and gives a spanning forest of
    what it finds, so the output never has all pairs."""
    named = members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("g"))
    sizes = named.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("key").agg(F.max(F.struct("n", "g")).alias("top"), F.sum("n").alias("total"),
                                      F.count(F.lit(1)).alias("groups"))
             .where("groups > 1").select(F.col("key"), F.col("top.g").alias("main"),
                                         F.ceil(F.col("top.n") / BLOCK).cast("int").alias("nm"),
                                         F.ceil((F.col("total") - F.col("top.n")) / BLOCK).cast("int").alias("no")))
    rows = named.join(mixed, "key").join(nodes.select("node", "signature"), "node")
    is_main = F.col("g") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("node"), "nm")).otherwise(F.pmod(F.xxhash64("node"), "no")).cast("int")
    rows = rows.select("key", "node", "g", "signature", is_main.alias("is_main"), own.alias("own"), "nm", "no")
    left = rows.where("NOT is_main").select(
        "key", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") + F.col("no") - 1)).alias("j"),
        F.lit(True).alias("is_left"), "node", "g", "signature")
    right = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("i"),
        F.when(F.col("is_main"), F.col("own")).otherwise(F.col("nm") + F.col("own")).alias("j"),
        F.lit(False).alias("is_left"), "node", "g", "signature")

    def compare(batch, bounds):
        is_left = batch.column("is_left").to_numpy(zero_copy_only=False)
        node, g = batch.column("node").to_numpy(), batch.column("g").to_numpy()
        sig, found = binary_rows(batch.column("signature")), []
        enough = least * sig.shape[1]
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = start + np.flatnonzero(~is_left[start:stop])
            forest, right, own = Forest(), sig[at], g[at]
            for x in (start + np.flatnonzero(is_left[start:stop])).tolist():
                close = at[((right == sig[x]).sum(axis=1) >= enough) & (own != g[x])]
                for y in close.tolist():
                    if forest.join(int(node[x]), int(node[y])):
                        found.append((node[x], node[y]))
        return _pairs(found)

    return map_sorted_groups(left.union(right), ["key", "i", "j"], compare, "a long, b long")


def exact_links(close: DataFrame, groups: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int,
                least: float) -> DataFrame:
    """Links (a, b) that connect what the threshold connects among the members
    of each neighbourhood ``close`` (node, component): pairs of different
    groups whose signatures allow it are verified on their full sets. Large
    neighbourhoods are cut in blocks, by the number of sets and by their
    shingles, so that very long texts make more and smaller blocks; a task
    holds two blocks and gives a spanning forest."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / SET_BLOCK, F.sum(F.size("shingles")) / SET_SHINGLES))
    size = close.join(sets, "node").groupBy("component").agg(blocks.cast("int").alias("blocks"))
    rows = (close.join(size, "component").join(groups.withColumnRenamed("component", "g"), "node", "left")
            .join(nodes.select("node", "signature"), "node").join(sets, "node")
            .select("component", "node", F.coalesce("g", "node").alias("g"), "signature", "shingles",
                    F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"),
                    F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") <= F.col("other")).alias("is_left"), "node", "g", "signature", "shingles")

    def verify(batch, bounds):
        node, g, sig = batch.column("node").to_numpy(), batch.column("g").to_numpy(), binary_rows(batch.column("signature"))
        lists = batch.column("shingles")
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy()
        is_left = batch.column("is_left").to_numpy(zero_copy_only=False)
        enough, found = least * sig.shape[1], []
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            _, ids = np.unique(flat[edge[start]:edge[stop]], return_inverse=True)
            ids_of = lambda x: ids[edge[x] - edge[start]:edge[x + 1] - edge[start]]  # noqa: E731, B023
            mark = np.zeros(len(ids) + 1, bool)
            left = start + np.flatnonzero(is_left[start:stop])
            right = start + np.flatnonzero(~is_left[start:stop])
            right = right if len(right) else left
            forest, near = Forest(), sig[right]
            for x in range(start, stop):
                forest.join(int(g[x]), int(node[x]))
            for x in left.tolist():
                own = forest.find(int(node[x]))
                close = [y for y in right[(near == sig[x]).sum(axis=1) >= enough].tolist() if forest.find(int(node[y])) != own]
                if not close:
                    continue
                mark[ids_of(x)] = True
                for y in close:
                    common = int(mark[ids_of(y)].sum())
                    union = edge[x + 1] - edge[x] + edge[y + 1] - edge[y] - common
                    if 100 * common >= percent * union and forest.join(int(node[x]), int(node[y])):
                        found.append((node[x], node[y]))
                mark[ids_of(x)] = False
        return _pairs(found)

    return map_sorted_groups(rows, ["component", "i", "j"], verify, "a long, b long")


def _pairs(found: list) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per row of ``docs``."""
    bands, rows = band_plan(percent)
    rows_ = stored(spark, sketches(docs, n, bands, rows), "sketches")
    named = rows_.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(spark, named.groupBy("digest").agg(
        F.min(F.struct("doc_id", "signature", "bands")).alias("c")).select(
        "digest", F.col("c.doc_id").alias("node"), F.col("c.signature").alias("signature"),
        F.col("c.bands").alias("bands")), "classes")

    def fetch(wanted):
        ids = stored(spark, wanted.withColumnRenamed("node", "doc_id"), "wanted-ids")
        few = narrowed(docs.select("doc_id", "text"), ids, "doc_id").join(ids, "doc_id", "left_semi")
        return shingle_sets(few.withColumnRenamed("doc_id", "node"), n)

    groups = near_groups(spark, classes.select("node", "signature", "bands"), fetch, percent)
    member = rows_.drop("signature", "bands").join(classes.select("digest", "node"), "digest", "left")
    member = stored(spark, member, "members")
    # Rows that share a doc_id but not their words tie their classes together.
    ids = member.where("node IS NOT NULL AND doc_id IS NOT NULL")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("m")).where("m <> b")
    ties = ids.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    if not ties.isEmpty():
        groups = components(spark, ties.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = member.join(groups, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group with all its columns, the one with the
    smallest doc_id. Documents are told apart by doc_id and text, so texts that
    share a doc_id are grouped each on its own and may both stay. Of rows equal
    in doc_id and text the one with the least hash of its columns stays. Rows
    without doc_id stay."""
    key = ["doc_id", "_version", "_row"]
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]    # maps have no hash
    named = docs.where("doc_id IS NOT NULL").select(
        "doc_id", "text", F.xxhash64("text").alias("_version"), F.xxhash64(*hashed).alias("_row"), F.struct(*docs.columns).alias("_whole"))
    bands, rows = band_plan(percent)
    rows_ = stored(spark, sketches(named, n, bands, rows, keep=tuple(key)), "sketches")
    alone = rows_.where("digest IS NULL").groupBy("doc_id", "_version").agg(F.min("_row").alias("_row"))
    # One class per shingle set; its number is fixed once it is written.
    classes = rows_.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(*key, "signature", "bands")).alias("c"))
    classes = stored(spark, classes.select(F.monotonically_increasing_id().alias("node"), "c.*"), "classes")

    def fetch(wanted):
        places = stored(spark, classes.select(*key, "node").join(wanted, "node"), "wanted-documents")
        few = narrowed(named.select(*key, "text"), places.select("doc_id"), "doc_id")
        return shingle_sets(few.join(places, key).dropDuplicates(["node"]).select("node", "text"), n)

    groups = near_groups(spark, classes.select("node", "signature", "bands"), fetch, percent)
    first = classes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")) \
        .agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    kept = stored(spark, first.union(alone.select(*key)), "kept-documents")
    if not rows_.groupBy(*key).count().where("count > 1").isEmpty():
        named = named.dropDuplicates(key)          # equal rows meet before whole texts are shuffled
    return docs.where("doc_id IS NULL").unionByName(named.join(kept, key, "left_semi").select("_whole.*"))
