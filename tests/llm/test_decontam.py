import random
import textwrap
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from metrolens.llm import decontam
from metrolens.llm.common import slices
from tests.llm.helpers import docs_df, prose


def edit_distance_inside(piece: bytes, text: bytes) -> int:
    """Least edits of ``piece`` against any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(piece, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcxyz")
        elif kind == 1:
            out.insert(at, rng.choice("abcxyz"))
        else:
            del out[at]
    return "".join(out)


def fixture():
    rng = random.Random(1)
    letters = lambda n: " ".join("".join(rng.choices("aeioustrnlé", k=rng.randint(2, 9))) for _ in range(n))
    items = [(i, letters(n)) for i, n in enumerate((8, 9, 12, 20, 40, 60))] + [(90, "too short"), (91, None), (92, ""), (None, letters(20))]
    rows = []
    for i in range(60):
        text = items[rng.randrange(6)][1]
        rows.append((i, f"{letters(rng.randrange(40))} {edited(rng, text, rng.randrange(0, 14))}\n{letters(rng.randrange(40))}"))
    rows += [(100 + i, letters(80)) for i in range(20)]
    rows += [(200, items[3][1].upper().replace(" ", "\n")), (201, None), (202, ""), (203, items[4][1]), (203, items[4][1]),
             (None, items[2][1]), (204, items[-1][1])]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = fixture()
    cut = decontam.pieces(spark.createDataFrame(items, "item_id long, text string")).collect()
    got = decontam.occurrences(spark, docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=7).collect()
    want = set()
    for i, text in rows:
        plain = (text or "").encode().translate(decontam._PLAIN)
        for p in cut:
            if edit_distance_inside(bytes(p["bytes"]), plain) <= decontam.budget(len(p["bytes"])):
                want.add((i, p["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {i for i, _ in want} >= {200, 203, 204, None} and not {i for i, _ in want if i is not None and 100 <= i < 200}
    texts = {i: t for i, t in rows}
    pieces = {(p["item_id"], len(p["bytes"])): bytes(p["bytes"]) for p in cut}
    assert pieces
    for r in got:
        plain = texts[r["doc_id"]].encode().translate(decontam._PLAIN)
        lengths = {n for item, n in pieces if item == r["item_id"]}
        assert (r["end"] - r["start"]) <= max(lengths) and r["end"] <= len(plain)


def test_every_edit_budget_is_found():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(decontam.SHORTEST, decontam.PIECE + 1)
        piece = "".join(rng.choices("abcdefgh", k=n))
        text = prose(rng, 10) + edited(rng, piece, decontam.budget(n)) + prose(rng, 10)
        if edit_distance_inside(piece.encode(), text.encode()) <= decontam.budget(n):
            hit = decontam.search(decontam.Index([piece.encode()]), pa.array([prose(rng, 5), text, None, ""]))
            assert set(hit["row"]) == {1}


def test_bound_is_positive():
    for n in range(decontam.SHORTEST, decontam.PIECE + 1):
        assert decontam.shared_bound(n) >= decontam.LEAST_SHARED and decontam.budget(n) < decontam.BAND


def test_clean_keeps_whole_rows(spark):
    rows, items = fixture()
    df, bench = docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    bad = {r["doc_id"] for r in decontam.contaminated(spark, df, bench).collect()}
    left = decontam.clean(spark, df, bench, block=5)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in bad)


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_empty(spark, which):
    rows, items = fixture()
    df, bench = docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    df = df.limit(0) if which != "items" else df
    bench = bench.limit(0) if which != "docs" else bench
    assert decontam.contaminated(spark, df, bench).count() == 0
    assert decontam.clean(spark, df, bench).count() == df.count()


def test_periodic_texts():
    text = ("ab " * 4000)
    hit = decontam.search(decontam.Index([("ab " * 20).strip().encode(), b"x" * 60]), pa.array([text, "x" * 500, "y" * 500]))
    assert set(zip(hit["row"].tolist(), hit["piece"].tolist())) == {(0, 0), (1, 1)} and (hit["edits"] == 0).any()
    assert np.all(hit["end"] > hit["start"])


def test_layout_costs_no_edits(spark):
    rng = random.Random(3)
    items = [(i, ". ".join(prose(rng, 9) for _ in range(n))) for i, n in enumerate((1, 2, 4, 8))]
    layouts = [lambda t: t, str.upper, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\r\n"),
               lambda t: "\r\n        ".join(textwrap.wrap(t, 60)), lambda t: t.replace(" ", " \t-- ")]
    rows, want = [], {}
    for i, text in items:
        for layout in layouts:
            shown, before = layout(text), prose(rng, 30) + " é,\n\n "
            at = len(before.encode())
            want[len(rows)] = (i, at, at + len(shown.encode()))
            rows.append((len(rows), before + shown + "\n\n " + prose(rng, 30)))
    got = decontam.contaminated(spark, docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["item_id"], r["start"], r["end"]) for r in got} == want
    assert {r["edits"] for r in got} == {0}


def test_layout_of_an_item(spark):
    rng = random.Random(4)
    text = prose(rng, 30)
    items = [(1, "\r\n    ".join(text.split())), (2, "a; b; c" + " " * 60), (3, "2 + 2 = 4, 3 * 5 = 15, 60 / 4 = 15; 9 - 7 = 2")]
    rows = [(1, text), (2, "a b c"), (3, "so 2 + 2 = 4, 3 * 5 = 15, 60 / 4 = 15; 9 - 7 = 2 it is"), (4, prose(rng, 30))]
    got = decontam.contaminated(spark, docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 3)}


def test_upper_case_beyond_ascii():
    text = "Ğüzel ağaçların gölgesinde çocuklar öğleden sonra şarkı söylüyordu, İstanbul \u212a " + "où l'été était déjà passé " * 2
    hit = decontam.search(decontam.Index([decontam._plain(text.encode())[:decontam.PIECE]]), pa.array(["x " + text.upper().replace("I", "ı")]))
    assert set(hit["row"]) == {0}
    for t in (text, text.upper(), "ΟΔΟΣ ΣΑΣ", "\u1e9e Ⱥ Å"):
        assert len(decontam._plain(t.encode())) == len(t.encode())
    assert decontam._plain(b"\xff A\xc3\x89") == b"\xff a\xc3\xa9"


def test_documents_that_share_an_id(spark):
    rng = random.Random(5)
    item = prose(rng, 30)
    before = ["", "one two three ", "é " * 9]
    rows = [(8, before[0] + item), (8, before[1] + item), (8, before[1] + item), (None, before[2] + item), (None, before[0] + item)]
    got = decontam.contaminated(spark, docs_df(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    n = len(item.encode())
    places = {len(b.encode()) for b in before}
    assert len(got) == 4 and {(r["doc_id"], r["start"]) for r in got} == {(8, 0), (8, len(before[1])), (None, len(before[2].encode())), (None, 0)}
    assert all(r["end"] - r["start"] == n and r["start"] in places for r in got)
    assert {r["n_pieces"] for r in got} == {decontam.pieces(spark.createDataFrame([(1, item)], "item_id long, text string")).count()}


def test_counting_part_by_part_changes_nothing(monkeypatch):
    rng = random.Random(6)
    index = decontam.Index([b"a" * 80, b"ab " * 20, prose(rng, 14).encode()[:80]])
    text = "a" * 3000 + " ab" * 900 + prose(rng, 50)
    buf = np.frombuffer(decontam._plain(text.encode()), np.uint8)
    whole = index.regions(buf)
    for size in (1, 100, 5000):
        monkeypatch.setattr(decontam, "_POSTINGS", size)
        assert all((x == y).all() for x, y in zip(whole, index.regions(buf)))
    assert len(whole[0])


@pytest.mark.parametrize("texts, times", [(1, 12), (1500, 8)])
def test_memory_of_a_search_is_bounded(texts, times):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    item = some(30)[:decontam.PIECE - 1] + "x"
    rows = [some(450_000 // texts) for _ in range(texts)]
    before = rows[-1] + ",  \n"
    rows[-1] = before + item + " " + some(10)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows)})
    index, found, peak = decontam.Index([item.encode()]), [], 0
    for part in slices([batch]):
        tracemalloc.start()
        hit = decontam.search(index, part.column("text"))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found += [(part.column("text")[r].as_py() == rows[-1], s, e) for r, s, e in zip(hit["row"].tolist(), hit["start"].tolist(), hit["end"].tolist())]
    assert set(found) == {(True, len(before), len(before) + len(item))}
    assert peak < times * batch.column("text").nbytes
