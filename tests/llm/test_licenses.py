import textwrap

import pytest

from metrolens.llm import licenses
from tests.llm.helpers import docs_df

MIT = dict(licenses.LICENSE_TEXTS)["MIT"]


def scan(spark, rows):
    return {r["doc_id"]: r for r in licenses.license_scan(spark, docs_df(spark, rows)).collect()}


@pytest.mark.parametrize("name,text", licenses.LICENSE_TEXTS, ids=[n for n, _ in licenses.LICENSE_TEXTS])
def test_variants_of_a_text(spark, name, text):
    wrapped = "\n".join(textwrap.wrap(text, 60))
    rows = [(1, text), (2, f"Copyright (c) 2020 A. Holder\nCopyright 2021 B\n\n{wrapped}\n"), (3, text.upper()),
            (4, text.replace("sublicense", "sub-licence").replace("acknowledgment", "acknowledgement")),
            (5, text + " extra"), (6, text[:-20]), (7, f"© 2020 X. All rights reserved.\n{wrapped}")]
    got = scan(spark, rows)
    assert [got[i]["license_id"] for i in range(1, 8)] == [name] * 4 + [None, None, name]


def test_notices(spark):
    rows = [(1, "some text\nLicensed under the Apache License, Version 2.0.\nmore\nReleased under the MIT License."),
            (2, "  * licensed under cc by-nc 4.0  \n"), (3, "This work is licenced under the GNU General Public License, version 3."),
            (4, "He said: Released under the MIT License. And more."), (5, None), (6, ""), (None, MIT), (1, "other")]
    rows_out = licenses.license_scan(spark, docs_df(spark, rows)).collect()
    assert len(rows_out) == len(rows)
    got = {(r["doc_id"], r["notice_ids"], r["n_notices"], r["license_id"]) for r in rows_out}
    assert got == {(1, "Apache-2.0,MIT", 2, None), (2, "CC-BY-NC-4.0", 1, None), (3, "GPL-3.0", 1, None), (4, "", 0, None),
                   (5, "", 0, None), (6, "", 0, None), (None, "", 0, "MIT"), (1, "", 0, None)}


def test_usual_forms(spark):
    texts = dict(licenses.LICENSE_TEXTS)
    bullets, letters = texts["BSD-3-Clause"], texts["BSD-2-Clause"]
    for n, letter in ((1, "(a)"), (2, "(b)"), (3, "(c)")):
        bullets, letters = bullets.replace(f" {n}. ", "\n * "), letters.replace(f" {n}. ", f"\n {letter} ")
    forms = [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n{MIT}"), ("BSD-3-Clause", bullets), ("BSD-2-Clause", letters)]
    forms += [(name, "    " + text.replace("\n", "\n    ").upper()) for name, text in licenses.long_texts()]
    forms += [(name, text.replace("\n", "\r\n")) for name, text in licenses.long_texts()]
    got = scan(spark, [(i, text) for i, (_, text) in enumerate(forms)] + [(900, licenses.long_texts()[0][1] + "more")])
    assert {i: got[i]["license_id"] for i in got} == {i: name for i, (name, _) in enumerate(forms)} | {900: None}


def test_tags_and_own_notices(spark):
    rows = [(1, "# SPDX-License-Identifier: GPL-2.0-or-later\nimport x"), (2, "/* SPDX-License-Identifier: MIT */"),
            (3, "a\nAll of this is in the public domain.\nb")]
    assert {i: r["notice_ids"] for i, r in scan(spark, rows).items()} == {1: "GPL-2.0", 2: "MIT", 3: ""}
    own = licenses.license_scan(spark, docs_df(spark, rows), notices=[("PD", "all of this is in the public domain")])
    assert {r["doc_id"]: r["notice_ids"] for r in own.collect()} == {1: "", 2: "", 3: "PD"}


def test_known_digests_are_distinct(spark):
    table = licenses.digests(spark, licenses.known_texts(), "license_id")
    assert table.count() == len(licenses.known_texts())


def test_no_python_on_the_main_path(spark):
    plan = licenses.license_scan(spark, docs_df(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert licenses.license_scan(spark, docs_df(spark, [(1, "a")]).limit(0)).count() == 0
