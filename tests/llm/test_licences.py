import os
from collections import Counter

import pytest
from fixtures import document_rows, documents

from tabwright.llm.licences import DIGESTS, END_OF_TERMS, ISC, MIT, PUNCTUATION, canonical, digests_of, known_texts, scan_licences, with_lines


def test_spellings_of_one_licence_meet(spark):
    loud = "Copyright (c) 2019, Somebody & Co.\nAll rights reserved.\n\n" + MIT.upper().replace("SUBLICENSE", "SUB-LICENCE").replace("\n", "\r\n")
    curly = MIT.replace('"Software"', "“Software”").replace("copyright holders", "copyright owners").replace(", ", " , ")
    rows = [(1, loud), (2, curly), (3, ISC + "\n"), (4, MIT + " and more"), (5, None), (6, ""), (7, "...!"), (8, "Licensed under the Apache Licence version 2.0"),
            (9, "Some text.\nreleased under the MIT license\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, MIT), (10, "é " + MIT), (1, loud),
            (11, "All rights reserved."), (12, "copyright notice and nothing else")]
    got = Counter((r["doc_id"], r["licence"], tuple(r["notices"])) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "MIT", ()), (1, "MIT", ()), (2, "MIT", ()), (3, "ISC", ()), (4, None, ()), (5, None, ()), (6, None, ()), (7, None, ()),
                           (8, "Apache-2.0", ("Apache-2.0",)), (9, None, ("CC-BY-NC-4.0", "MIT")), (None, "MIT", ()), (10, None, ()), (11, None, ()), (12, None, ())])


def test_every_known_text_finds_itself(spark):
    from pyspark.sql import functions as F
    known = known_texts()
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known)], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"] for r in scan_licences(table).collect()}
    assert found == {i: name for i, (name, _) in enumerate(known)}
    assert with_lines(table).select(canonical(F.col("lines")).alias("c")).where("c = ''").count() == 0


def test_own_digests_clashing_columns_and_empty_tables(spark):
    from tabwright.llm.licences import known_digests
    known = known_digests(spark, [("Own", "one"), ("Own-2", "a")])
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in scan_licences(documents(spark, document_rows()), known=known).collect()}
    assert sum(v[0] == "Own" for v in got.values()) == 1 and sum("Own-2" in v[1] for v in got.values()) == 1
    assert scan_licences(documents(spark, [])).count() == 0


def test_a_licence_sentence_behind_a_copyright_statement_stays(spark):
    rows = [(1, "Copyright 2020 X. Released under the MIT License."), (2, "This project is released under the Apache License 2.0"),
            (3, "Licensed under the BSD 3-Clause License. See LICENSE."), (4, "Prose before.\n(c) 2019 A. B., all rights reserved. This software is licensed under GPLv3."),
            (5, "Copyright (c) 2021 Licensed Goods Inc.\n" + MIT), (6, "© 2020 X. Licensed under terms nobody knows")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: ("Apache-2.0", ["Apache-2.0"]), 3: ("BSD-3-Clause", ["BSD-3-Clause"]), 4: (None, ["GPL-3.0"]), 5: ("MIT", []),
                   6: (None, [])}


def test_lines_joined_are_the_canonical_text(spark):
    from pyspark.sql import functions as F
    texts = [t for _, t in known_texts()[:60]] + [r[1] or "" for r in document_rows()]
    texts += ["a\n\n -- \n b\r\nCopyright 2020 X\n(c) You must\n© y\nall  rights reserved\nsub-\nlicensed sub licensed", "\n", "one line"]
    table = with_lines(spark.createDataFrame([(t,) for t in texts], "text string"))
    lines = F.col("lines")
    odd = table.filter(canonical(lines) != F.trim(F.regexp_replace(F.array_join(lines, "\n"), PUNCTUATION.replace("\\n", ""), " ")))
    assert odd.count() == 0 and table.filter(F.exists(lines, lambda x: (x == "") | (x != F.trim(x)))).count() == 0


FOLDER = "/usr/share/common-licenses"
PUBLISHED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
             "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no published texts on this machine")
def test_published_texts_are_found_whole(spark):
    rows, want = [], {}
    for i, (name, licence) in enumerate(sorted(PUBLISHED.items())):
        with open(os.path.join(FOLDER, name), encoding="utf-8") as f:
            text = f.read()
        forms = [text, text.upper().replace("\n", "\r\n"), text.replace(" ", "  ").replace(",", " ,"), text.split(END_OF_TERMS)[0] if END_OF_TERMS in text else text]
        for k, form in enumerate([*forms, text + "x", text[:-200]]):
            rows.append((10 * i + k, form))
            want[10 * i + k] = licence if k < len(forms) else None
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in scan_licences(table).collect()} == want
    listed = {tuple(r) for r in digests_of(spark.createDataFrame([(PUBLISHED[n], rows[6 * i][1]) for i, n in enumerate(sorted(PUBLISHED))], "licence string, text string")).collect()}
    assert listed <= set(DIGESTS)
