from collections import Counter, defaultdict

import pytest
from fixtures import document_rows, documents

from tabwright.llm.line_dedup import boilerplate, line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string, host string"


def pages():
    rows = [(i, f"Menu\nunique {i}\n  Menu  \n\nFooter {i % 4}", f"src{i % 2}", "x", "y") for i in range(60)]
    rows += [(100 + i, "Menu\nMenu", "src0", None, None) for i in range(3)] + [(200, None, "src0", None, None), (201, "", "src1", None, None)]
    rows += [(300 + i, "Null host line\nmore", None, None, None) for i in range(6)] + [(400, "Menu\nonly page", "lonely", None, None)]
    return rows + [rows[0], (None, "Menu\nno id", "src1", None, None)]


def slow(rows, ratio, min_pages):
    hosts, total = defaultdict(Counter), Counter(r[2] for r in rows)
    for r in rows:
        hosts[r[2]].update({x.strip(" ") for x in (r[1] or "").split("\n")} - {""})
    bad = {h: {x for x, n in c.items() if n >= min_pages and n > ratio * total[h]} for h, c in hosts.items()}
    out = Counter()
    for key, text, host, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad[host]]
        if not any(x.strip(" ") for x in kept):
            kept, new = lines, text
        else:
            new = "\n".join(kept) if len(kept) < len(lines) else text
        out[key, new, 0 if text is None else len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("limit", [200_000, 0])  # broadcast, and the join that shuffles
@pytest.mark.parametrize("ratio", [0.05, 0.3])
def test_matches_brute_force(spark, ratio, limit):
    got = line_dedup(spark.createDataFrame(pages(), SCHEMA), "source", "text", ratio, 5, broadcast_lines=limit).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == slow(pages(), ratio, 5)
    assert sum(r["n_dropped"] for r in got) > 60 and {r["host"] for r in got} == {"y", None}


def test_whole_boilerplate_pages_stay(spark):
    got = line_dedup(spark.createDataFrame(pages(), SCHEMA)).where("doc_id between 100 and 102").collect()
    assert {r["text"] for r in got} == {"Menu\nMenu"}


def test_shared_fixture_and_empty_table(spark):
    rows = document_rows()
    got = line_dedup(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == slow([(r[0], r[1], r[3]) for r in rows], 0.05, 5)
    assert line_dedup(documents(spark, [])).count() == 0 and boilerplate(documents(spark, [])).count() == 0
