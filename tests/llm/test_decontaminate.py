import hashlib
import re

import pytest

from tests.llm.edge import documents, empty, words
from tidewater.llm.decontaminate import decontaminated, decontamination_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {65 + i: 97 + i for i in range(26)}


def expected(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        if item is not None and w:
            for s in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit.update(range(s, s + n))
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


ITEMS = [(1, words(60, 2)), (2, words(60, 2).upper()), (3, "Word"), (4, "a wicked"), (5, None), (6, "..."), (None, words(60, 2)), (7, "é" * 500 + words(3, 6)), (10, "never seen anywhere in these texts at all, not one of these words, no")]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:2], []])
def test_report_equals_brute_force(spark, items):
    docs = documents(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination_report(docs, benchmark).collect())
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = documents(spark)
    kept = decontaminated(docs, spark.createDataFrame(ITEMS[:2], "item_id long, text string"))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 15 not in ids and 10 not in ids and {1, 2, 5, 6, 14} <= ids


def test_empty_table(spark):
    assert decontamination_report(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
