"""HTML, licences, mixing, toxicity and the pipeline."""

import itertools
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edge import documents, empty, words
from tidewater.llm.html_text import extract_pages, page_text
from tidewater.llm.license_texts import SENTENCES, TEXTS
from tidewater.llm.licenses import SENTENCE, WORD, own_licenses, passages, pieces, scan_licenses, versions
from tidewater.llm.mixing import BLOCK_ROWS, mixed, period_slots, phases, schedule
from tidewater.llm.toxicity import ToxicField, _Chain, _marked_transitions, _padded, fit, score_documents, toxicity_digest, without_toxic

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<h1>A&amp;B</h1><p>one<p>two <b>bold</b>  x<br>y", "A&B\n\none\n\ntwo bold x\ny"),
        ("<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul>z", "- a\n- b\n  3. c\n  4. d\n\nz"),
        ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n          value\nlong name  1"),
        ("<table><td>a<td>b<tbody><tr><td colspan=2>wide<td>c</table>", "a     b\nwide     c"),
        ("<div style='color:red; display:none'>no</div><p hidden>no</p><span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
        ("<head><title>t</title><style>p{}</style></head><script>var a='</p><b>';</script>x<!-- c --><!DOCTYPE html>y<noscript>n</noscript>", "xy"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("<p title='hidden'>a</p></div></b>b <dl><dt>k<dd>v</dl>", "a\n\nb\n\nk\n  v"),
        ("", ""),
        ("a < b &lt; c <", "a < b < c <"),
        ("<div>" * 5000 + "deep", "deep"),
        (None, None),
    ],
)
def test_page_text(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><annotation>tex</annotation></math> holds", "so x=1y holds"),
        ("a<svg><title/><style>s{}</style><defs><text>no</text></defs>loose<g visibility='visible'><text x='1'>one <tspan>two</tspan></text><text style='display:none'>no</text><text>three</text></g></svg>b", "a\none two\nthree\nb"),
        ("<svg><foreignObject><p>html</p></foreignObject><desc>no</desc></svg>", "html"),
        ("pick <select>x<option>red<option selected>green &amp; blue<optgroup label='Dark'><option label='black'>no</select> now", "pick\nred\ngreen & blue\nDark\nblack\nnow"),
        ("<canvas>no</canvas><datalist><option>no</datalist><video>no</video><select hidden><option>no</select>yes", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  b  c\n   d  e\nf  g  h"),
        ("<table><tr><td>a<td ROWSPAN='3' COLSPAN='2'>bb<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i</table>", "a  bb    c\nd        e\nf        g\nh  i"),
        ("<table><thead><tr><th rowspan=0>k<th>v<tr><th>w</thead><tbody><tr><td>1<td>2</table>", "k  v\n   w\n1  2"),
        ("<table><tr><td rowspan=2>a<td><table><tr><td>x<td>y<tr><td>z</table><tr><td>b</table>", "a  x  y\n   z\n   b"),
    ],
)
def test_visible_parts_and_row_spans(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize("part", ["<a '", "<a ", "<div>", "</p>", "<p>", "<li>", "<td>", "<table>", "<!--", "<!", "<script>", "<b><table>", "< ", "<td colspan=1000 rowspan=9999>a<tr>", "<svg><text>a", "<select><option>a", "&amp", "<textarea>", "<ul><li>"])
def test_long_pages_take_time_in_proportion(part):
    def seconds(n):
        began = time.process_time()
        page_text(part * n + "<div></p>" * 1000)
        return time.process_time() - began

    assert seconds(20_000) < 12 * max(seconds(5000), 0.05)


def test_cells_are_padded_within_bounds():
    wide = "<table><tr><td>" + "x" * 20_000 + "".join(f"<tr><td>{k}<td>v" for k in range(2000)) + "</table>"
    assert len(page_text(wide)) < 4 * len(wide)
    tall = "<table><tr>" + "<td>a" * 900 + "<td>" + "b<br>" * 5000 + "</table>"
    assert len(page_text(tall)) < 4 * len(tall)
    assert page_text("<table><tr><td>ab<td>c<tr><td>d<td>e</table>") == "ab  c\nd   e"
    assert page_text("a < b <3 c<d e") == "a < b <3 c"


def test_pages_with_clashing_columns_and_large_ids(spark):
    rows = spark.createDataFrame([(2**62 + 1, "u", "<p>a", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string").coalesce(1)
    assert {(r["page_id"], r["text"]) for r in extract_pages(rows).collect()} == {(2**62 + 1, "a"), (None, None)}
    assert extract_pages(rows.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, None, None), (None, "u", ""), (2, "u", "x" * 200_000)], "page_id long, url string, html string").withColumnRenamed("url", "url")
    assert sorted((str(r["page_id"]), len(r["text"] or "")) for r in extract_pages(pages).collect()) == [("1", 0), ("1", 1), ("2", 200_000), ("None", 0)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_licenses_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "nothing here"),
        (3, "a/b/NOTICE", "# Licensed under the Apache License, Version 2.0."),
        (4, "a/y.py", None),
        (5, "z/y.py", ""),
        (6, "a/b/own.py", words(200, 3) + ". This work is licensed under the GNU General Public License, version 3. " + words(50, 4)),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, None, "x"),
        (9, "ab/y.py", "license plates and granted wishes are not about a licence"),
        (4, "a/y.py", None),
    ]
    got = sorted((r["doc_id"], r["license"], r["origin"], r["from_directory"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [(1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, "MIT", "inherited", "a"), (4, "MIT", "inherited", "a"), (5, None, None, None), (6, "GPL-3.0", "own", None), (7, "CC-BY-NC-4.0", "own", None), (8, None, None, None), (9, None, None, None)]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_licenses_equal_dense_vectors(spark):
    r = random.Random(11)
    parts = [x for xs in SENTENCES.values() for x in xs] + list(TEXTS.values())
    some = [w for p in parts for w in WORD.findall(p)]
    texts = []
    for _ in range(150):
        text = r.choice(parts).split(" ")
        for _ in range(r.choice((0, 2, 10, 60))):
            text[r.randrange(len(text))] = r.choice((*r.sample(some, 3), "other", "# ", "x.\n", ""))
        texts.append(" ".join(text + words(r.choice((0, 3, 40)), r.randrange(99)).split(" ")))
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(997, None), (998, ""), (999, words(50_000, 12) + ". " + parts[0])], "doc_id long, text string")
    total, seen = 0, Counter()
    for t in [*texts, "", words(50_000, 12) + ". " + parts[0]]:
        for s in SENTENCE.split(t.lower()):
            if s and not s.isspace():
                total += 1
                seen.update(set(WORD.findall(s)))
    known = sorted({w.lower() for w in some})
    idf = np.array([np.log((total + 2) / (seen[w] + 1)) + 0.1 for w in known])

    def dense(text):
        count = Counter(WORD.findall(text.lower()))
        v = np.concatenate([np.array([count[w] for w in known]) * idf, [n * np.log(total + 2) for w, n in count.items() if w not in set(known)]])
        return v[: len(known)] / (np.sqrt((v * v).sum()) or 1)

    def best(text, templates):
        said = versions(text)
        found = [(-round(float(dense(text) @ v), 9), name) for name, v, named in templates if not said or not named or said & named]
        return min((f for f in found if -f[0] >= 0.75), default=None)

    kinds = [[(name, dense(t), versions(t)) for name, ts in kind.items() for t in ts] for kind in ({k: [t] for k, t in TEXTS.items()}, SENTENCES)]

    def expected(text):
        found = [(0, best(p, kinds[0])) for p in passages(text)]
        found += [(1, best(s, kinds[1])) for joined, lines in pieces(text) for s in [joined, *lines]]
        found = [(k, *b) for k, b in found if b]
        return (min(found)[2], -min(found)[1]) if found else (None, None)

    got = {row["doc_id"]: (row["license"], row["cosine"]) for row in own_licenses(files, ["doc_id"]).collect()}
    assert got[997] == got[998] == (None, None) and got[999][0] == "MIT"
    wanted = {i: expected(t) for i, t in enumerate(texts)}
    assert {i: got[i][0] for i in wanted} == {i: w[0] for i, w in wanted.items()}
    assert all(w[1] is None or abs(got[i][1] - w[1]) < 1e-6 for i, w in wanted.items())
    assert 20 < sum(w[0] is not None for w in wanted.values()) < 150


def test_licenses_with_extra_columns(spark):
    files = documents(spark).withColumn("path", F.concat(F.lit("p/"), "doc_id")).withColumns({c: F.lit("x") for c in ("license", "cosine", "share", "folder", "given")})
    assert scan_licenses(files).count() == files.count()
    assert scan_licenses(files.limit(0)).count() == 0


def test_license_versions_and_wrapped_lines(spark):
    gnu = "You can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, version {}."
    rows = [
        ("This library is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        (gnu.format("", "2"), "GPL-2.0"),
        (gnu.format("", "3"), "GPL-3.0"),
        (gnu.format("Lesser ", "2.1"), "LGPL-2.1"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Copyright (c) 2020, A. Person\n\n" + TEXTS["BSD-2-Clause"], "BSD-2-Clause"),
        ("Copyright (c) 2020, A. Person\n\n" + TEXTS["BSD-3-Clause"].replace("the copyright holder", "Some Company"), "BSD-3-Clause"),
        ("\n".join("# " + line for line in TEXTS["GPL-3.0"].splitlines()) + "\n\nimport os\n" + words(300, 9), "GPL-3.0"),
        ("/* Copyright 2021 X\n * " + TEXTS["EPL-2.0"].replace("\n", "\n * ") + "\n */\n" + words(300, 10), "EPL-2.0"),
        (TEXTS["Zlib"].replace(" ", "\n"), "Zlib"),
        ("# Permission is hereby granted, free of\n# charge, to any person obtaining a copy\n# of this software and associated\n# documentation files.\n#\n# x", "MIT"),
        ("/*\n * This program is licensed under the\n * GNU General Public License,\n * version 2.\n */", "GPL-2.0"),
        ("Released under the MIT License\nand then the code goes on with no stop " + words(40, 5), "MIT"),
    ]
    files = spark.createDataFrame([(i, f"d{i}/x.py", t) for i, (t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in scan_licenses(files).collect()}
    assert got == {i: name for i, (_, name) in enumerate(rows)}


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {f"s{i}": i * i + 1 for i in range(12)}])
def test_pfair_deviation_is_under_a_block(weights):
    total, given = sum(weights.values()), Counter()
    for slot, source in enumerate(period_slots(weights), 1):
        given[source] += 1
        assert all(abs(given[s] * total - slot * w) < total for s, w in weights.items())
    assert given == weights


def test_phases_give_every_block_once():
    blocks, weights = {"a": 1000, "b": 7, "c": 0, "d": 33, "e": 12}, {"a": 5, "b": 3, "c": 2, "d": 4, "e": 6}
    given, at = Counter(), 0
    for slot, now, first, after in phases(blocks, weights):
        assert slot == at and all(first[s] == given[s] for s in now)
        for s in now:
            given[s] = after[s]
            at += after[s] - first[s]
    assert given == Counter({k: n for k, n in blocks.items() if n}) and at == sum(blocks.values())


def test_schedule_keeps_all_rows_and_shares(spark):
    rows = [(i, words(3, i), "en", "abc"[min(2, i % 7)], 1) for i in range(2000)]
    got = schedule(documents(spark, rows), {"a": 1.0, "b": 1.0, "c": 2.0}).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    assert len({(r["slot"], r["place"]) for r in got}) == 2000
    slots = sorted({(r["slot"], r["source"]) for r in got})
    assert [s for s, _ in slots] == list(range(len(slots)))
    blocks = defaultdict(set)
    for r in got:
        blocks[r["source"], r["block"]].add(r["slot"])
        assert r["place"] < BLOCK_ROWS
    assert all(len(x) == 1 for x in blocks.values())
    given = Counter()
    for t, (_, s) in enumerate(slots[:70], 1):  # a and b have 18 blocks each
        given[s] += 1
        assert abs(given["c"] - t / 2) < 1 and abs(given["a"] - t / 4) < 1


def test_deviation_from_given_weights_stays_under_a_block(spark):
    """Uneven weights over a long run, past the ends of some sources; the target flow is made anew."""
    rows = {**{f"s{i:02}": 40 + 613 * i for i in range(12)}, "tail": 1}
    weights = {s: n**0.5 for s, n in rows.items()}
    docs = spark.range(sum(rows.values())).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.element_at(F.array(*(F.lit(s) for s in rows)), F.lit(1) + sum((F.col("id") >= n).cast("int") for n in list(accumulate(rows.values()))[:-1])).alias("source"))
    got = schedule(docs, block_rows=1)
    order = [r["source"] for r in got.select("source", "slot").orderBy("slot").collect()]
    assert Counter(order) == rows
    deviations(order, rows, weights)


def deviations(order, blocks, weights):
    """Fails where a source has given a block or more besides its part of the flow."""
    level, given, v, total = {s: blocks[s] / weights[s] for s in blocks}, Counter(), 0.0, sum(weights.values())
    ends = sorted(blocks, key=level.get)
    for source in order:
        step = 1.0
        while ends and (level[ends[0]] - v) * total <= step:
            step -= (level[ends[0]] - v) * total
            v, total = level[ends[0]], total - weights[ends.pop(0)]
        v += step / total if ends else 0
        given[source] += 1
        for s, n in blocks.items():
            assert abs(given[s] - min(weights[s] * v, n)) < 1 + 1e-6, s


def test_thousands_of_sources_keep_to_their_weights():
    blocks = {"hot": 2500, **{f"t{i}": 1 + i % 3 for i in range(2500)}}
    weights = {s: n**0.5 for s, n in blocks.items()}
    whole, given, at = sum(weights.values()), Counter(), 0
    for slot, now, first, after in phases(blocks, weights, 500):
        assert slot == at and first == {s: given[s] for s in first}
        given.update({s: after[s] - first[s] for s in now})
        at = sum(given.values())
        # no source ends in the flow before level 1
        if at <= whole:
            assert all(abs(given[s] - at * w / whole) < 1 for s, w in weights.items())
    assert given == blocks


def test_mixing_edge_cases(spark):
    docs = documents(spark)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert schedule(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity_digest(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    hits = Counter((toxic[r["doc_id"]], r["predicted"]) for r in held)
    assert hits[0, 1] <= 0.02 * sum(n for (t, _), n in hits.items() if t == 0)
    assert hits[1, 1] >= 0.75 * (hits[1, 0] + hits[1, 1])


def test_field_equals_enumeration():
    """Marginals, expected transitions and log Z of short texts against the sum over all taggings."""
    r = np.random.default_rng(9)
    transitions = r.normal(size=(2, 2))
    texts = [(7, [(1, 0.7), (2, -0.4), (5, 1.3)]), (4, [(0, 2.0)]), (5, []), (0, []), (6, [(0, 0.3), (5, -1.0)])]
    z, p, steps = [], [], np.zeros((2, 2))
    for n, evidence in texts:
        weights = dict(evidence)
        total, ones, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            pairs = list(zip((0, *tags), tags, strict=False))
            weight = np.exp(sum(transitions[a] for a in pairs) + sum(weights.get(k, 0.0) for k, t in enumerate(tags) if t))
            total, ones = total + weight, ones + weight * np.array(tags)
            for a in pairs:
                moves[a] += weight
        z.append(np.log(total))
        p.append(ones / total)
        steps += moves / total
    gaps, weights, used, tail = _padded(texts)
    chain = _Chain(transitions)
    got, forward, backward, log_z = chain.marginals(gaps, weights, used, tail)
    assert np.allclose(log_z, z)
    assert all(np.allclose(got[i, : len(e)], [p[i][at] for at, _ in e]) for i, (_, e) in enumerate(texts))
    assert np.allclose(chain.expected(gaps, weights, used, tail, forward, backward, log_z), steps)
    assert _marked_transitions(7, [1, 2, 5]).tolist() == [[2, 2], [2, 1]] and _marked_transitions(3, [0, 1, 2]).tolist() == [[0, 1], [0, 2]]


def test_transitions_are_learned(spark):
    rows = [(i, f"{words(30, i)} {'you wicked fool' if i % 2 else 'you good friend'} {words(20, 99 + i)}", "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1)], "doc_id long, toxic int")
    model = fit(documents(spark, rows), labels)
    assert not np.allclose(model.transitions, ToxicField().transitions, atol=0.2)
    score = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame([(2**62 + 1, "you wicked fool"), (None, "x")], "doc_id long, text string").coalesce(1), model).collect()}
    assert set(score) == {2**62 + 1, None}


def test_toxicity_edge_cases(spark):
    rows = [(i, f"{words(30, i)} {'you wicked fool' if i % 2 else 'you good friend'} {words(20, 99 + i)}", "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = fit(documents(spark, rows), labels)
    got = {r["doc_id"]: r for r in score_documents(documents(spark, [*rows, (900, None, None, None, None), (901, "", None, None, None), (902, "fool " * 20_000, "en", "s", 1), (None, "a wicked fool", None, None, None)]), model).collect()}
    assert len(got) == 204 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["score"] > 0.7 > got[2]["score"] and got[902]["score"] > 0.7 and got[900]["score"] < 0.5
    span = got[1]["spans"][0]
    assert rows[1][1][span["start"] : span["end"]] in ("wicked", "fool")
    docs = documents(spark)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity_digest(docs, nothing).collect()} == {0}
    kept = without_toxic(docs, nothing)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity_digest(empty(spark), labels).count() == 0


def test_pipeline_stages(spark):
    """Against each stage's own decisions, made anew from its input."""
    from tidewater.llm.common import new_path
    from tidewater.llm.decontaminate import decontamination_report
    from tidewater.llm.near_dup import near_duplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    want = {
        "toxicity": lambda d: {r["doc_id"] for r in toxicity_digest(d, labels).collect() if not r["predicted"]},
        "near_dedup": lambda d: {r["doc_id"] for r in near_duplicates(d).collect() if r["kept"]},
        "decontamination": lambda d: {r["doc_id"] for r in decontamination_report(d, benchmark).collect() if not r["contaminated"]},
        "mixing": lambda d: {r["doc_id"] for r in d.collect()},
    }
    columns, base = docs.columns, new_path(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
        assert out.columns == columns
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(want[name](docs))
        docs = out
    order = [r["doc_id"] for r in sorted(schedule(spark.read.parquet(f"{base}/decontamination")).collect(), key=lambda r: (r["slot"], r["place"]))]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in last] == order
    assert [(r["doc_id"], r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == [(r["doc_id"], r["start"], r["ids_crc32"]) for r in last]
