"""License rules against a plain reading with Python's regular expressions."""

import re

import duckdb
import pandas as pd
from hypothesis import given, settings, strategies as st

from sparkdraft.llm import licenses
from tools.oracle_check import canon

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TEXTS = [
    None, "", " .,- ", "Released under the MIT License.", "under the mit license under the mit license mit license", "Licensed under CC BY-NC 4.0. cc by nc",
    "é under THE Mit liCense é", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "This work is licensed under the GNU General Public License, version 3.", "Public-Domain in the public domain", "apache license version 2 apache license, version 2.0 spdx-license-identifier: apache-2.0",
    "gpl gpl gpl the gpl3", "copyright (c) 2020 all rights reserved " * 3, "unlicensed glicense", "licence mit licence", "cc by nc sa 4.0 cc by nd", "x " * 30_000 + "released under the zlib license " * 40,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "made available under the terms of the Mozilla Public License 2.0",
]
ROWS = [*enumerate(TEXTS), (None, "mit license"), (3, TEXTS[3])]


def plain(rows):
    rules, out = licenses.rules(), []
    for d, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        joined = " " + "  ".join(words) + " " if words else ""
        places = lambda p: [(m.start() and joined[: m.start() + 1].count(" ") // 2, m[0].count(" ") // 2) for m in re.finditer(licenses.spaced(p), joined)]
        base = [(a, label) for phrase, label in licenses.BASE_PHRASES for a, _ in places(phrase)]
        found = [(a, a + n - 1, r.priority, i, r.label) for i, r in enumerate(rules) if r.keyword in " ".join(words) for a, n in places(r.pattern)]
        kept = [x for x in found if not any(e[0] <= x[0] and e[1] >= x[1] and (e[2] < x[2] or e[2] == x[2] and (e[1] - e[0] > x[1] - x[0] or e[:2] == x[:2] and e[3] < x[3])) for e in found)]
        firsts = [a for a, _ in base]
        out.append((d, len(words), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted({b for _, b in base} | {k[4] for k in kept})), 1.0 if base else 1.0 - min(k[2] for k in kept) / 100 if kept else 0.0))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, base int")
    return [tuple(r) for r in licenses.license_labels(df, ["doc_id"]).select(*COLUMNS).collect()]


def test_matches_plain_reading(spark):
    assert canon(COLUMNS, found(spark, ROWS)) == canon(COLUMNS, plain(ROWS))


def test_sql_agrees(spark):
    rel = duckdb.connect()
    rel.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    cur = rel.execute(licenses.oracle_sql())
    rows = cur.fetchall()
    assert canon([d[0] for d in cur.description], rows) == canon(COLUMNS, found(spark, ROWS))


def test_order_and_containment(spark):
    by_id = {r[0]: r for r in found(spark, ROWS)}
    assert by_id[8][6] == "gpl-3.0"  # the bare name lies within
    assert by_id[7][6] == "gpl-2.0-or-later"
    assert by_id[13][6] == ""  # whole words only
    assert len(licenses.rules()) > 300


def test_every_keyword_passes_the_gate():
    gate = re.compile(licenses.GATE)
    for r in licenses.rules():
        shown = re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", r.pattern)
        assert gate.search(shown) or gate.search(r.keyword), r
    assert all(gate.search(p) for p, _ in licenses.BASE_PHRASES)


def test_empty_table(spark):
    assert licenses.license_labels(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


@settings(max_examples=400, deadline=None, database=None)
@given(st.sampled_from(licenses.NAMES).flatmap(lambda n: st.tuples(st.just(n), st.from_regex(n[1], fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 "))))
def test_names_hold_what_gates_them(case):
    (label, name, held), shown = case
    assert any(h in shown for h in held.split("|")), (label, shown)


def test_many_matches_in_one_text(spark):
    """Time grows with the matches; suppression over many steps equals the plain reading."""
    import time

    rows = [(1, "gpl code, " * 1500), (2, "released under the mit license, gnu gpl 3; cc by nc 4.0 " * 300)]
    assert canon(COLUMNS, found(spark, rows)) == canon(COLUMNS, plain(rows))
    took = []
    for n in (1, 20_000, 100_000):
        t = time.time()
        got = found(spark, [(1, "gpl code, " * n)])
        took.append(time.time() - t)
        assert got[0][1] == 2 * n and got[0][6] == "gpl"
    assert took[2] - took[0] < 60
