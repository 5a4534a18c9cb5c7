"""Decontamination against an edit-distance search without any filter."""

import numpy as np

from sparkdraft.llm import decontam

ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards box with grumpy jugs of vodka near the old quarry wall at dawn."), (2, "Short but long enough to look for, this item."), (3, "tiny"), (4, None)]


def distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    last = [0] * (len(text) + 1)
    for a in pattern:
        now = [last[0] + 1]
        for j, b in enumerate(text):
            now.append(min(last[j] + (a != b), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


def plain_hit(item, text):
    fold = lambda s: "".join(chr(x) for x in decontam.characters(s))
    item, text = fold(item), fold(text)
    return len(item) >= 16 and any(distance(item[s : s + m], text) <= decontam._edits(m) for s, m in decontam._windows(len(item)))


def edited(random, text, n):
    out = list(text)
    for _ in range(n):
        p, kind = random.randint(0, len(out)), random.randint(0, 3)
        if kind == 0:
            out[p] = "#"
        elif kind == 1:
            out.insert(p, "x")
        else:
            del out[p]
    return "".join(out)


def test_hits_match_a_search_without_filters():
    random = np.random.RandomState(7)
    items = [(i, t) for i, t in ITEMS if t]
    index = decontam.build_index(items)
    found = missed = 0
    for trial in range(60):
        item = items[trial % 2][1]
        a = random.randint(0, 30) if trial % 2 == 0 else 0
        text = "before it stands something else, " + edited(random, item[a:], random.randint(0, 16)).upper() + " and after"
        got = {items[h[1]][0] for h in decontam.hits([text], index)}
        want = {i for i, t in items if plain_hit(t, text)}
        assert got == want, text
        found, missed = found + bool(want), missed + (not want)
    assert found > 10 and missed > 5


def test_spans_and_rows(spark):
    passage = ITEMS[0][1].replace(" ", "\n")
    rows = [(1, "x" * 50 + passage), (2, None), (None, passage), (3, "clean text " * 40), (4, ""), (5, passage + " and " + "y" * 200 + passage), (5, passage + " and " + "y" * 200 + passage)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, item_id string, edits int")
    benchmark = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in decontam.contaminated(spark, docs, benchmark, ["doc_id"]).collect()]
    n = len(passage)
    assert sorted(got, key=repr) == sorted([(1, 1, 50, 50 + n, 0), (None, 1, 0, n, 0), *[(5, 1, a, a + n, 0) for a in (0, n + 205)] * 2], key=repr)
    clean = decontam.without_contaminated(spark, docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r[0] for r in clean.collect()) == [2, 3, 4]


def test_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    monkeypatch.setattr(decontam, "_SEGMENT", 1000)
    filler = " ".join(f"word{i}" for i in range(3000))
    at = 996 - 60  # over the end of a segment
    rows = [(1, filler[:at] + ITEMS[0][1] + filler), (2, filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contaminated(spark, docs, benchmark, ["doc_id"]).collect()
    assert [(r["doc_id"], r["item_id"], r["span_start"], r["span_end"]) for r in got] == [(1, 1, at, at + len(ITEMS[0][1]))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminated(spark, docs.limit(0), benchmark, ["doc_id"]).count() == 0
    assert decontam.contaminated(spark, docs, benchmark.limit(0), ["doc_id"]).count() == 0
    assert decontam.without_contaminated(spark, docs, benchmark.limit(0)).count() == 1


def test_every_passage_is_found_wherever_it_begins():
    item = ITEMS[0][1]
    index = decontam.build_index([(1, item)])
    for size in (74, 80, 90):
        for a in range(len(item) - size + 1):
            found = decontam.hits(["~" * 30 + item[a : a + size] + "~" * 30], index)
            assert len(found) == 1, (a, size)
            assert abs(found[0][2] - 30) <= 6 and abs(found[0][3] - 30 - size) <= 6  # the budget may reach beyond it


def test_hits_match_all_windows_of_edited_parts():
    random = np.random.RandomState(11)
    item = ITEMS[0][1]
    index = decontam.build_index([(1, item)])
    found = 0
    for trial in range(40):
        a, size = random.randint(0, 40), random.randint(70, 90)
        text = "before, " + edited(random, item[a : a + size], random.randint(0, 9)) + " after"
        want = any(distance(decontam.characters(item)[s : s + 80], decontam.characters(text)) <= 6 for s in range(len(item) - 79))
        assert bool(decontam.hits([text], index)) == want, text
        found += want
    assert 5 < found < 35


def test_short_items_are_found_whole():
    items = [(1, "A short item of 32 characters ok"), (2, "tiny"), (3, ""), (4, "exactly8"), (5, "sixteen letters!")]
    index = decontam.build_index(items)
    text = "it holds a short item of 32 characters ok, EXACTLY8 and tiny, tiny, and sixteen letters!"
    assert [(items[h[1]][0], h[2], h[4]) for h in decontam.hits([text], index)] == [(1, 9, 0), (2, 56, 0), (2, 62, 0), (4, 43, 0), (5, 72, 0)]
    assert [items[h[1]][0] for h in decontam.hits(["a shrt item of 32 chaacters ok"], index)] == [1]
    assert decontam.hits(["a shirt for tin men, exactly 8"], index) == []


def repetitive(random, n):
    """Texts of rules, indents, short periods, and words between."""
    out = []
    for _ in range(n):
        kind = random.randint(0, 5)
        unit = ["-", " ", "=-", "ab ", "| -- "][kind]
        out.append(unit * random.randint(1, 260 // len(unit)) + ["", " word ", "\n", "Table of 7 rows"][random.randint(0, 4)])
    return "".join(out)


def test_repetitive_texts_match_a_search_without_filters():
    random = np.random.RandomState(3)
    found = 0
    for trial in range(25):
        items = [(i, repetitive(random, random.randint(1, 3))) for i in range(2)]
        items = [(i, t) for i, t in items if len(t) >= 16]
        text = repetitive(random, random.randint(1, 3))
        if random.rand() < 0.4 and items:
            text += edited(random, items[0][1], random.randint(0, 9)) + repetitive(random, 1)
        got = {items[h[1]][0] for h in decontam.hits([text], decontam.build_index(items))}
        want = {i for i, t in items if plain_hit(t, text)}
        assert got == want, (trial, text)
        found += len(want)
    assert 6 < found < 45


def covered(found):
    out = {}
    for t, i, lo, hi, _ in found:
        out.setdefault((t, i), []).append((lo, hi))
    return out


def test_segments_and_left_out_middles_find_the_same_spans(monkeypatch):
    random = np.random.RandomState(5)
    some = 0
    for trial in range(6):
        items = [(i, repetitive(random, random.randint(1, 4))) for i in range(4)]
        long = "-=|"[trial % 3] * random.randint(1, 1500) + repetitive(random, 3) + "ab" * random.randint(1, 900) + items[0][1]
        texts = [long, repetitive(random, 6), "clean text", items[1][1] * 3]
        index = decontam.build_index(items)
        monkeypatch.setattr(decontam, "WORK", 1 << 50)
        whole = decontam.hits(texts, index)
        monkeypatch.setattr(decontam, "WORK", 60)
        monkeypatch.setattr(decontam, "_SHORT_SEGMENT", 300)
        got, want = covered(decontam.hits(texts, index)), covered(whole)
        assert got.keys() == want.keys(), trial
        for key, spans in want.items():
            # Equally good alignments may end some places apart, within the budget.
            one, other = ({x for lo, hi in s for x in range(lo, hi)} for s in (spans, got[key]))
            assert len(one ^ other) <= 2 * decontam.EDITS * max(len(spans), len(got[key])), (trial, key)
        some += len(whole)
    assert some > 12


def test_work_on_repeats_grows_with_the_text():
    import time
    import tracemalloc

    rules = [(i, f"row {i * 7919} " + "-" * 60 + f" end {i * 104729}") for i in range(400)]
    cases = [([(1, x * (2000 // len(x)))], x * (n // len(x))) for x in ("-", " ", "-=") for n in (2000, 200_000)]
    cases += [(rules, ("-" * 60 + f"\nline {i}\n" * 2) * n) for i, n in ((1, 8), (2, 16))]
    for items, text in cases:
        index = decontam.build_index(items)
        tracemalloc.start()
        t = time.process_time()
        found = decontam.hits([text], index)
        took, peak = time.process_time() - t, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 60 and peak < 500e6, (text[:20], len(text), took, peak)
        if len(items) == 1:
            [(_, item, lo, hi, _)] = found
            assert item == 0 and lo <= decontam.EDITS and hi >= len(text) - decontam.EDITS


def test_short_items_stand_alone(spark):
    items = [(1, "A"), (2, "cat"), (3, "Nine lives"), (4, "(c)")]
    docs = spark.createDataFrame([(1, "Plain clean text about a cat."), (2, "Concatenate bananas"), (3, "it has nine lives"), (4, "nine livest (c)x")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs, benchmark, ["doc_id"]).collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (4, 4)}
    assert decontam.without_contaminated(spark, docs, benchmark).count() == 4
    assert sorted(r[0] for r in decontam.without_contaminated(spark, docs, benchmark, least=3).collect()) == [2]
