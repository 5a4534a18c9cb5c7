"""Line templates against a plain reading of the rules."""

import re
from collections import defaultdict

from sparkdraft.llm import linetree
from tools.oracle_check import canon


def plain(rows, least):
    lines = []
    for r, (d, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
            if tokens:
                raw, tokens = tuple(tokens), tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)
                lines.append((r, d, text, pos, (len(tokens), tokens[:3]), tokens, raw))
    texts, leaves = defaultdict(set), defaultdict(set)
    for _, _, text, _, leaf, tokens, _ in lines:
        texts[tokens].add(text)
        leaves[leaf].add(tokens)
    template = {}
    constant = lambda t: sum(x != "<*>" for x in t) >= 0.5 * len(t)
    for leaf, kinds in leaves.items():
        n = {k: len(texts[k]) for k in kinds}
        for k in kinds:
            template[k] = k if constant(k) else None
        if sum(n.values()) >= least and len(kinds) > 1 and min(n.values()) < least:
            at = defaultdict(int)
            for k in kinds:
                for p, t in enumerate(k):
                    at[p, t] += n[k]
            for k in kinds:
                t = tuple(t if t != "<*>" and at[p, t] >= least else "<*>" for p, t in enumerate(k))
                if constant(t):
                    template[k] = t
    members = defaultdict(list)
    for r, d, text, pos, leaf, tokens, raw in lines:
        # A line with more fields than that is told by its own tokens.
        members[leaf, template[tokens] or ("exact", raw)].append(((d is None, d if d is not None else 0, pos), text, r, pos))
    dropped = set()
    for rows_ in members.values():
        if len({x[1] for x in rows_}) >= least:
            first = min(x[0] for x in rows_)
            dropped |= {(x[2], x[3]) for x in rows_ if x[0] != first}
    out = []
    for r, (d, text) in enumerate(rows):
        parts = text.split("\n") if text is not None else []
        left = [x for p, x in enumerate(parts) if (r, p) not in dropped]
        out.append((d, "\n".join(left) if text is not None else None, len(parts), len(parts) - len(left)))
    return sorted(out, key=repr)


ROWS = (
    [(i, f"Intro {i} of a kind that stands once{i * 'x'}\nUser u{i} logged in from host h{i} today\nAll rights reserved.\nlast words of text {'abcdefghijklmnop'[i]}") for i in range(12)]
    + [(20 + i, f"Connection was closed by {name} at last") for i, name in enumerate(["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ivy", "joe", "kim"])]
    + [(40 + i, f"{i} {i + 1}\n{i * 7}") for i in range(15)]
    + [(60 + i, "a whole copy\nof two lines") for i in range(15)]
    + [(100 + i, f"Call 555-1234  24/7\nmore {'abcdefghijklmnop'[i]}\n{i} 2024-01-01 12:00") for i in range(12)]
    + [(80, None), (81, ""), (82, "\n\n"), (None, "All rights reserved.\n \n"), (83, "  All   rights\treserved.  "), (91, "Intro 2 of a kind that stands oncexx"), (90, "log 1 a\n" * 40)]
)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, line string, pos int")
    out = linetree.drop_recurring_lines(spark, df, **options)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    return sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def test_matches_plain_reading(spark):
    want = plain(ROWS, 10)
    assert found(spark, ROWS) == want
    by_id = {w[0]: w for w in want}
    assert by_id[0][3] == 0 and by_id[3][3] == 4  # the first keeps its lines
    assert by_id[25][1] == ""  # a variable field without digits
    assert all(by_id[60 + i][3] == 0 for i in range(15))  # copies are one text
    assert all(by_id[40 + i][3] == 0 for i in range(15))  # numbers alone are no template
    assert by_id[90][3] == 0  # a template of one text only


def test_other_threshold(spark):
    assert found(spark, ROWS, min_docs=2) == plain(ROWS, 2)


def test_repeated_rows_and_long_text(spark):
    rows = [(1, "same line here")] * 3 + [(i, f"same line here\n{'w ' * i}") for i in range(2, 14)] + [(99, ("b " * 50 + "\n") * 3000 + "same line here")]
    got = found(spark, rows)
    assert [g[1] for g in got if g[0] == 1] == ["same line here"] * 3
    assert all("same" not in g[1] for g in got if g[0] != 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linetree.drop_recurring_lines(spark, df).count() == 0


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    rel = duckdb.connect()
    rel.register("documents", documents)
    cur = rel.execute(linetree.oracle_sql())
    rows = cur.fetchall()
    assert canon([d[0] for d in cur.description], rows) == canon(["doc_id", "text", "n_lines", "n_dropped"], found(spark, ROWS))


def test_lines_of_fields_recur_verbatim(spark):
    rows = [(i, f"text {chr(97 + i)} of its own\n  Call 555-1234\t24/7\n{i} {i * 3} 7\n{i % 6} 5") for i in range(12)]
    rows += [(20 + i, "11 22 33\n" * 30) for i in range(2)]
    got = {g[0]: g for g in found(spark, rows)}
    assert got[0][3] == 0  # the first stays
    for i in range(1, 12):  # other digits are other lines, and two texts are too few
        assert got[i][1:] == (f"text {chr(97 + i)} of its own\n{i} {i * 3} 7\n{i % 6} 5", 4, 1)
    assert got[20][3] == got[21][3] == 0
