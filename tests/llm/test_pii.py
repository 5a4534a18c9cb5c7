"""Personal data against the patterns as they are written, and hand-made cases."""

import hashlib
import random
import re
import time

import pytest

from sparkdraft.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if checked(k, m.group())]
    return sorted(found, key=lambda r: (r[0], list(PATTERNS).index(r[2])))


def base(text):
    return [r[:3] for r in pii.personal_spans(text) if r[4]]


def more(text):
    return [(r[2], text[r[0] : r[1]]) for r in pii.personal_spans(text) if not r[4]]


def test_base_kinds_of_random_texts():
    turn, found = random.Random(4), 0
    parts = ["a@b.c", "x.y_z%@", "@", ".", "..", "-", "+", " ", "(", ")", "4", "12", "255", "256", "1.2.3.4", "é", "Ä@ö.de", "4111111111111111", "4111-1111 1111-1111", "+1 (743) 555-3824", "b.c_d@e.f", "\n", "00.01.002.0003"]
    for _ in range(6000):
        text = "".join(turn.choice(parts) for _ in range(turn.randint(1, 14)))
        assert base(text) == plain(text), text
        found += len(plain(text))
    assert found > 5000


@pytest.mark.parametrize("text, spans", [
    ("IBAN DE89 3704 0044 0532 0130 00 EUR", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("IBAN DE88 3704 0044 0532 0130 00 EUR", []),
    ("GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
    ("my social security number 536-22-1234", [("ssn", "536-22-1234")]),
    ("article 536-22-1234", []),
    ("call (523) 555-1055 now", [("phone", "(523) 555-1055")]),
    ("part (523) 555-1055 now", []),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]),
    ("commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", []),
    ("order 17 4111 1111 1111 1111 00", [("card", "4111 1111 1111 1111")]),
    ("host 2001:db8::8a2e:370:7334 at 12:30:45", [("ipv6", "2001:db8::8a2e:370:7334")]),
    ("a key of 12 parts in C3 format", []),
])
def test_further_kinds(text, spans):
    assert more(text) == spans


def test_scores_follow_the_words_nearby():
    score = lambda text: pii.personal_spans(text)[0][3]
    assert score("server 10.0.0.1") > score("it 10.0.0.1") > score("version 10.0.0.1")
    assert score("my card 4111111111111111") > score("at 4111111111111111")


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_spans_of_further_kinds_overlap_nothing():
    turn = random.Random(9)
    parts = ["token ", "key=", "0a1b2c3d4e5f6a7b8c9d0", "card ", "4111 1111 1111 1111 ", "12 ", "call 523 555 1055 ", "ssn 536-22-1234 ", "+", "a@b.c1d2e3f4g5h6i7j8k9l0 ", "DE89370400440532013000 "]
    for _ in range(1500):
        text = "".join(turn.choice(parts) for _ in range(turn.randint(1, 12)))
        spans = pii.personal_spans(text)
        for i, s in enumerate(spans):
            for o in spans[:i]:
                assert s[1] <= o[0] or o[1] <= s[0] or (s[4] and o[4]), text


def test_time_grows_with_the_length():
    n = 300_000
    for text in ("a" * n, "a" * n + "@", "1" * n, "1." * n, "+1" + "(" * n, "+1 " * n, "a@" * n, "4 1 " * n, "1-" * n, "A1" * n, ":" * n, "a@b.c," * (n // 6), "token a1b2c3d4e5f6g7h8i9j0 " * (n // 27)):
        t = time.process_time()
        pii.personal_spans(text)
        assert time.process_time() - t < 20, text[:20]


def test_redacted_text():
    text = "é call +1 (743) 555-3824 or x@y.zz, token a1b2c3d4e5f6g7h8i9j0k."
    assert pii.redacted(text, pii.personal_spans(text)) == "é call <phone> or <email>, token <secret>."


def test_rows_through_spark(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "mail a@b.cc", 3), (3, "no data", 4), (3, "É 4111111111111111", 5), (3, "É 4111111111111111", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = pii.personal_data(df, ["doc_id", "text", "found"]).collect()
    assert sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["found"]], r["redacted"]) for r in got), key=repr) == sorted(
        [(1, [], ""), (2, [], ""), (None, [("email", 5, 11)], "mail <email>"), (3, [], "no data"), (3, [("card", 2, 18)], "É <card>"), (3, [("card", 2, 18)], "É <card>")], key=repr
    )
    assert pii.personal_data(df.limit(0), ["doc_id"]).count() == 0


def test_query(spark):
    from sparkdraft.llm.queries import QUERIES

    sf, want = "/root/testdata/sf0.01", {}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        spans = plain(t or "")
        counts = tuple(sum(s[2] == k for s in spans) for k in PATTERNS)
        want[d] = (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest())
    got = QUERIES["op12_pii"](spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert {d: r[:-1] for d, r in got.items()} == want
    assert sum("secret:" in r[-1] for r in got.values()) > 5 and all(sum(v[i] for v in want.values()) for i in (0, 2, 3))
