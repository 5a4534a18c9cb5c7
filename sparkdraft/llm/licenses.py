"""License detection by ordered signature rules, in DataFrame functions only.

A text is read as words (A-Z lower-cased, then runs of ASCII digits and letters
and of all non-ASCII characters). Every rule is a regular
expression over whole words with a label, a priority and a keyword without
which it cannot match:

1. Texts without any keyword stop here; the others try the rules of the
   keywords they hold (that of the rule's context and one of its name).
2. Every match becomes an interval of words with its rule's label and priority.
3. Rules are ordered. A detection that lies within one of higher priority,
   or within a longer one of the same, is suppressed, as is the later rule's of
   two on the same words.
4. The labels left are reported. Base phrases are reported with all their
   places and never suppressed.

Defined results: null or empty text has no words and no labels; null ids and
repeated rows are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# The phrases of the base scan and their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    #: Of which any match holds one, too.
    names: str = ""


#: Licenses: label, name (a regex over words), what one of stands in every such name.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit (?:no attribution|0)", "mit"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("0bsd", "(?:bsd zero clause|zero clause bsd|0bsd)", "bsd"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd)", "bsd"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("apache-1.1", "apache (?:software )?(?:license )?(?:version |v)?1 1", "apache"),
    ("apache-2.0", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache"),
    ("gpl-1.0", "(?:gnu )?(?:gpl|general public license)(?: )?(?:version |v)?1(?: 0)?", "gpl|general public license"),
    ("gpl-2.0", "(?:gnu )?(?:gpl|general public license)(?: )?(?:version |v)?2(?: 0)?", "gpl|general public license"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license)(?: )?(?:version |v)?3(?: 0)?", "gpl|general public license"),
    ("lgpl-2.0", "(?:gnu )?(?:lgpl|(?:library|lesser) general public license)(?: )?(?:version |v)?2(?: 0)?", "gpl|general public license"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: )?(?:version |v)?2 1", "gpl|general public license"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license)(?: )?(?:version |v)?3(?: 0)?", "gpl|general public license"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license)(?: )?(?:version |v)?3(?: 0)?", "gpl|general public license"),
    ("gfdl", "(?:gfdl|gnu free documentation license)", "gfdl|free documentation"),
    ("mpl-1.1", "(?:mpl|mozilla public license)(?: )?(?:version |v)?1 1", "mpl|mozilla"),
    ("mpl-2.0", "(?:mpl|mozilla public license)(?: )?(?:version |v)?2(?: 0)?", "mpl|mozilla"),
    ("epl-1.0", "(?:epl|eclipse public license)(?: )?(?:version |v)?1(?: 0)?", "epl|eclipse"),
    ("epl-2.0", "(?:epl|eclipse public license)(?: )?(?:version |v)?2(?: 0)?", "epl|eclipse"),
    ("cddl-1.0", "(?:cddl|common development and distribution license)", "cddl|common development"),
    ("cpl-1.0", "(?:cpl|common public license)(?: )?(?:version |v)?1(?: 0)?", "cpl|common public"),
    ("artistic-1.0", "artistic license(?: )?(?:version |v)?1(?: 0)?", "artistic"),
    ("artistic-2.0", "artistic license(?: )?(?:version |v)?2(?: 0)?", "artistic"),
    ("bsl-1.0", "(?:bsl 1 0|boost software license)", "bsl|boost"),
    ("zlib", "(?:zlib|zlib libpng)", "zlib"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "wtfpl|do what the fuck"),
    ("psf-2.0", "(?:psf|python software foundation license)(?: )?(?:version |v)?2?", "psf|python software"),
    ("postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl license", "openssl"),
    ("ofl-1.1", "(?:ofl 1 1|sil open font license)", "ofl|open font"),
    ("eupl-1.2", "(?:eupl|european union public licen[cs]e)", "eupl|european union"),
    ("ms-pl", "(?:ms pl|microsoft public license)", "ms pl|microsoft public"),
    ("odbl", "(?:odbl|open database license)", "odbl|open database"),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)", "cc0|cc zero|commons zero"),
    ("cc-by-3.0", "(?:cc|creative commons) (?:by|attribution) 3 0", "cc|creative commons"),
    ("cc-by-4.0", "(?:cc|creative commons) (?:by|attribution) 4 0", "cc|creative commons"),
    ("cc-by-sa-3.0", "(?:cc|creative commons) (?:by sa|attribution share ?alike) 3 0", "cc|creative commons"),
    ("cc-by-sa-4.0", "(?:cc|creative commons) (?:by sa|attribution share ?alike) 4 0", "cc|creative commons"),
    ("cc-by-nc-3.0", "(?:cc|creative commons) (?:by nc|attribution non ?commercial) 3 0", "cc|creative commons"),
    ("cc-by-nc-4.0", "(?:cc|creative commons) (?:by nc|attribution non ?commercial) 4 0", "cc|creative commons"),
    ("cc-by-nd-4.0", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:atives|s)) 4 0", "cc|creative commons"),
    ("cc-by-nc-sa-4.0", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike) 4 0", "cc|creative commons"),
    ("cc-by-nc-nd-4.0", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:atives|s)) 4 0", "cc|creative commons"),
]

#: How a license is named, from the surest on: priority, keyword, text around {name}.
CONTEXTS = [
    (10, "spdx", "spdx license identifier {name}(?: only| or later)?"),
    (20, "licensed", "(?:is |are |be )?licensed under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?"),
    (20, "released", "(?:is |are |be )?released under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?"),
    (20, "distributed", "(?:is |are |be )?distributed under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?"),
    (25, "available", "(?:made |is |are )?available under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?"),
    (30, "license", "license {name}"),
    (30, "licen", "{name} licen[cs]e"),
]

#: Signatures that are no name: label, priority, keyword, pattern.
PHRASES = [
    ("mit", 15, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 15, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 15, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", 15, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", 14, "version", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 14, "version", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("zlib", 15, "warranty", "this software is provided as is without any express or implied warranty"),
    ("unlicense", 15, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("gpl", 40, "gnu", "gnu general public license"),
    ("gpl", 45, "gpl", "(?:the )?gpl"),
    ("lgpl", 40, "gnu", "gnu (?:lesser|library) general public license"),
    ("agpl", 40, "affero", "(?:gnu )?affero general public license"),
    ("apache", 40, "apache", "apache (?:software )?license"),
    ("mozilla", 40, "mozilla", "mozilla public license"),
    ("cc-by", 40, "cc by", "cc by"),
    ("cc-by-sa", 38, "cc by sa", "cc by sa"),
    ("cc-by-nc", 38, "cc by nc", "cc by nc"),
    ("cc-by-nd", 38, "cc by nd", "cc by nd"),
    ("cc-by-nc-sa", 36, "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", 36, "cc by nc nd", "cc by nc nd"),
    ("creative-commons", 45, "creative commons", "creative commons(?: license)?"),
    ("public-domain", 40, "public domain", "(?:in|into|to) the public domain"),
    ("all-rights-reserved", 50, "rights reserved", "all rights reserved"),
    ("proprietary", 50, "proprietary", "proprietary and confidential"),
    ("copyright", 60, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
]

#: Holds for every text that any rule can match; checked once per text before all else.
GATE = "licen|copyright|public domain|rights reserved|proprietary|permission|redistribut|warranty|unencumbered|gnu|gpl|apache|mozilla|affero|cc by|creative commons|released under|distributed under|available under"


def rules() -> list[Rule]:
    """All rules in order: every name in every context, and the phrases."""
    named = [Rule(label, p, key, around.replace("{name}", name), held) for p, key, around in CONTEXTS for label, name, held in NAMES]
    return sorted([*[Rule(*x) for x in PHRASES], *named], key=lambda r: r.priority)


#: Everything but ASCII digits and letters and what is not ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(pattern: str) -> str:
    """The pattern over words that have two spaces between them: a match takes one
    on either side, so that matches can stand next to each other."""
    return f" (?:{pattern.replace(' ', '  ')}) "


def _joined(text: Column) -> Column:
    """Words with two spaces between them, one at either end; empty if there are none."""
    words = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


#: Begin and end of a match; no word holds such characters.
_BEGIN, _END = "\x01", "\x02"


def marking(pattern: str) -> str:
    """The spaced pattern with the words of a match as its group."""
    return f" ((?:{pattern.replace(' ', '  ')})) "


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(joined: Column, pattern: Column) -> Column:
    """(first, last): words of each match of a marking pattern, from left to right.

    One replacement marks the first and the last word of every match; the numbers of
    the marked words are the places. So the time grows with the text, not with text
    times matches.
    """
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    marked = F.regexp_replace(joined, pattern, F.lit(f" {_BEGIN}$1{_END} "))
    return _once(marked, lambda m: F.when(F.contains(m, F.lit(_BEGIN)), _marked_places(m)).otherwise(none))


def _marked_places(marked: Column) -> Column:
    words = F.transform(F.split(F.trim(marked), "  "), lambda w, i: F.struct(i.cast("long").alias("at"), F.startswith(w, F.lit(_BEGIN)).alias("begins"), F.endswith(w, F.lit(_END)).alias("ends")))
    at = lambda m, which: F.transform(F.filter(m, lambda w: w[which]), lambda w: w["at"])
    ends = F.filter(words, lambda w: w["begins"] | w["ends"])
    return _once(ends, lambda m: F.zip_with(at(m, "begins"), at(m, "ends"), lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _literal(rows: list[tuple], fields: str) -> Column:
    """A constant array of structs."""
    names = fields.split()
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


#: Detections that one step of the suppression takes.
_STEP = 256
_DETECTION = "struct<first: bigint, back: bigint, level: int, rule: int, label: string>"
_KEPT = "struct<first: bigint, last: bigint, level: int, label: string>"


def _ordered(found: Column) -> Column:
    """Detections by first word, longest, priority and rule."""
    return F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label"))))


def _unsuppressed(ordered: str, levels: int) -> Column:
    """The detections that no other contains, of those of higher priority and, of the same, longer or earlier rules.

    ``ordered`` is a column of detections in order. One is suppressed if one before it of its
    priority or a higher one reaches as far; so one pass keeps the farthest reach by priority. An
    array grows by copying, so the pass collects ``_STEP`` detections at a time and
    puts these together.
    """

    def step(state: Column, d: Column) -> Column:
        last = -d["back"]
        hidden = F.exists(F.slice(state["reach"], F.lit(1), d["level"] + 1), lambda r: r >= last)
        reach = F.transform(state["reach"], lambda r, i: F.when(i == d["level"], F.greatest(r, last)).otherwise(r))
        kept = F.when(hidden, state["kept"]).otherwise(F.concat(state["kept"], F.array(F.struct(d["first"].alias("first"), last.alias("last"), d["level"].alias("level"), d["label"].alias("label")))))
        return F.struct(reach.alias("reach"), kept.alias("kept"))

    def some(state: Column, _: Column) -> Column:
        start = F.struct(state["reach"].alias("reach"), F.array().cast(f"array<{_KEPT}>").alias("kept"))
        taken = F.aggregate(F.slice(state["rest"], F.lit(1), F.lit(_STEP)), start, step)
        rest = F.slice(state["rest"], F.lit(_STEP + 1), F.greatest(F.size(state["rest"]) - _STEP, F.lit(0)))
        return _once(taken, lambda t: F.struct(t["reach"].alias("reach"), F.concat(state["kept"], t["kept"]).alias("kept"), rest.alias("rest")))

    every = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("reach"), F.array().cast(f"array<{_KEPT}>").alias("kept"), F.col(ordered).alias("rest"))
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.size(ordered) / _STEP), F.lit(1)))
    return F.aggregate(steps, every, some, lambda s: s["kept"])


def detect(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with n_words, base (places of base phrases: first,
    last, label) and found (unsuppressed detections: first, last, level of priority, label)."""
    own = rules()
    priorities = sorted({r.priority for r in own})
    two = lambda words: words.replace(" ", "  ")
    table = _literal([(r.label, priorities.index(r.priority), i, two(r.keyword), [two(n) for n in r.names.split("|")], marking(r.pattern)) for i, r in enumerate(own)], "label level rule keyword names pattern")
    base = _literal([(label, marking(phrase)) for phrase, label in BASE_PHRASES], "label pattern")
    joined = docs.select(*keep, _joined(F.col(text_col)).alias("_joined"))
    # Lower-casing and all rules are for texts behind the gate only.
    gated = F.col("_joined").rlike("(?i)" + two(GATE))
    low = joined.withColumn("_low", F.when(gated, F.translate("_joined", _UPPER, _LOWER)))
    held = lambda r: F.contains(F.col("_low"), r["keyword"]) & F.exists(r["names"], lambda n: F.contains(F.col("_low"), n))
    found = F.flatten(
        F.transform(
            F.filter(table, held),
            lambda r: F.transform(_places(F.col("_low"), r["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label"))),
        )
    )
    bases = F.flatten(F.transform(base, lambda b: F.transform(_places(F.col("_low"), b["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), b["label"].alias("label")))))
    seen = F.col("_low").isNotNull()
    scanned = low.select(
        *keep,
        F.floor(_spaces(F.col("_joined")) / 2).cast("long").alias("n_words"),
        F.when(seen, bases).otherwise(F.array().cast("array<struct<first: bigint, last: bigint, label: string>>")).alias("base"),
        F.when(seen, _ordered(found)).otherwise(F.array().cast(f"array<{_DETECTION}>")).alias("_ordered"),
    )
    return scanned.select(*keep, "n_words", "base", _unsuppressed("_ordered", len(priorities)).alias("found"))


def license_labels(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with n_words, n_base, first_word, last_word, base_labels, labels and
    score: 1 for a base phrase, else 1 less a hundredth of the best priority found, 0 for none."""
    priorities = sorted({r.priority for r in rules()})
    firsts = F.transform("base", lambda b: b["first"])
    base_names, names = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    best = F.array_min(F.transform("found", lambda d: d["level"]))
    return detect(docs, keep, text_col).select(
        *keep,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_names, names))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0))
        .when(F.size("found") > 0, F.lit(1.0) - F.element_at(F.array(*[F.lit(p) for p in priorities]), best + 1) / F.lit(100.0))
        .otherwise(F.lit(0.0))
        .alias("score"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL: every rule joined to the texts that hold its
    keyword, detections held against each other."""
    own = rules()
    level = {p: i for i, p in enumerate(sorted({r.priority for r in own}))}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(r.label)}, {r.priority}, {level[r.priority]}, {quote(r.keyword.replace(' ', '  '))}, {quote(spaced(r.pattern))})" for i, r in enumerate(own))
    base = ", ".join(f"({quote(label)}, {quote(spaced(phrase))})" for phrase, label in BASE_PHRASES)
    places = """
        unnest(list_transform(generate_series(1, len(m)), lambda i:
            (list_sum(list_transform(s[1:i], lambda x: len(x) - len(replace(x, ' ', '')))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x) - len(replace(x, ' ', '')))), 0)) // 2)) AS first,
        unnest(list_transform(m, lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)) AS n"""
    return f"""
    WITH rules(rule, label, priority, level, keyword, pattern) AS (VALUES {rows}),
    phrases(label, pattern) AS (VALUES {base}),
    j AS (SELECT doc_id, row_number() OVER () AS r, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS t FROM (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS w FROM documents)),
    b AS (SELECT r, label, {places} FROM (SELECT r, label, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS s FROM j, phrases WHERE regexp_matches(t, pattern))),
    bs AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
    d AS (SELECT r, rule, label, priority, first, first + n - 1 AS last FROM (SELECT r, rule, label, priority, {places} FROM (SELECT r, rule, label, priority, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS s FROM j JOIN rules ON contains(t, keyword) WHERE regexp_matches(t, pattern)))),
    k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.r = d.r AND e.first <= d.first AND e.last >= d.last AND
        (e.priority < d.priority OR e.priority = d.priority AND (e.last - e.first > d.last - d.first OR e.last - e.first = d.last - d.first AND e.rule < d.rule)))),
    ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM k UNION SELECT r, label FROM b) GROUP BY r),
    sc AS (SELECT r, min(priority) AS p FROM k GROUP BY r)
    SELECT doc_id, CAST((len(t) - len(replace(t, ' ', ''))) // 2 AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
        CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0::DOUBLE WHEN p IS NOT NULL THEN 1.0::DOUBLE - p / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM j LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN sc USING (r)"""
