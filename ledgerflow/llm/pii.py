"""Personal data by patterns, checksums and context, in DataFrame functions only.

Regular expressions propose spans; a checksum confirms those that have one (Luhn for cards, mod 97
for IBANs), a range check the others; words just before or behind a span raise its score. Base
kinds that pass their check always stay, whatever their score. The added kinds, ``iban`` and
``ssn``, stay from a score of ``KEEP`` on: an IBAN by its checksum, a social security number only
with a context word.

Java's matcher gives texts of matches, not places: the pieces that split() leaves between the
matches give those. Every pattern starts only where a run of its characters starts or the last
match ended, and repeats groups possessively, so that long runs take linear time and no stack.

Defined results: a null text is read as empty and has no spans; offsets count code points; rows that
repeat an id or text each give a row; an empty table gives none. Of a very long text, places are summed in
blocks of ``BLOCK`` matches, so that many matches don't copy one another's list again and again. find()
keeps all columns, whatever their names, but replaces one called pii; digest() reads doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 0.5
#: Code points before and behind a span in which context words count.
NEAR = 48
#: Matches whose places are summed together.
BLOCK = 500
BASE = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    doubled = "cast(substring(reverse(d), i, 1) as int) * (2 - i % 2)"
    return f"exists(array({digits}), d -> aggregate(transform(sequence(1, greatest(length(d), 1)), i -> {doubled} - CASE WHEN {doubled} > 9 THEN 9 ELSE 0 END), 0, (a, b) -> a + b) % 10 = 0)"


def _mod97(value: str) -> str:
    moved = f"concat(substring({value}, 5), substring({value}, 1, 4))"
    step = "CASE WHEN substring(m, i, 1) >= 'A' THEN (a * 100 + ascii(substring(m, i, 1)) - 55) % 97 ELSE (a * 10 + cast(substring(m, i, 1) as int)) % 97 END"
    return f"exists(array({moved}), m -> aggregate(sequence(1, greatest(length(m), 1)), 0, (a, i) -> cast({step} as int)) = 1)"


#: kind: (a cheap test whether a text can have one, pattern, check of x.value, score when it passes, context words)
KINDS = {
    "email": (
        "contains({t}, '@')",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.8,
        "mail|contact|write|reply",
    ),
    "ip": (
        "rlike({t}, '[0-9][.][0-9]')",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
        0.5,
        "ip|host|server|address|login",
    ),
    "card": (
        "rlike({t}, '[0-9](?:[ -]?[0-9]){{11}}')",
        r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
        f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_luhn(_DIGITS)}",
        0.7,
        "card|visa|credit|debit|payment|master",
    ),
    "phone": (
        "contains({t}, '+')",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) BETWEEN 9 AND 15",
        0.6,
        "phone|tel|call|mobile|fax",
    ),
    "iban": (
        "rlike({t}, '[A-Z]{{2}}[0-9]{{2}}[ ]?[A-Z0-9]{{4}}')",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        f"length(replace(x.value, ' ', '')) BETWEEN 15 AND 34 AND {_mod97("replace(x.value, ' ', '')")}",
        0.9,
        "iban|account|bank|transfer",
    ),
    "ssn": (
        "rlike({t}, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "substring(x.value, 1, 3) NOT IN ('000', '666') AND x.value < '900' AND substring(x.value, 5, 2) <> '00' AND substring(x.value, 8) <> '0000'",
        0.3,
        "ssn|social|security",
    ),
}
RAISE = 0.2
SPAN = "struct<start: int, rank: int, end: int, kind: string, score: double>"


def _literal(text: str) -> str:
    return "r'" + text + "'"


def _spans(kind: str, text: str) -> str:
    """SQL for the array of a kind's spans in ``text``: places first, then the check, then the score."""
    likely, pattern, check, score, words = KINDS[kind]
    found = f"arrays_zip(split({text}, {_literal(pattern)}, -1), regexp_extract_all({text}, {_literal(pattern)}, 0))"
    kind_of = "array<struct<start: int, end: int, value: string>>"
    inside = (
        f"transform(sequence(0, (size(f) - 1) div {BLOCK}), b -> aggregate(slice(f, b * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', cast(array() as {kind_of})), (a, x) -> "
        "CASE WHEN x.`1` IS NULL THEN a ELSE named_struct('at', a.at + length(x.`0`) + length(x.`1`), 'out', concat(a.out, array("
        "named_struct('start', a.at + length(x.`0`), 'end', a.at + length(x.`0`) + length(x.`1`), 'value', x.`1`)))) END))"
    )
    joined = (
        f"aggregate({inside}, named_struct('at', 0, 'out', cast(array() as array<{kind_of}>)), (a, b) -> named_struct('at', a.at + b.at, 'out', concat(a.out, array("
        "transform(b.out, s -> named_struct('start', a.at + s.start, 'end', a.at + s.end, 'value', s.value))))), a -> flatten(a.out))"
    )
    placed = f"element_at(transform(array({found}), f -> {joined}), 1)"
    near = f"concat(substring({text}, greatest(x.start - {NEAR}, 0) + 1, least(x.start, {NEAR})), ' ', substring({text}, x.end + 1, {NEAR}))"
    scored = f"cast({score} + CASE WHEN rlike(lower({near}), '(?<![a-z])(?:{words})') THEN {RAISE} ELSE 0 END as double)"
    rank = list(KINDS).index(kind)
    made = f"transform(filter({placed}, x -> {check}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}', 'score', {scored}))"
    if kind not in BASE:
        made = f"filter({made}, s -> s.score >= {KEEP})"
    return f"CASE WHEN {likely.format(t=text)} THEN {made} ELSE cast(array() as array<{SPAN}>) END"


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``pii``: an array of (start, rank, end, kind, score), in order of start, then kind."""
    every = ", ".join(_spans(kind, f"coalesce(`{text_col}`, '')") for kind in KINDS)
    return df.withColumn("pii", F.expr(f"sort_array(concat({every}))"))


def digest(df: DataFrame) -> DataFrame:
    """Counts and digests of the spans, a row a document."""
    text = "concat(s.kind, ':', s.start, ':', s.end)"
    count = lambda kind: F.expr(f"cast(size(filter(pii, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return find(df.select("doc_id", "text")).select(
        "doc_id",
        *map(count, KINDS),
        F.expr(f"sha2(array_join(transform(filter(pii, s -> s.rank < {len(BASE)}), s -> {text}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(pii, s -> {text}), ',')").alias("spans"),
        F.expr("array_max(transform(pii, s -> s.score))").alias("top_score"),
    )
