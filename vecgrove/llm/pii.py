r"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Kinds, in order: email, ip, card, phone (the base kinds), then iban, tel, ssn (added by the method).
Base candidates are leftmost and non-overlapping per kind; those that fail their check are dropped
without a retry. Cards must pass Luhn, IBANs mod-97. ``tel`` (a national number) and ``ssn`` are
too plain to stand alone: only a telling word within 40 code points before lifts their score over
``MIN_SCORE``. Added spans never overlap a base span.

The expressions are written for linear time on very long texts: each starts only where a run of its
characters starts, and repeats single characters (no recursion of the matcher). They find the same
spans as the plain forms

    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)              parts at most 255
    card  [0-9]([\x20-]?[0-9])+                             14 to 19 digits
    phone \+[0-9][\x20().0-9-]+[0-9]                        10 to 15 digits

Positions come from the pieces between the matches, in code points, end exclusive; matches, positions
and overlaps are walked in chunks, in time linear in the text. Only DataFrame functions run: no Python
on the executors, no shuffle.

Defined results: null text counts as empty and has no spans; an empty span list has the digest of the
empty string. Repeated rows get the same result. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import table

KINDS = ("email", "ip", "card", "phone", "iban", "tel", "ssn")
BASE = KINDS[:4]
MIN_SCORE = 0.5
REACH = 40

_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++\.{_HOST}[A-Za-z0-9.-]*?(?!\.?{_HOST})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a kind to be worth looking for; for other kinds, ``DIGITS``.
HINTS = {"email": "@", "phone": "+", "ssn": "-"}
#: In every match of an ip, a card (its digits may all stand apart), an IBAN and a national number.
DIGITS = r"[0-9][\x20.-]?[0-9]"
#: Score of a confirmed span by kind, what a telling word before it adds, and the words.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|kontakt|correo"),
    "ip": (0.6, 0.3, "ip|host|server|address|adresse"),
    "card": (0.8, 0.2, "card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": (0.7, 0.2, "phone|tel|call|mobile|cell|fax|whatsapp"),
    "iban": (0.8, 0.2, "iban|bank|account|konto|compte|cuenta"),
    "tel": (0.3, 0.4, "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|móvil"),
    "ssn": (0.3, 0.4, "ssn|social security"),
}


def _luhn(digits: str) -> str:
    """SQL: the digits, padded to 19, pass Luhn. Doubled digits come from a table of their digit sums."""
    plain = f"lpad({digits}, 19, '0')"
    doubled = f"translate({plain}, '0123456789', '0246813579')"
    total = f"aggregate(sequence(1, 19), 0, (t, i) -> t + int(substr(if(i % 2 = 1, {plain}, {doubled}), i, 1)))"
    return f"({total}) % 10 = 0"


def _mod97(code: str) -> str:
    """SQL: an IBAN without blanks, its first four characters moved to the end, leaves 1 modulo 97."""
    turned = f"concat(substr({code}, 5), substr({code}, 1, 4))"
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    step = f"aggregate(split({turned}, ''), 0, (t, c) -> if(c = '', t, (if({value} < 10, t * 10, t * 100) + {value}) % 97))"
    return f"length({code}) BETWEEN 15 AND 34 AND ({step}) = 1"


_DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
CHECKS = {
    "ip": r"forall(split(s.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', substr(ltrim('0', p), 1, 3))) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": _mod97("replace(s.m, ' ', '')"),
}

_SPAN = "struct<start: bigint, kind_no: int, stop: bigint, m: string, near: string>"
#: Items that one array grows by in a walk; arrays of them are joined at the end, so long walks stay linear.
CHUNK = 256


def _walk(items: str, zero: str, step: str, emit: str, kind: str) -> str:
    """SQL: the array of ``emit`` for each of ``items``. Both ``step`` and ``emit`` see the state ``b.at`` and the item ``x``."""
    inner = f"aggregate(part, struct(a.at AS at, cast(array() AS array<{kind}>) AS new), (b, x) -> struct({step} AS at, concat(b.new, array({emit})) AS new))"
    outer = f"element_at(transform(array({inner}), r -> struct(r.at AS at, concat(a.done, array(r.new)) AS done)), 1)"
    parts = f"transform(sequence(0, (size(items) - 1) div {CHUNK}), j -> slice(items, j * {CHUNK} + 1, {CHUNK}))"
    walk = f"flatten(aggregate({parts}, struct({zero} AS at, cast(array() AS array<array<{kind}>>) AS done), (a, part) -> {outer}, a -> a.done))"
    return f"element_at(transform(array({items}), items -> if(size(items) = 0, cast(array() AS array<{kind}>), {walk})), 1)"


def _spans(kind: str) -> Column:
    """Confirmed spans of a kind, from its matches ``m_<kind>`` and the column ``text``; ``near`` is the text just before a span."""
    no, check = KINDS.index(kind), CHECKS.get(kind, "true")
    pieces = f"slice(split(text, r'{PATTERNS[kind]}', -1), 1, size(m_{kind}))"
    items = f"zip_with({pieces}, m_{kind}, (gap, m) -> struct(gap AS gap, m AS m))"
    near = f"right(concat(b.at.tail, right(x.gap, {REACH})), {REACH})"
    step = f"struct(b.at.pos + length(x.gap) + length(x.m) AS pos, right(concat({near}, right(x.m, {REACH})), {REACH}) AS tail)"
    emit = (
        f"struct(b.at.pos + length(x.gap) AS start, {no} AS kind_no, b.at.pos + length(x.gap) + length(x.m) AS stop, x.m AS m, lower({near}) AS near)"
    )
    walk = _walk(items, "struct(0L AS pos, '' AS tail)", step, emit, _SPAN)
    return F.expr(f"CASE WHEN size(m_{kind}) > 0 THEN filter({walk}, s -> {check}) ELSE cast(array() AS array<{_SPAN}>) END")


def _score(kind: str) -> str:
    base, more, words = SCORES[kind]
    return f"({base} + if(s.near rlike '(?<![a-z])({words})(?![a-z])', {more}, 0.0))"


def _apart(spans: str) -> str:
    """SQL: ``spans``, sorted, without those of the added kinds that overlap one of the base kinds."""
    base = f"x.kind_no < {len(BASE)}"
    upto = _walk("spans", "0L", f"greatest(b.at, if({base}, x.stop, 0L))", "b.at", "bigint")
    last = f"{(1 << 62)}L"
    ahead = f"reverse({_walk('reverse(spans)', last, f'least(b.at, if({base}, x.start, {last}))', 'b.at', 'bigint')})"
    keep = f"filter(spans, (s, i) -> s.kind_no < {len(BASE)} OR (w.upto[i] <= s.start AND w.ahead[i] >= s.stop))"
    return f"element_at(transform(array({spans}), spans -> element_at(transform(array(struct({upto} AS upto, {ahead} AS ahead)), w -> {keep}), 1)), 1)"


def _digest_form(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, s -> concat(element_at(array({names}), s.kind_no + 1), ':', s.start, ':', s.stop)))"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, found: array of (kind, start, end, text, score), and base: the part of it of the base kinds."""
    found = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        matches = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if kind in HINTS:
            matches = F.when(F.contains("text", F.lit(HINTS[kind])), matches).otherwise(none)
        else:
            matches = F.when(F.col("text").rlike(DIGITS), matches).otherwise(none)
        found = found.withColumn(f"m_{kind}", matches)
    for kind in KINDS:
        found = found.withColumn(f"s_{kind}", _spans(kind))
    found = found.withColumn("base", F.expr(f"array_sort(concat({', '.join('s_' + k for k in BASE)}))"))
    added = ", ".join(f"filter(s_{k}, s -> {_score(k)} >= {MIN_SCORE})" for k in KINDS[len(BASE):])
    found = found.withColumn("extra", F.expr(f"concat({added})"))
    found = found.withColumn("spans", F.expr(f"CASE WHEN size(extra) > 0 THEN {_apart('array_sort(concat(base, extra))')} ELSE base END"))
    score = "CASE s.kind_no " + " ".join(f"WHEN {i} THEN {_score(k)}" for i, k in enumerate(KINDS)) + " END"
    names = ", ".join(f"'{k}'" for k in KINDS)
    return found.select(
        "id",
        F.expr(
            f"transform(spans, s -> struct(element_at(array({names}), s.kind_no + 1) AS kind, s.start AS start, s.stop AS stop, s.m AS value, double({score}) AS score))"
        ).alias("found"),
        *[F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(_digest_form("base")), 256).alias("base_sha256"),
        F.expr(_digest_form("spans")).alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans of personal data."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in BASE], "base_sha256", "spans", F.array_max("found.score").alias("top_score"))
