"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them come from the same engine, so the places of
the matches are running sums of the lengths of both, taken in strides. The patterns are written so that a text of any
length is read in linear time: runs are taken possessively and may only start where a run starts. Context is the end of
the piece before a match and the beginning of the piece after it, so it never needs the whole text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LOCAL = "[A-Za-z0-9._%+-]"
SPAN = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 when its moved letters and digits are divided by 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _octets(match: Column) -> Column:
    parts = F.transform(F.split(match, "\\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that a text with a match passes; ``near`` are words around a match, or with a
    final $ right before it, that speak for the kind; ``known`` is a form that does. Spans of a score below ``accept`` go."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    score: float
    near: str
    accept: float = 0.0
    known: str = ""


BASE = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", lambda m: F.lit(True), 0.8, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+", r"[0-9]\.[0-9]", _octets, 0.6, "ip|host|server|addr|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9][\x20-]?[0-9]", lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), 0.7, "card|visa|credit|pay|konto|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
)
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"
SECRET = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[A-Za-z0-9_-]{16,64})\b"
EXTRA = (
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.7, "iban|bank|account|konto|cuenta|compte", 0.5),
    # a long word of letters and digits is a secret if it has a known form or if words like these stand by
    Kind("secret", SECRET, "[A-Za-z0-9_-]{16}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.4, "(?:password|passwd|pwd|secret|token|api_?key)[\"']?\\s*[=:]\\s*[\"']?$", 0.5, "^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})$"),
)
WINDOW, BONUS, STRIDE = 40, 0.2, 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body needs it in a lambda of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(sizes: Column) -> Column:
    """Sums of all the sizes before each, as an array: strides are added up first, so that work stays near linear."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRIDE).cast("int")), lambda s: F.slice(sizes, s * STRIDE + 1, F.lit(STRIDE)))

    def within(sums: Column) -> Callable[[Column, Column], Column]:
        inside = lambda part, base: F.transform(part, lambda x, i: base + total(F.slice(part, F.lit(1), i)))
        return lambda part, s: _let(total(F.slice(sums, F.lit(1), s)), lambda base: inside(part, base))

    return _let(strides, lambda parts: _let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, within(sums)))))


def _spans(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind in text order."""

    def span(match: Column, i: Column, pieces: Column, before: Column) -> Column:
        left, right = F.element_at(pieces, i + 1), F.element_at(pieces, i + 2)
        around = F.lower(left.right) if kind.near.endswith("$") else F.lower(F.concat(left.right, F.lit("\n"), right.left))
        score = F.lit(kind.score) + F.when(around.rlike(kind.near), BONUS).otherwise(0.0)
        if kind.known:
            score = score + F.when(match.rlike(kind.known), BONUS).otherwise(0.0)
        start = F.element_at(before, i + 1) + left.size
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.round(score, 2).alias("score"), kind.valid(match).alias("ok"))

    def told(matches: Column, pieces: Column) -> Column:
        sizes = F.transform(matches, lambda x, i: F.element_at(pieces, i + 1).size + F.length(x))
        each = _let(sizes, lambda z: _let(_before(z), lambda before: F.transform(matches, lambda x, i: span(x, i, pieces, before))))
        return F.transform(F.filter(each, lambda s: s.ok & (s.score >= kind.accept)), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.match.alias("match"), s.score.alias("score")))

    piece = lambda p: F.struct(F.length(p).alias("size"), F.left(p, F.lit(WINDOW)).alias("left"), F.right(p, F.lit(WINDOW)).alias("right"))
    pieces = F.transform(F.split(text, kind.pattern, -1), piece)
    found = F.when(text.rlike(kind.hint), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(SPAN)
    return _let(found, lambda m: F.when(F.size(m) > 0, _let(pieces, lambda p: told(m, p)).cast(SPAN)).otherwise(none))


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE + EXTRA) -> DataFrame:
    """``docs`` with one column <kind>_spans for each kind: kind, start, end (code points, end exclusive), match, score.

    Matches are leftmost and do not overlap within a kind; those whose checksum or range fails are dropped, and those
    whose score, context included, is below the kind's ``accept``. Null and empty texts have no spans. No shuffle: each
    row is read where it lies. Columns named as the new ones are replaced; equal rows stay; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({f"{kind.name}_spans": _spans(kind, text) for kind in kinds})


def _listed(spans: list[Column]) -> Column:
    each = F.transform(F.concat(*spans), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(each, ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [F.col(f"{k.name}_spans") for k in BASE]
    every = [F.col(f"{k.name}_spans") for k in BASE + EXTRA]
    counts = [F.size(c).cast("long").alias(f"n_{k.name}") for k, c in zip(BASE, base)]
    scores = F.array_join(F.transform(F.concat(*every), lambda s: F.round(s.score * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), scores.alias("scores"), F.size(F.concat(*every)).cast("long").alias("n_spans"))


def _sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "secret": SECRET,
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({digits}[len({digits}) - i] AS INT) ELSE (CAST({digits}[len({digits}) - i] AS INT) * 2) // 10 + (CAST({digits}[len({digits}) - i] AS INT) * 2) % 10 END))"
    moved = "replace(m, ' ', '')"
    coded = f"list_reduce(list_prepend(0, list_transform(string_split({moved}[5:] || {moved}[:4], ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN 100 + ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda r, x: CASE WHEN x >= 100 THEN (r * 100 + x - 100) % 97 ELSE (r * 10 + x) % 97 END)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"{coded} = 1",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    score = {}
    for k in BASE + EXTRA:
        around = "lower(right(gaps[i], 40))" if k.near.endswith("$") else "lower(right(gaps[i], 40) || chr(10) || left(gaps[i + 1], 40))"
        near = k.near.replace("'", "''")
        score[k.name] = f"{round(k.score * 100)} + CASE WHEN regexp_matches({around}, '{near}') THEN 20 ELSE 0 END"
        score[k.name] += f" + CASE WHEN regexp_matches(m, '{k.known}') THEN 20 ELSE 0 END" if k.known else ""
    accept = {k.name: round(k.accept * 100) for k in BASE + EXTRA}
    parts = []
    for order, (name, pattern) in enumerate(patterns.items()):
        parts.append(f"""
        SELECT doc_id, {order} AS kind_order, '{name}' AS kind, m,
               list_sum(list_transform(gaps[:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0) AS s, {score[name]} AS score
        FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i, ms, gaps FROM
              (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM texts))
        WHERE {valid[name]} AND {score[name]} >= {accept[name]}""")
    union = "\nUNION ALL".join(parts)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({union}),
    told AS (SELECT *, kind || ':' || s || ':' || (s + len(m)) AS span FROM found)
    SELECT d.doc_id,
           count(*) FILTER (WHERE kind_order = 0) AS n_email, count(*) FILTER (WHERE kind_order = 1) AS n_ip,
           count(*) FILTER (WHERE kind_order = 2) AS n_card, count(*) FILTER (WHERE kind_order = 3) AS n_phone,
           sha256(coalesce(string_agg(span, ',' ORDER BY kind_order, s) FILTER (WHERE kind_order < 4), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY kind_order, s) FILTER (WHERE kind_order IS NOT NULL), '') AS spans,
           coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY kind_order, s) FILTER (WHERE kind_order IS NOT NULL), '') AS scores, count(kind_order) AS n_spans
    FROM documents d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id"""


OP4_SQL = _sql()
