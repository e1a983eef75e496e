"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod-97 for
IBANs) and value ranges confirm them, and words near a span raise its score.
The four base kinds are reported whatever their score; the further kinds only
from ``CUT`` on, which a social security number reaches only next to a word
that speaks for it.

A pattern is matched twice, once for the matches and once for the pieces
between them; the lengths of both give the offsets in code points.  Texts that
a cheap test rules out skip this.  The patterns are written so that no text
makes them backtrack: possessive repeats, and starts only where the previous
match ended or the run of characters begins.

An IBAN is proposed by its head (country and check digits) alone, and its end
is looked for among the blanks and the end of the run behind it, so that
neither the words that follow nor a head before it hide a valid one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spare

CUT = 0.5  #: least score of a span of a further kind
BEFORE, AFTER = 50, 30  #: characters around a span that may hold context words
BOOST = 0.4  #: what a context word adds to a score
#: Characters of an IBAN without blanks, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class Kind:
    """A kind of span: how it is proposed, confirmed and scored."""

    name: str
    base: bool
    pattern: str  #: Java's dialect; of an IBAN the head, and as groups the run from there and a letter or digit after it
    plain: str  #: the same language without look-around, for reference SQL; of an IBAN with the longest run behind the head
    hint: str  #: cheap necessary condition on the whole text
    score: float
    context: str  #: words that raise the score


KINDS = (
    Kind("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", 0.6, "mail|contact|write|address"),
    Kind("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.5, "ip|host|server|address|login"),
    Kind("card", True, r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11,}", r"[0-9](?:[\x20-]?[0-9]){11}", 0.6, "card|credit|debit|visa|payment|account"),
    Kind("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.5, "phone|tel|call|mobile|fax|number"),
    Kind("iban", False, r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+)([A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,}", r"[A-Z]{2}[0-9]{2}", 0.6, "iban|bank|account|transfer"),
    Kind("ssn", False, r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.2, "ssn|social|security"),
)


CHUNK = 1000  #: code points of the pieces in which long texts are cut, so that no span is looked up from the text's beginning
RUN = 256  #: spans that are gathered before they go to the others, so that gathering copies few


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """The part of a text that begins at an offset."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.least(F.floor((start + length) / CHUNK).cast("int"), F.size(chunks) - 1)
    joined = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(joined, start - first * CHUNK + 1, length)


def _gathered(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a pass over the items gives out, as an array of ``kind``.

    ``step(at, item)`` returns the next ``at`` (an integer that begins as 0)
    and the array of what the item gives.  Runs of items are gathered on their own.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], out).alias("out"))

    def run(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _let(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / RUN).cast("int")), lambda b: F.slice(all_, b * RUN + 1, F.lit(RUN)))
    return _let(items, lambda all_: F.aggregate(blocks(all_), F.struct(F.lit(0).alias("at"), none.alias("out")), run, lambda acc: acc["out"]))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has the check sum 0."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an IBAN without blanks leaves the remainder 1."""
    moved = F.concat(F.substring(text, 5, 100), F.substring(text, 1, 4))
    value = lambda ch: F.ascii(ch) - F.when(ch >= "A", 55).otherwise(48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise((a * F.when(ch >= "A", 100).otherwise(10) + value(ch)) % 97)) == 1


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, "[.]"), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|^...-00-|-0000$")
    return F.lit(True)


def _bare(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _iban(run: Column, after: Column) -> Column:
    """The IBAN at the beginning of a run, or null.

    It ends at a blank or with the run, before anything but a letter or digit,
    and has the check sum.  Of several ends the one at the country's length
    counts, else the end of the whole run; countries that are not listed take
    the last end.
    """
    listed = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)])
    length = F.try_element_at(listed, F.substring(run, 1, 2))

    def end(words: Column, k: Column) -> Column:
        hit = F.array_join(F.slice(words, 1, k), " ")
        n = F.length(_bare(hit))
        return F.struct((n == length).alias("fits"), (k == F.size(words)).alias("last"), n.alias("n"), hit.alias("hit"))

    ends = F.flatten(F.transform(F.array(F.split(run, " ")), lambda words: F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: end(words, k))))
    ends = F.filter(ends, lambda e: e["n"].between(15, 34) & ~(e["last"] & (after != "")) & (length.isNull() | e["fits"] | e["last"]))
    return F.array_max(F.filter(ends, lambda e: _mod97(_bare(e["hit"]))))["hit"]


_SPAN = "struct<start:int,end:int,hit:string>"


def _apart(spans: Column) -> Column:
    """Spans in order without those that begin within one before."""
    none = F.array().cast(f"array<{_SPAN}>")
    return _gathered(spans, _SPAN, lambda at, s: (F.when(s["start"] < at, at).otherwise(s["end"]), F.when(s["start"] < at, none).otherwise(F.array(s))))


def _ibans(text: Column, kind: Kind, heads: Column) -> Column:
    """The spans of the IBANs that begin with some of the heads."""
    group = lambda k: F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(k))
    hits = F.zip_with(group(1), group(2), _iban)
    whole = F.zip_with(heads, hits, lambda s, hit: F.struct(s["start"].alias("start"), (s["start"] + F.length(hit)).alias("end"), hit.alias("hit")))
    return _apart(F.filter(whole, lambda s: s["hit"].isNotNull()))


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: ``start, rank, kind, end, hit``."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.zip_with(F.split(text, kind.pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.coalesce(end, at), F.when(x["hit"].isNull(), none).otherwise(F.array(span))

    proposed = _gathered(parts, _SPAN, step)
    found = _ibans(text, kind, proposed) if kind.name == "iban" else F.filter(proposed, lambda s: _valid(kind.name, s["hit"]))
    rank = [k.name for k in KINDS].index(kind.name)
    scored = lambda chunks: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), F.lit(kind.base).alias("base"), _score(chunks, kind, s).alias("score"))
    named = _let(_chunks(text), lambda chunks: F.transform(found, scored(chunks)))
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,base:boolean,score:double>>")
    return F.when(hint, F.filter(named, lambda s: s["base"] | (s["score"] >= CUT))).otherwise(none)


def _score(chunks: Column, kind: Kind, span: Column) -> Column:
    first = F.greatest(span["start"] - BEFORE, F.lit(0))
    before = _part(chunks, first, span["start"] - first)
    after = _part(chunks, span["end"], F.lit(AFTER))
    near = F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"(?:^|[^a-z])(?:{kind.context})(?:[^a-z]|$)")
    return F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0)


def found_spans(text: Column) -> Column:
    """All spans of a text as an array of ``start, rank, kind, end, base, score``, by start and kind."""
    given = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(given, k) for k in KINDS]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores`` for every document.

    The counts and the hash are of the base kinds; ``spans`` lists all spans as
    ``kind:start:end`` (code points, end exclusive) and ``scores`` their scores
    in the same order, in percent.  Null and empty texts have no spans.  Rows
    are read one by one: repeated rows and null ids pass; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", found_spans(F.col("text")).alias("found"))
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("found", lambda s: s["base"])
    scores = F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return rows.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), scores.alias("scores"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    text = F.col(text_col)
    (found,) = spare(docs.columns, "found")

    def clean(chunks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            kept = F.array(_part(chunks, at, s["start"] - at), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["start"] < at, at).otherwise(s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(kept)

        end = F.struct(F.length(text).alias("start"), F.lit(0).alias("rank"), F.lit("").alias("kind"), F.length(text).alias("end"), F.lit(True).alias("base"), F.lit(0.0).alias("score"))
        pieces = _gathered(F.concat(F.col(found), F.array(end)), "string", step)
        return F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "")

    rows = docs.withColumn(found, found_spans(text))
    return rows.withColumn(text_col, F.when(F.size(found) > 0, _let(_chunks(text), clean)).otherwise(text)).drop(found)


def reference_sql() -> str:
    """The same rows in DuckDB's SQL, with the plain patterns."""
    parts, wanted = [], []
    for rank, k in enumerate(KINDS):
        p = k.plain.replace("'", "''")
        t = f"t_{k.name}"
        digits = "regexp_replace(h, '[^0-9]', '', 'g')"
        valid = {
            "email": "true",
            "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda q: coalesce(try_cast(q as hugeint) <= 255, false)))",
            "card": f"length({digits}) between 12 and 19 and list_sum(list_transform(string_split(reverse({digits}), ''), lambda d, i: case when i % 2 = 0 then case when d::int > 4 then d::int * 2 - 9 else d::int * 2 end else d::int end)) % 10 = 0",
            "phone": f"length({digits}) between 9 and 15",
            "iban": "length(replace(h, ' ', '')) between 15 and 34 and list_reduce(list_concat([0], list_transform(string_split(substring(replace(h, ' ', ''), 5) || substring(replace(h, ' ', ''), 1, 4), ''), lambda c: ascii(c) - case when c >= 'A' then 55 else 48 end)), lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1",
            "ssn": "not regexp_matches(h, '^(?:000|666|9)|^...-00-|-0000$')",
        }[k.name]
        parts.append(f"{t} as (select r, t, h, cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i-1], lambda x: length(x))), 0) as bigint) as s from (select r, t, p, hs, unnest(hs) as h, unnest(range(1, len(hs) + 1)) as i from (select r, t, string_split_regex(t, '{p}') as p, regexp_extract_all(t, '{p}') as hs from d)))")
        near = f"regexp_matches(lower(substring(t, greatest(s - {BEFORE}, 0) + 1, s - greatest(s - {BEFORE}, 0)) || ' ' || substring(t, s + length(h) + 1, {AFTER})), '(?:^|[^a-z])(?:{k.context})(?:[^a-z]|$)')"
        edge = "" if k.base else " and not regexp_matches(coalesce(nullif(substring(t, s, case when s > 0 then 1 else 0 end), ''), ' ') || coalesce(nullif(substring(t, s + length(h) + 1, 1), ''), ' '), '[A-Za-z0-9" + ("-" if k.name == "ssn" else "") + "]')"
        score = f"({k.score} + case when {near} then {BOOST} else 0 end)"
        wanted.append(f"select r, s, {rank} as rank, '{k.name}' as kind, s + length(h) as e, {str(k.base).lower()} as base, cast(round({score} * 100) as int) as score from {t} where {valid}{edge}" + ("" if k.base else f" and {score} >= {CUT}"))
    return (
        "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), " + ", ".join(parts) + ", f as (" + " union all ".join(wanted) + ") "
        "select d.doc_id, " + ", ".join(f"count(*) filter (where kind = '{k.name}') as n_{k.name}" for k in KINDS if k.base) + ", "
        "sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where base), '')) as base_sha256, "
        "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '') as spans, coalesce(string_agg(score::varchar, ',' order by s, rank), '') as scores "
        "from d left join f using (r) group by d.r, d.doc_id"
    )
