"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account
numbers, ranges for addresses), and context words beside a span raise or lower its score.  The four
base kinds are always reported; the added kinds only from a score on.

Places come from the lengths of the matches and of the text between them, in code points.  The
patterns are the plain ones in a form that scans any text in linear time: possessive runs that
start where a run starts or where the match before ended.

Row-wise, no shuffle.  Null texts count as empty, repeated rows give repeated results, extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = "A-Za-z0-9._%+-"
#: Characters of an international bank account number by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
    "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban_pattern() -> str:
    """Country, check digits, and as many characters as the country has, in fours or not."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    kinds = []
    for length, countries in sorted(by_length.items()):
        fours, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        kinds.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return f"(?:{'|'.join(kinds)})"


PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must hold for the pattern to be worth running.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score without context, words that raise it, and words that lower it.
SCORES = {
    "email": (0.9, "mail|contact|write|courriel", "example|noreply"),
    "ip": (0.6, "ip|address|host|server", "version|release|chapter"),
    "card": (0.7, "card|visa|credit|payment|karte|carte|tarjeta", "isbn|order|serial"),
    "phone": (0.6, "phone|call|tel|mobile|fax", "order|serial|isbn"),
    "iban": (0.8, "iban|bank|account|konto|compte|cuenta", "sku|serial"),
    "ssn": (0.4, "ssn|social security", "part|serial|order"),
}
RAISE, LOWER, LEAST_ADDED, CONFIDENT, CONTEXT = 0.3, 0.3, 0.6, 0.8, 40
BLOCK = 512


def located(text: Column, pattern: str) -> Column:
    """Every match as a struct of start ``s``, end ``e``, the match ``m`` and the text beside it.
    Running sums are taken within blocks and over blocks, so many matches stay cheap."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.transform(
        F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, 2, 2_000_000_000).alias("n")),
        lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["n"].alias("n")),
    )
    pieces = F.filter(pieces, lambda x: x["m"].isNotNull())
    empty = F.expr("cast(array() as array<struct<s: int, e: int, m: string, before: string, after: string>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        row = F.struct(
            start.alias("s"), end.alias("e"), x["m"].alias("m"),
            F.lower(F.right(x["g"], F.lit(CONTEXT))).alias("before"), F.lower(F.left(x["n"], F.lit(CONTEXT))).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    def within(block):
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("rows")), step)

    def over(acc, x):
        moved = F.transform(x["rows"], lambda r: r.withField("s", r["s"] + acc["at"]).withField("e", r["e"] + acc["at"]))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["rows"], F.array(moved)).alias("rows"))

    def all_of(p):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
        nested = F.expr("cast(array() as array<array<struct<s: int, e: int, m: string, before: string, after: string>>>)")
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nested.alias("rows")), over)["rows"])

    # The one-element array binds the pieces to a name, so they are made once.
    return F.flatten(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, all_of(p)).otherwise(empty)))


def digits_of(m: Column) -> Column:
    return F.translate(m, " ().+-", "")


def luhn(m: Column) -> Column:
    backwards = F.reverse(digits_of(m))
    value = lambda i: F.substring(backwards, i, F.lit(1)).cast("int")
    doubled = lambda v: 2 * v - F.when(v > 4, 9).otherwise(0)
    terms = F.transform(F.sequence(F.lit(1), F.length(backwards)), lambda i: F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    plain = F.translate(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.lit(64)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def octets(m: Column) -> Column:
    """All parts are at most 255, leading zeros aside."""
    return F.forall(
        F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= F.lit("255")))
    )


def valid(kind: str, x: Column) -> Column:
    m, n = x["m"], F.length(digits_of(x["m"]))
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.translate(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)
    if kind == "ssn":
        edges = F.right(x["before"], F.lit(1)).rlike("[0-9-]") | F.left(x["after"], F.lit(1)).rlike("[0-9-]")
        return ~edges & ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def score(kind: str, x: Column) -> Column:
    start, up, down = SCORES[kind]
    beside = F.concat_ws(" ", x["before"], x["after"])
    return F.lit(start) + F.when(beside.rlike(up), RAISE).otherwise(0.0) - F.when(beside.rlike(down), LOWER).otherwise(0.0)


def spans_of(kind: str, text: Column) -> Column:
    place = KINDS.index(kind)
    rows = F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x))
    rows = F.transform(rows, lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("k"), x["e"].alias("e"), score(kind, x).alias("score")))
    if kind in ADDED_KINDS:
        rows = F.filter(rows, lambda x: x["score"] >= LEAST_ADDED)
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int, score: double>>)")
    return F.when(HINTS[kind](text), rows).otherwise(none)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_findings: bool = False) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, and how
    many of them score high; with the scored spans themselves if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", *[spans_of(k, F.col("text")).alias(k) for k in KINDS])
    everything = F.concat(*KINDS)
    names = F.array(*[F.lit(k) for k in KINDS])
    findings = F.transform(
        F.array_sort(everything), lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["score"])
    )
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.concat(*BASE_KINDS)), 256).alias("base_sha256"),
        listed(everything).alias("spans"),
        F.size(F.filter(everything, lambda x: x["score"] >= CONFIDENT)).cast("long").alias("n_confident"),
        *([findings.alias("findings")] if with_findings else []),
    )


def _oracle() -> str:
    """The same in SQL with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PATTERNS["phone"], "iban": PATTERNS["iban"], "ssn": PATTERNS["ssn"],
    }
    digits = "translate(m, ' ().+-', '')"
    luhn_sql = f"""list_sum(list_transform(range(1, len({digits}) + 1), lambda i: case when i % 2 = 0
      then 2 * cast(reverse({digits})[i] as int) - case when cast(reverse({digits})[i] as int) > 4 then 9 else 0 end
      else cast(reverse({digits})[i] as int) end)) % 10 = 0"""
    turned = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    mod_sql = f"""cast(list_aggregate(list_transform(string_split({turned}, ''), lambda c: case when c between 'A' and 'Z'
      then cast(ascii(c) - 55 as varchar) else c end), 'string_agg', '') as hugeint) % 97 = 1"""
    tests = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 2 or (len(ltrim(p, '0')) = 3 and ltrim(p, '0') <= '255')))",
        "card": f"case when len({digits}) between 14 and 19 then {luhn_sql} else false end",
        "phone": f"len({digits}) between 10 and 15",
        "iban": f"case when len(replace(m, ' ', '')) between 15 and 34 then {mod_sql} else false end",
        "ssn": "not regexp_matches(right(g, 1) || left(n, 1), '[0-9-]') and not regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    parts = []
    for place, kind in enumerate(KINDS):
        base, up, down = SCORES[kind]
        beside = f"lower(right(g, {CONTEXT})) || ' ' || lower(left(n, {CONTEXT}))"
        parts.append(f"""
  select rid, '{kind}' as kind, {place} as k, s, s + len(m) as e,
    {base} + case when regexp_matches({beside}, '{up}') then {RAISE} else 0 end - case when regexp_matches({beside}, '{down}') then {LOWER} else 0 end as score
  from (
    select rid, ms[i] as m, gs[i] as g, gs[i + 1] as n,
      list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) as s
    from (
      select rid, ms, gs, unnest(range(1, len(ms) + 1)) as i
      from (select rid, regexp_extract_all(text, '{plain[kind]}') as ms, regexp_split_to_array(text, '{plain[kind]}') as gs from d)
    )
  ) where {tests[kind]}""")
    counts = ", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in BASE_KINDS)
    each = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_KINDS)
    least = f"k < {len(BASE_KINDS)} or score >= {LEAST_ADDED} - 1e-9"
    label = "kind || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(parts)}),
summed as (
  select rid, {each}, string_agg({label}, ',' order by s, k) filter (where k < {len(BASE_KINDS)}) as base,
    string_agg({label}, ',' order by s, k) as spans, count(*) filter (where score >= {CONFIDENT} - 1e-9) as n_confident
  from found where {least} group by rid
)
select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, cast(coalesce(n_confident, 0) as bigint) as n_confident
from d left join summed using (rid)
"""


ORACLE_SQL = _oracle()
