"""Personal data in texts, with built-in expressions only.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for bank
account numbers), and words near a span move its score. Base kinds (email, ip,
card, phone) are decided by pattern and checksum alone; the method's further
kinds (iban, ssn) must also reach KEEP after context.

A pattern is applied twice, once to extract the matches and once to split around
them, which gives the offsets in code points without leaving the JVM. Possessive
quantifiers and look-behinds keep every pattern linear and free of recursion, so
very long digit runs or words are safe; they match exactly what the plain forms
in the docstring of ``find`` match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test a text must pass before the pattern is tried.
    gate: str
    base: bool
    score: float
    #: Words that raise the score when found before the span or after it.
    context: str
    #: The pattern matches a head and captures what may follow it; ``ended`` decides how much does.
    headed: bool = False


#: Code points on each side of a span that context words are looked for in.
NEAR = 40
RAISE, KEEP = 0.35, 0.6

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, r"(?i)\b(?:mail|e-mail|email|contact|write)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", True, 0.6, r"(?i)\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True, 0.8, r"(?i)\b(?:card|credit|debit|visa|pay|paid)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", True, 0.7, r"(?i)\b(?:phone|call|tel|mobile|fax|whatsapp)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))", "[0-9]", False, 0.8, r"(?i)\b(?:iban|account|bank|transfer|konto)\b", True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", False, 0.4, r"(?i)\b(?:ssn|social|security|insurance)\b"),
)

#: Length of an account number by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the sum must end in 0."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    total = F.aggregate(
        F.transform(back, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters go last, letters count from 10, the rest over 97 is 1."""
    compact = F.replace(iban, F.lit(" "))
    chars = F.filter(F.split(F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4))), ""), lambda x: x != "")
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda a, x: F.when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97),
    )
    return rest == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = digits_of(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 3) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return m.isNotNull()
    if kind == "ssn":
        return ~F.left(m, F.lit(3)).isin("000", "666") & (F.left(m, F.lit(1)) != "9") & (F.substr(m, F.lit(5), F.lit(2)) != "00") & (F.right(m, F.lit(4)) != "0000")
    return F.lit(True)


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once; a plain expression inside a lambda
    would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ended(run: Column) -> Column:
    """The account number that a run starts with: the words after it may look like
    its groups, so each end of a word is tried. Of several that pass mod 97 the one
    of the country's length is taken, else the longest; null when none passes."""
    size = lambda p: F.length(F.replace(p, F.lit(" ")))
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split(run, " "))), lambda k: F.call_function("substring_index", run, F.lit(" "), k))
    good = F.filter(ends, lambda p: size(p).between(15, 34) & ~p.rlike("[a-z]") & mod97(p))
    fits = lambda p: F.contains(F.lit(IBAN_LENGTHS), F.concat(F.left(p, F.lit(2)), size(p).cast("string")))
    return let(good, lambda v: F.coalesce(F.get(F.filter(v, fits), F.lit(0)), F.get(v, F.size(v) - 1)))


def apart(spans: Column) -> Column:
    """Spans in order of start without those that begin inside one before them; as
    heads alone are matched, a later one may lie in an earlier number."""
    last = lambda a: F.element_at(a, -1)["end"]
    clear = lambda v: F.aggregate(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1), lambda a, s: F.when(s["start"] < last(a), a).otherwise(F.concat(a, F.array(s))))
    return let(spans, lambda v: F.when(F.exists(F.transform(v, lambda s, i: s["start"] < F.get(v, i - 1)["end"]), lambda x: F.coalesce(x, F.lit(False))), clear(v)).otherwise(v))


#: Matches whose lengths are summed one by one; earlier ones go by block.
BLOCK = 256


def confirmed_matches(text: Column, kind: Kind, scored) -> Column:
    """What scored makes of the confirmed matches, with their offsets, and the
    matches and pieces they come from. Match i starts after the pieces 0 to i and
    the matches before it; the lengths are summed in blocks, so that a text with very
    many matches is not summed from its start for each."""
    add = lambda a, x: a + x
    found = lambda group: F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group))
    parts = F.struct(found(0).alias("m"), F.split(text, kind.pattern, -1).alias("p"), *[found(1).alias("t")] * kind.headed)
    more = lambda v: [v["t"].alias("t")] * kind.headed
    whole_of = lambda v, m, i: ended(F.concat(m, F.get(v["t"], i))) if kind.headed else m

    def measured(v: Column) -> Column:
        lens = F.transform(v["m"], lambda m, i: F.length(m) + F.length(F.get(v["p"], i)))
        return let(F.struct(v["m"].alias("m"), v["p"].alias("p"), *more(v), lens.alias("n")), blocked)

    def blocked(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["n"]) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v["n"], b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
        before = F.aggregate(whole, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(F.struct(v["m"].alias("m"), v["p"].alias("p"), *more(v), v["n"].alias("n"), before.alias("b")), placed)

    def placed(v: Column) -> Column:
        start = lambda i: F.get(v["b"], F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(v["n"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), add) + F.length(F.get(v["p"], i))
        every = F.transform(v["m"], lambda m, i: F.struct(whole_of(v, m, i).alias("m"), i.alias("i")))
        ok = F.filter(every, lambda s: confirmed(kind.name, s["m"]))
        at = F.transform(ok, lambda s: let(start(s["i"]), lambda x: F.struct(s["m"].alias("m"), s["i"].alias("i"), x.alias("start"), (x + F.length(s["m"])).alias("end"))))
        return let(at, lambda o: F.when(F.size(o) > 0, scored(v, o)).otherwise(F.array().cast(SPANS)))

    return let(parts, lambda v: F.when(F.size(v["m"]) > 0, measured(v)).otherwise(F.array().cast(SPANS)))


def spans_of(text: Column, kind: Kind) -> Column:
    def scored(v: Column, ok: Column) -> Column:
        """Context comes from the pieces and matches around a match, of each of which
        the ends that can lie near are cut once, so its cost does not grow with the text."""
        tails = F.transform(v["m"], lambda m, i: F.concat(F.right(F.get(v["p"], i), F.lit(NEAR)), F.right(m, F.lit(NEAR))))
        few = NEAR // 2  # a match has two code points at least
        before = lambda z, i: F.concat(F.array_join(F.slice(z, F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few))), ""), F.right(F.get(v["p"], i), F.lit(NEAR)))
        near = lambda z, i: F.concat(F.right(before(z, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(v["p"], i + 1), F.lit(NEAR)))
        score = lambda z, s: F.lit(kind.score) + F.when(near(z, s["i"]).rlike(kind.context), F.lit(RAISE)).otherwise(F.lit(0.0))
        out = lambda z: F.transform(apart(ok) if kind.headed else ok, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score(z, s), F.lit(1.0)).alias("score")))
        return let(tails, out).cast(SPANS)

    out = confirmed_matches(text, kind, scored)
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(kind.gate), out).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one ``<kind>_spans`` column for each kind: kind, start, end (code
    points, end exclusive) and score, in order of start; leftmost matches that
    don't overlap others of their kind. Plain forms of the base patterns:

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``,
    ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts up to 255,
    card ``[0-9]([ -]?[0-9])+`` with 16 to 19 digits that pass Luhn,
    phone ``\\+[0-9][ ().0-9-]+[0-9]`` with 8 to 15 digits.

    An iban is two capitals, two digits and 11 to 30 capitals or digits, each with
    at most one space before it, that end with a word and pass mod 97.

    Null and empty texts have no spans. Rows are independent, so ids, repeated
    rows and other columns don't matter; columns of the same names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"{k.name}_spans": spans_of(whole, k) for k in KINDS})


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Counts and span lists of a result of find."""
    base = F.concat(*[F.col(f"{k.name}_spans") for k in KINDS if k.base])
    every = F.concat(*[F.col(f"{k.name}_spans") for k in KINDS])
    return docs.select(
        id_,
        *[F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )


def run(docs: DataFrame) -> DataFrame:
    return digest(find(docs.select("doc_id", "text")))
