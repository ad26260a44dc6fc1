"""Personal data: regular expressions propose spans, checksums confirm them, and words near
a span adjust its score. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.spans import count_of, masked, matches, once, ordered, pages_of, piece, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")  # reported from LEAST_SCORE on
LEAST_SCORE = 0.6
NEAR = 48                # code points before a span in which context words count
CONTEXT_GAIN = 0.35

# Characters of an account number by the country that issues it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(
    rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())

# The patterns, as linear-time forms of the plain ones.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# The score of a confirmed span without context, and the words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|write to|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|credit|debit|payment|amex",
    "phone": "phone|tel|call|mobile|fax|dial",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column, _) -> Column:
    """Every part at most 255, leading zeros or not."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def _luhn(value: Column, _) -> Column:
    digits = _digits(value)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _mod97(value: Column, _) -> Column:
    """The first four characters at the end, letters as 10 to 35: the number leaves 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    left = F.aggregate(
        F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0),
        lambda rest, c: F.when(
            F.ascii(c) >= 65, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97),
    )
    return left == 1


def _issued(value: Column, _) -> Column:
    """Number ranges that are never given out."""
    return ~F.regexp_like(value, F.lit("^(000|666|9)|-00-|-0000$"))


CHECKS = {
    "email": None, "ip": _small_parts, "card": _luhn,
    "phone": lambda v, _: F.length(_digits(v)).between(10, 15), "iban": _mod97, "ssn": _issued,
}


def _possible(text: Column) -> dict[str, Column]:
    """Cheap conditions without which a kind can't occur."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": like(r"[0-9]\.[0-9]"),
        "card": like(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": F.contains(text, F.lit("+")) & like(r"\+[0-9]"),
        "iban": like(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}"),
        "ssn": like(r"[0-9]-[0-9]{2}-[0-9]"),
    }


def _with_spans(df: DataFrame, text: Column, base: str, found: str) -> DataFrame:
    """``df`` with two more columns: ordered spans of the base kinds, and all reported."""
    own = "_"
    while any(c.startswith(own) for c in df.columns):  # names that ``df`` doesn't use
        own += "_"
    name = {k: f"{own}{k}" for k in (*BASE, *ADDED, "added")}
    able = _possible(text)
    spans = {name[k]: matches(text, PATTERNS[k], k, i, CHECKS[k], able[k]) for i, k in enumerate(BASE + ADDED)}
    df = df.withColumns(spans).withColumns({
        base: ordered(*[F.col(name[k]) for k in BASE]), name["added"]: F.concat(*[F.col(name[k]) for k in ADDED])})

    def scored(s: Column, pages: Column) -> Column:
        before = F.lower(piece(pages, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]))
        start, near = F.lit(0.0), F.lit(False)
        for kind in BASE + ADDED:
            start = F.when(s["kind"] == kind, F.lit(SCORES[kind])).otherwise(start)
            near = F.when(s["kind"] == kind, F.regexp_like(before, F.lit(rf"\b(?:{CONTEXT[kind]})"))).otherwise(near)
        return s.withField("score", F.least(F.lit(1.0), start + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))))

    def reported(pages: Column) -> Column:
        some = F.filter(F.transform(name["added"], lambda s: scored(s, pages)), lambda s: s["score"] >= LEAST_SCORE)
        return ordered(F.transform(base, lambda s: scored(s, pages)), some)

    there = F.size(base) + F.size(name["added"]) > 0
    pages = F.when(there, pages_of(text)).otherwise(F.array().cast("array<string>"))
    return df.withColumn(found, once(pages, reported)).drop(*name.values())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, base, found)``, one row per row of ``docs``: found holds all spans
    (start, end, kind, value, score; code points, ends exclusive) by start and kind, base
    the spans of the four base kinds. Base spans stay whatever their score; the added kinds
    are reported from LEAST_SCORE on. A null or empty text has no spans; ids are passed on
    as they are; further columns are ignored; an empty table gives an empty table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _with_spans(rows, F.col("text"), "base", "found")


def pii_digest(docs: DataFrame, **columns) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans as written, all spans as written."""
    found = find_pii(docs, **columns)
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
    )


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span found replaced by its kind in brackets; null texts stay
    null, all other columns as they are (a column n_chars is left as the source counted it)."""
    own = "_"
    while own in (c[: len(own)] for c in docs.columns):
        own += "_"
    spans = _with_spans(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"{own}base", f"{own}found")
    return spans.withColumn(text_col, masked(F.col(text_col).cast("string"), F.col(f"{own}found"))).drop(f"{own}base", f"{own}found")
