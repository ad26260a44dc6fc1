"""Secrets: patterns propose spans, and weak candidates are linked to complementary parts.

A credential often has several parts: an access identifier, a secret, an endpoint. The base
patterns are strong enough to be reported alone. Weak candidates (a bare random-looking
token, a short password, a named account, a web address) are reported only if complementary
parts lie within the same scope, a paragraph of the text. All candidates and the ends of the
paragraphs go by their places through one sorted interval join. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.spans import count_of, matches, once, ordered, running, running_sums, written

BASE = ("assign", "access", "hex")
WEAK = ("bare", "short", "account", "endpoint")
IDENTIFIERS = ("access", "account")
SECRETS = ("assign", "bare", "short")

# The patterns, runs of one alphabet in linear-time form.
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": _ASSIGN,
    "access": "AKIA[A-Z0-9]+",
    "hex": "(?<![0-9a-f])[0-9a-f]{16,}+",
    "bare": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}+",
    "short": _ASSIGN,
    "account": r"""(?i:client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""",
    "endpoint": r"""(?<![A-Za-z])(?:https?|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"'<>]+""",
}
BLANK_LINE = r"\n[\x20\t\r]*+\n"
GROUPS = {"assign": 2, "short": 2}


def _random_looking(value: Column, _) -> Column:
    """Letters of both cases and digits: not a word, a path or a plain number."""
    return F.regexp_like(value, F.lit("[a-z]")) & F.regexp_like(value, F.lit("[A-Z]")) & F.regexp_like(value, F.lit("[0-9]"))


CHECKS = {
    "assign": lambda _, part: F.length(part) >= 12,
    "access": lambda v, _: F.length(v) >= 18,
    "hex": None,
    "bare": _random_looking,
    "short": lambda _, part: F.length(part).between(6, 11),
    "account": None,
    "endpoint": None,
}


def _linked(parts: Column) -> Column:
    """The weak ones of a text's ordered candidates and paragraph ends that have their
    complementary parts in their paragraph. Two running results find the last paragraph at or
    before, and the first at or after a place, that holds a part: no pairs are formed."""
    def holds(scopes: Column, kinds: tuple[str, ...]) -> Column:
        own = F.transform(parts, lambda p, i: F.when(p["kind"].isin(*kinds), F.get(scopes, i)))
        return once(
            F.struct(running(own, F.greatest).alias("last"), F.reverse(running(F.reverse(own), F.least)).alias("next")),
            lambda near: F.transform(scopes, lambda scope, i: F.coalesce(F.get(near["last"], i) == scope, F.lit(False))
                                     | F.coalesce(F.get(near["next"], i) == scope, F.lit(False))),
        )

    def weak(found: Column) -> Column:
        judged = F.transform(parts, lambda p, i: F.struct(
            p.alias("part"), F.get(found["identifier"], i).alias("identifier"), F.get(found["secret"], i).alias("secret")))
        kind = lambda j: j["part"]["kind"]
        kept = F.filter(judged, lambda j: F.when(kind(j).isin("bare", "short"), j["identifier"]).when(
            kind(j) == "account", j["secret"]).when(kind(j) == "endpoint", j["identifier"] & j["secret"]).otherwise(F.lit(False)))
        return F.transform(kept, lambda j: j["part"])

    scopes = running_sums(F.transform(parts, lambda p: (p["kind"] == "blank").cast("int")))
    return once(scopes, lambda s: once(
        F.struct(holds(s, IDENTIFIERS).alias("identifier"), holds(s, SECRETS).alias("secret")), weak))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, found, base)``, one row per row of ``docs``: found holds all spans
    (start, end, kind, value; code points, ends exclusive) by start and kind, base those of
    the base kinds, which always stay.

    Identifiers are access keys and accounts; secrets are assignments, bare tokens and short
    passwords. A weak secret needs an identifier in its paragraph (lines up to a blank one,
    however long), an account needs a secret, and an endpoint needs both. A null or empty text has no spans; further columns are ignored;
    an empty table gives an empty table."""
    text = F.col("text")
    like = lambda p: F.regexp_like(text, F.lit(p))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_named", like(_KEYWORD)).withColumn("_keyed", F.contains(text, F.lit("AKIA")))
    rows = rows.withColumn("_called", like(r"(?i:client_?id|account|user|login)[a-zA-Z_]*[\"']?\x20*[:=]"))
    able = {
        "assign": F.col("_named"), "access": F.col("_keyed"), "hex": None, "short": F.col("_named"),
        # a weak part alone is never reported, so its complement must be there
        "bare": F.col("_keyed") | F.col("_called"), "account": F.col("_called"),
        "endpoint": (F.col("_keyed") | F.col("_called")) & F.contains(text, F.lit("://")),
    }
    raw = rows.select("doc_id", "text", *[
        matches(text, PATTERNS[k], k, i, CHECKS[k], able[k], GROUPS.get(k)).alias(k) for i, k in enumerate(BASE + WEAK)
    ])

    blank = matches(text, BLANK_LINE, "blank", len(PATTERNS), when=F.contains(text, F.lit("\n")))
    every = ordered("access", "account", "assign", "bare", "short", "endpoint", blank)
    some = F.when(
        (F.size("bare") + F.size("short") + F.size("account") + F.size("endpoint")) > 0, once(every, _linked)).otherwise(F.lit(None))
    return raw.select("doc_id", "text", ordered(*BASE).alias("base"), some.alias("added")).select(
        "doc_id", "text", "base", F.when(F.size("added") > 0, ordered("base", "added")).otherwise(F.col("base")).alias("found")
    )


def secret_digest(docs: DataFrame, **columns) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans as written, all spans as written."""
    found = find_secrets(docs, **columns)
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
    )
