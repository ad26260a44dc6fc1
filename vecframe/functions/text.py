"""Text scalars and the chunker (P1-P3, P6, P8, P11-P13), all as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.session import spread

# The characters Python's str.strip() removes (str.isspace), written as one
# regex class usable by both Java regex and RE2.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"\A{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+\z"

# Default file extensions of the file-corpus loader.
DEFAULT_EXTS = ["txt", "md", "markdown", "rst", "json", "jsonl", "csv"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The same 29 characters as one string, in code point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(text) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    A character-set trim (``btrim``), not a regex: it only touches the ends of the text."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def truncate(text, max_chars: int) -> Column:
    """Keep the first ``max_chars`` characters; 0 or None means no limit."""
    if not max_chars:
        return _c(text)
    return F.substring(_c(text), 1, int(max_chars))


def normalize_exts(exts: Iterable[str] | None) -> list[str]:
    """The allow-list (S4) as lower-case extensions with their dot; blanks are no extension."""
    bare = map(str.lower, map(str.strip, DEFAULT_EXTS if exts is None else exts))
    return [f"{'' if e.startswith('.') else '.'}{e}" for e in filter(None, bare)]


def path_extension(path, strip_query: bool = False) -> Column:
    """``os.path.splitext`` extension of the last path part ('' when none; leading dots of
    the name do not start an extension). With ``strip_query`` the URL query and fragment
    are removed first."""
    p = _c(path)
    if strip_query:
        p = F.regexp_extract(p, r"^[^?#]*", 0)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]*)$", 1)


def ext_allowed(path, exts: Iterable[str] | None = None, strip_query: bool = False) -> Column:
    """Case-insensitive allow-list test on the extension."""
    return F.lower(path_extension(path, strip_query)).isin(normalize_exts(exts))


def topic_from_ext(ext) -> Column:
    """Extension without the dot, else ``'file'``."""
    return F.coalesce(F.nullif(F.regexp_replace(_c(ext), r"^\.+", ""), F.lit("")), F.lit("file"))


def preview(text, n: int = 50) -> Column:
    """First ``n`` characters and an ellipsis."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def fmt(x, spec: str, missing: str = "N/A") -> Column:
    """Python ``f"{x:.Nf}"`` for ``spec='%.Nf'``, with a placeholder for missing values.

    ``format_number`` with a ``0.00`` pattern rounds the exact binary value half-even, as
    Python does; ``format_string('%.2f')`` would round the shortest decimal form half-up
    (36.175 -> 36.18 instead of 36.17)."""
    import re

    m = re.fullmatch(r"%\.(\d+)f", spec)
    if not m:
        return F.coalesce(F.format_string(spec, _c(x)), F.lit(missing))
    digits = int(m.group(1))
    pattern = "0." + "0" * digits if digits else "0"
    return F.coalesce(F.call_function("format_number", _c(x).cast("double"), F.lit(pattern)), F.lit(missing))


def chunk_text(df: DataFrame, text_col: str, chunk_size: int = 1000, overlap: int = 150,
               keep: Iterable[str] = ()) -> DataFrame:
    """Explode ``text_col`` into kept chunks ``(*keep, chunk_ix, chunk)``.

    The text is stripped; windows of ``chunk_size`` start every ``chunk_size - overlap``
    characters and stop at the first window that reaches the end; each chunk is stripped
    and blank chunks are dropped; ``chunk_ix`` numbers the kept chunks from 0. Window
    starts are in closed form, so the whole text is cut inside its row with no loop and
    no shuffle. A null or blank text gives no chunk. ``overlap >= chunk_size`` never
    terminates in the reference and is rejected here.
    """
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0 or overlap >= chunk_size:
        raise ValueError("overlap must be in [0, chunk_size)")
    step = chunk_size - overlap
    staged = spread(df.select(*keep, text_col)).select(*keep, py_strip(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    staged = staged.filter(F.length("_t") > 0)
    last = F.greatest(F.ceil((F.length("_t") - F.lit(chunk_size)) / F.lit(float(step))).cast("int"), F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda j: py_strip(F.substring(F.col("_t"), j * F.lit(step) + 1, F.lit(chunk_size))),
    )
    kept = F.filter(windows, lambda c: F.length(c) > 0)
    return staged.select(*keep, F.posexplode(kept).alias("chunk_ix", "chunk"))
