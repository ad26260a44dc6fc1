"""Vector scalars as JVM-side column expressions (higher-order functions, no Python).

Arithmetic is done in DOUBLE even when vectors are stored as ARRAY<FLOAT>. Every function
returns NULL for a NULL input and for vectors of different length (``zip_with`` pads with
NULL, and NULL propagates through the fold).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("cosine", "ip", "l2")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def inner_product(a, b) -> Column:
    """Sum of element products (V2)."""
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(v) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays zero (V1)."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine_similarity(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity (V3). Pass precomputed norms to avoid recomputing them per pair.
    Zero-norm input gives NULL."""
    na = norm(a) if norm_a is None else _c(norm_a)
    nb = norm(b) if norm_b is None else _c(norm_b)
    return F.try_divide(inner_product(a, b), na * nb)


def l2_distance(a, b) -> Column:
    """Euclidean distance (V4), the ``<->`` operator of the SQL stores."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0).cast("double"),
            lambda acc, x: acc + x,
        )
    )


def has_bad_element(v) -> Column:
    """True when an element is NULL or NaN."""
    return F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x))


SQL_FUNCTIONS = {
    "inner_product": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (acc, x) -> acc + x)",
    ),
    "l2_distance": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "sqrt(aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * "
        "(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (acc, x) -> acc + x))",
    ),
    "cosine_similarity": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "try_divide(inner_product(a, b), sqrt(inner_product(a, a)) * sqrt(inner_product(b, b)))",
    ),
    "l2_normalize": (
        "v ARRAY<FLOAT>",
        "ARRAY<DOUBLE>",
        "transform(v, x -> CASE WHEN sqrt(inner_product(v, v)) > 0 "
        "THEN CAST(x AS DOUBLE) / sqrt(inner_product(v, v)) ELSE 0D END)",
    ),
}


def chunk_function_sql() -> str:
    """``chunk_text(body, size, overlap)`` as an SQL table function: the chunks of one text
    (P8), for ``FROM docs, LATERAL chunk_text(docs.text, 1000, 150)``."""
    from vecframe.functions.text import PY_WHITESPACE

    space = "concat(" + ", ".join(f"chr({ord(c)})" if ord(c) < 256 else f"'{c}'" for c in PY_WHITESPACE) + ")"
    strip = lambda x: f"btrim({x}, {space})"
    last = f"greatest(CAST(ceil((length({strip('coalesce(body, \'\')')}) - size) / CAST(size - overlap AS DOUBLE)) AS INT), 0)"
    pieces = (
        f"filter(transform(sequence(0, {last}), j -> {strip(f'substring({strip("coalesce(body, \'\')")}, j * (size - overlap) + 1, size)')}), "
        "c -> length(c) > 0)"
    )
    return (
        "CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(body STRING, size INT, overlap INT) "
        f"RETURNS TABLE(chunk_ix INT, chunk STRING) RETURN SELECT pos, col FROM posexplode({pieces})"
    )


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the vector scalars and the chunker as session SQL functions (U3) so that SQL
    users can write ``ORDER BY l2_distance(embedding, q)`` like the ``<->`` operator."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    spark.sql(chunk_function_sql())
    return [*SQL_FUNCTIONS, "chunk_text"]
