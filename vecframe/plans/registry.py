"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the result is expressible in SQL, the equivalent DuckDB query over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: integers as BIGINT, floating point as DOUBLE rounded to ``digits``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")

        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        built.__name__ = fn.__name__
        built.__doc__ = fn.__doc__
        QUERIES[name] = built
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


_FLOAT_TYPES = ("DOUBLE", "FLOAT", "REAL")
_INT_TYPES = ("TINYINT", "SMALLINT", "INTEGER", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT")


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def normalized_oracle(sql_by_name: dict[str, str], sample_dir: str) -> dict[str, str]:
    """Give every oracle query the output convention of :func:`tidy`: floating point
    rounded to 6 digits and integers as BIGINT. Column types come from DuckDB's own
    ``DESCRIBE`` of the query (bound against the tables of ``sample_dir``, not run)."""
    import duckdb

    from vecframe.plans.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sample_dir}/{t}.parquet')")
    out = {}
    for name, sql in sql_by_name.items():
        try:
            cols = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001 - leave a query DuckDB cannot describe untouched
            out[name] = sql
            continue
        repl = []
        for col, typ, *_ in cols:
            if typ in _FLOAT_TYPES or typ.startswith("DECIMAL"):
                repl.append(f"round(CAST({_quote(col)} AS DOUBLE), 6) AS {_quote(col)}")
            elif typ in _INT_TYPES:
                repl.append(f"CAST({_quote(col)} AS BIGINT) AS {_quote(col)}")
        out[name] = f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql})" if repl else sql
    con.close()
    return out
