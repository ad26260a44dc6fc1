"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are a mask of five bits, so the corpus shrinks to counts per (part, mask),
at most 32 cells for each part. A recursive query extends filter prefixes by each letter not used
yet: a row is a prefix and a mask cell, and carries the bits applied so far. What a level makes is
that step's outcome for the cell (kept, removed, redundant, the only failure). The recursion works
on the masks alone, so its size, 325 prefixes by 32 masks, depends neither on rows nor on parts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecframe.session import cut_lineage

LETTERS = "ABCDE"
SPACES = "\\x20\\x09-\\x0D"
LEAST_WORDS = 200
NULL_ID_SALTS = 1024  # rows without an id are spread over so many keys

#: One row for each prefix and mask, and its outcome there; `bit` is that of the prefix's last letter.
STEPS_SQL = """
WITH RECURSIVE steps(prefix, step, applied, bit, mask) AS (
  SELECT '', 0, 0, 0, mask FROM {cells}
  UNION ALL
  SELECT concat(prefix, substr('ABCDE', i + 1, 1)), step + 1, applied | bit, shiftleft(1, i), mask
  FROM (SELECT *, explode(filter(array(0, 1, 2, 3, 4), i -> ((applied | bit) & shiftleft(1, i)) = 0)) AS i FROM steps)
)
SELECT prefix, step, mask,
       mask & (applied | bit) = 0 AS kept,
       mask & applied = 0 AND mask & bit <> 0 AS removed,
       mask & applied <> 0 AND mask & bit <> 0 AS redundant,
       mask = bit AS alone
FROM steps WHERE step > 0"""


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A too few words, B too few distinct words,
    C too many capitals, D special characters."""
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    return F.struct(
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("capitals"),
        F.length(text).alias("chars"),
        text.rlike("[#$%&*|]").alias("special"),
    )


def _bits(x: str) -> Column:
    f = lambda condition, bit: F.when(F.expr(condition), F.lit(bit)).otherwise(F.lit(0))
    return (
        f(f"{x}.words < {LEAST_WORDS}", 1)
        + f(f"100 * {x}.distinct < 50 * {x}.words", 2)
        + f(f"100 * {x}.capitals > 2 * {x}.chars", 4)
        + f(f"{x}.special", 8)
    )


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows, rows labelled good and rows labelled toxic.

    Equal texts are found by their SHA-256. Rows equal in text, part and id are counted first,
    then the text's rows by (part, labels), so that a text held by a third of the table leaves
    each task as a few rows; its smallest id is then the minimum over those."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    seen = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("x"))
    counted = seen.select("id", "part", "digest", _bits("x").alias("bits")).groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    marks = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
        .withColumn("salt", F.lit(0).cast("long"))
    )
    salted = counted.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_ID_SALTS))).otherwise(F.lit(0).cast("long")))
    labelled = salted.join(marks, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})

    named = F.col("id").isNotNull()
    by_text = labelled.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("id", "n"))).alias("first"),  # ids are distinct within a group
    )
    both = by_text.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))  # four rows a part at most
    copies = F.col("named") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = both.withColumn("copies", F.coalesce(copies, F.lit(0))).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("bits").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
            F.struct((F.col("bits") + 16).alias("mask"), F.col("copies").alias("n")),
        )).alias("c"),
    )
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")
    )


def audit_cells(cells: DataFrame) -> DataFrame:
    """``cells(part, mask, n, good, toxic)`` to one row per part, order and step."""
    cells = cut_lineage(cells)  # 32 rows a part; read by the recursion and by its join
    steps = cut_lineage(cells.sparkSession.sql(STEPS_SQL, cells=cells.select(F.col("mask").cast("int")).distinct()))
    tally = lambda c, on: F.sum(F.when(F.col(on), F.col(c)).otherwise(0))
    metrics = {
        "kept": tally("n", "kept"), "removed": tally("n", "removed"), "redundant": tally("n", "redundant"),
        "unique_fails": tally("n", "alone"), "good_lost": tally("good", "removed"), "toxic_lost": tally("toxic", "removed"),
    }
    by_prefix = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step").agg(*[c.alias(k) for k, c in metrics.items()])
    by_prefix = cut_lineage(by_prefix)  # 325 rows a part, read twice
    ways = F.element_at(F.array(*[F.lit(w) for w in (24, 6, 2, 1, 1)]), F.col("step"))  # orders that begin with the prefix
    last = lambda c: F.substring(c, -1, 1).alias("letter")
    shapley = by_prefix.groupBy("part", last("prefix")).agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = steps.where("step = 5").select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    places = places.withColumn("prefix", F.expr("substr(filter_order, 1, step)"))  # 600 rows
    full = by_prefix.drop("step").join(F.broadcast(places), "prefix").withColumn("letter", F.substring("prefix", -1, 1))
    return full.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *[F.col(m).cast("long").alias(m) for m in [*metrics, "shapley"]]
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` and ``labels(doc_id, quality, toxic)`` to ``(part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)``: one row for each part (source; null as empty), each of the 120 orders of the
    five filters and each step, zeros included.

    A null text is empty. Repeated rows count each; a row whose text has a smaller id elsewhere
    fails E, so rows that share the smallest id do not, and a row without an id neither fails E
    nor makes another fail. A document labelled more than once is good (or toxic) if one label
    says so. Further columns are ignored; no documents, no rows."""
    return audit_cells(failure_cells(docs, labels))


def audit_sql() -> str:
    """The same as DuckDB SQL over ``documents`` and ``labels``: every order is built by joining
    letters, and every step is counted from the rows of its part."""
    spaces = SPACES.replace("\\\\", "\\")
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             list_filter(string_split_regex(coalesce(text, ''), '[{spaces}]+'), lambda x: x <> '') AS ws FROM documents),
    lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id),
    firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    m AS (SELECT d.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
            [len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < 50 * len(ws),
             100 * (length(d.text) - length(translate(d.text, '{string.ascii_uppercase}', ''))) > 2 * length(d.text),
             regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > firsts.least, false)] AS fails
          FROM d JOIN firsts ON firsts.text = d.text LEFT JOIN lab ON lab.doc_id = d.doc_id),
    c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
    o AS (SELECT '' AS filter_order UNION ALL
          SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE position(l IN filter_order) = 0),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
                 list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: ascii(x) - 64) AS before
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
    x AS (SELECT c.part, s.filter_order, s.step, s.letter, c.n, c.good, c.toxic, fails[ascii(letter) - 64] AS now,
                 s.step > 1 AND list_bool_or(list_transform(before, lambda i: coalesce(fails[i], false))) AS gone,
                 len(list_filter(fails, lambda f: f)) AS n_fails FROM c, s),
    r AS (SELECT part, filter_order, step, letter,
                 coalesce(sum(n) FILTER (WHERE NOT now AND NOT gone), 0) AS kept,
                 coalesce(sum(n) FILTER (WHERE now AND NOT gone), 0) AS removed,
                 coalesce(sum(n) FILTER (WHERE now AND gone), 0) AS redundant,
                 coalesce(sum(n) FILTER (WHERE now AND n_fails = 1), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (WHERE now AND NOT gone), 0) AS good_lost,
                 coalesce(sum(toxic) FILTER (WHERE now AND NOT gone), 0) AS toxic_lost
          FROM x GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
