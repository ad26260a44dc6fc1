import pytest
from pyspark.sql import functions as F

from vecframe.functions import text as X


def spec_chunks(text, size, overlap):
    """The chunking rule written from its specification: windows of ``size`` characters
    starting every ``size - overlap`` characters, stopping at the window that reaches the
    end; every chunk stripped; blank chunks dropped."""
    t = (text or "").strip()
    if not t:
        return []
    step = size - overlap
    n = len(t)
    starts = [0]
    while starts[-1] + size < n:
        starts.append(starts[-1] + step)
    pieces = [t[s:s + size].strip() for s in starts]
    return [p for p in pieces if p]


CASES = [None, "", "   \n\t ", "abcdefghij", "abcdefghijk", "abc   defgh   ijk lmn", "  x" * 20,
         "é" * 25, "word " * 13, "a　b　" * 9]


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (5, 4), (7, 2)])
def test_chunk_text_matches_specification(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id long, text string")
    got = {}
    for r in X.chunk_text(df, "text", size, overlap, keep=["id"]).collect():
        got.setdefault(r.id, []).append((r.chunk_ix, r.chunk))
    for i, t in enumerate(CASES):
        chunks = [c for _, c in sorted(got.get(i, []))]
        assert chunks == spec_chunks(t, size, overlap), (i, t)


def test_chunk_overlap_not_smaller_than_size_rejected(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    with pytest.raises(ValueError):
        X.chunk_text(df, "text", 10, 10)


def test_strip_is_python_strip(spark):
    samples = ["  a  ", "　 x\x1c", "\xa0", "", "a b", "​zero-width​"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r.s for r in df.select(X.py_strip("t").alias("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_extensions_and_topics(spark):
    paths = ["/d/a.TXT", "/d/sub/b.md", "/d/noext", "/d/.hidden", "/d/x.tar.gz", "/d/dir.v1/file", "/d/end."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(X.path_extension("p").alias("e"), X.topic_from_ext(X.path_extension("p")).alias("t"),
                    X.ext_allowed("p", [" TXT", "md", ""]).alias("ok")).collect()
    import os
    assert [r.e for r in got] == [os.path.splitext(p)[1] for p in paths]
    assert [r.ok for r in got] == [True, True, False, False, False, False, False]
    assert [r.t for r in got][2] == "file"
    assert X.normalize_exts([" TXT", "", ".Md"]) == [".txt", ".md"]


def test_format_like_python(spark):
    vals = [36.175, 0.125, 2.5, 1234.5678, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(X.fmt("x", "%.2f").alias("s")).collect()]
    assert got == [f"{v:.2f}" if v is not None else "N/A" for v in vals]
    got0 = [r.s for r in df.select(X.fmt("x", "%.0f").alias("s")).collect()]
    assert got0 == [f"{v:.0f}" if v is not None else "N/A" for v in vals]
