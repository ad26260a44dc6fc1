import re
from itertools import permutations

from fixtures import docs

from vecframe.llm.filter_audit import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_audit(rows, labels):
    """rows (id, text, source); labels (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)}
        seen.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {s[0] for s in seen}:
        own = [s[1:] for s in seen if s[0] == part]
        removed, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [s for s in left if x in s[0]]
                stay = [s for s in left if x not in s[0]]
                removed[x] += len(gone)
                found.append((part, "".join(order), step, x, len(stay), len(gone), sum(x in s[0] for s in own) - len(gone),
                              sum(s[0] == {x} for s in own), sum(s[1] for s in gone), sum(s[2] for s in gone)))
                left = stay
        out += [(*f[:3], *f[4:], removed[f[3]]) for f in found]
    return sorted(out)


def audited(spark, rows, labels, extra=False):
    d = docs(spark, [r[:2] for r in rows]) if extra else None
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if d is not None:
        frame = frame.selectExpr("*", "'x' AS mask", "'x' AS bits", "'x' AS n", "'x' AS good", "'x' AS part", "'x' AS quality", "1 AS kept")
    found = filter_audit(frame, marks)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


MANY = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, "few words", "a"), (2, MANY, "a"), (3, MANY, "b"), (4, MANY + " #", "a"), (5, "same " * 300, None), (6, "same " * 300, ""),
    (7, None, "a"), (8, "", "b"), (9, "ALL CAPITALS & MORE", "c"), (9, "ALL CAPITALS & MORE", "c"), (10, "ALL CAPITALS & MORE", "c"),
    (None, MANY, "b"), (None, MANY, "b"), (2, MANY, "a"), (2, "another text, one id", "a"), (11, MANY.replace("w1 ", "É漢🎉 "), "c"),
    (12, "A " + "x" * 48, "a"), (13, "A " + "x" * 47, "a"), (14, " ".join(["nbsp"] * 300), "a"), (0, "x " * 99 + "y " * 100 + "z", "b"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, None, 1), (9, 1, 0), (10, 1, None), (None, 1, 1), (99, 1, 1), (13, 0, 1)]


def test_filter_audit_against_every_order(spark):
    assert audited(spark, ROWS, LABELS) == plain_audit(ROWS, LABELS)


def test_filter_audit_of_copies_and_clashing_columns(spark):
    rows = [(i, "a copied text", f"s{i % 2}") for i in range(400)] + [(i + 1000, f"{MANY} {i}", "s0") for i in range(100)]
    rows += [(None, "a copied text", "s1")] * 50
    found = audited(spark, rows, [(i, i % 2, i % 3 % 2) for i in range(500)], extra=True)
    assert found == plain_audit(rows, [(i, i % 2, i % 3 % 2) for i in range(500)])
    assert len(found) == 2 * 120 * 5


def test_filter_audit_without_labels_or_documents(spark):
    assert audited(spark, [], LABELS) == []
    rows = ROWS[:4]
    assert audited(spark, rows, []) == plain_audit(rows, [])
