import numpy as np
import xxhash
from fixtures import docs, groups

from vecframe.llm import simhash
from vecframe.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_a_plain_version():
    for text in ["", None, " \x1c ", "a", "A b c d", "One two\vthree four five\x85six", "x y " * 50, "É É é"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    tables = simhash.golay_tables()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5000).astype(np.int32)
    index = simhash.golay_index(words, tables)
    code = simhash.golay_index(np.arange(1 << 23, dtype=np.int32), tables)
    assert (np.bincount(code, minlength=4096) == 2048).all()  # 4096 balls of 2048 words
    errors = tables[1]
    remainder = tables[0][words >> 11] ^ (words & 0x7FF)
    assert (np.bitwise_count(errors[remainder]) <= 3).all()
    again = words ^ errors[remainder]
    assert (simhash.golay_index(again, tables) == index).all()


def test_prints_within_four_bits_share_a_key():
    tables, rng = simhash.golay_tables(), np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 2**63, dtype=np.int64)) << 1
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(bit)
        row, key = simhash.print_keys(np.array([a, b], np.uint64), tables)
        assert set(key[row == 0]) & set(key[row == 1])


def brute(prints):
    return groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])


def planted(rng, n):
    prints = [int(x) for x in rng.integers(0, 2**62, n)]
    for i in range(n // 2):
        x = prints[int(rng.integers(0, len(prints)))]
        for bit in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(bit)
        prints.append(x)
    return list(dict.fromkeys(prints))


def linked(spark, prints):
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(3)
    found = {tuple(r) for r in simhash.links(frame).collect()}
    at = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    for a, b in found:
        assert (prints[at[a]] ^ prints[at[b]]).bit_count() <= 4
    return groups(len(prints), [(at[a], at[b]) for a, b in found])


def test_links_connect_what_all_pairs_connect(spark):
    prints = planted(np.random.default_rng(2), 300)
    assert linked(spark, prints) == brute(prints)


def test_large_buckets_go_by_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    while len(prints) < 150:  # one dense group
        x = base
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    # workers are forked from a fresh daemon: the bound is bound into the closure's module
    keys = np.zeros(len(prints), np.int32)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    pairs, hot = simhash._bucket_links(keys, np.array(prints, np.uint64), 4)
    assert not len(pairs) and len(hot) == 1 and len(hot[0][1]) == len(prints)
    blocks = [hot[0][1][i : i + 40] for i in range(0, len(prints), 40)]
    found = [e for i in range(len(blocks)) for j in range(i) for e in simhash.spanning_links(np.concatenate([blocks[j], blocks[i]]))]
    at = {p: i for i, p in enumerate(prints)}
    assert groups(len(prints), [(at[a], at[b]) for a, b in found]) == brute(prints)


def test_groups_of_edge_rows(spark):
    rows = {}
    for r in simhash.simhash_groups(docs(spark)).collect():
        rows.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert len(rows[9]) == 2 and rows[9][0] == rows[9][1] and rows[9][0][1] == 9
    assert rows[1][0][1] == rows[6][0][1] == rows[7][0][1] == 1
    assert rows[2] == rows[3] == rows[4] == [("0" * 16, 2)]
    assert rows[None][0][1] is None
    assert rows[12][0][0] == f"{plain_fingerprint('0' * 5000):016x}"


def test_empty_table(spark):
    empty = docs(spark).limit(0)
    assert simhash.simhash_groups(empty).collect() == []
    assert simhash.keep_representatives(empty).columns == empty.columns
    assert simhash.keep_representatives(empty).count() == 0


def test_representatives_keep_all_columns(spark):
    frame = docs(spark)
    left = simhash.keep_representatives(frame)
    assert left.columns == frame.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect())
    assert [i for n, i in ids if not n] == [1, 2, 5, 8, 9, 10, 11, 12] and sum(n for n, _ in ids) == 1


def test_every_group_keeps_just_one_row(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in ("ab", "cd", "ef"))
    rows = [(3, one), (5, one), (5, two), (7, three), (7, "x y z"), (None, one), (None, "p q r"), (None, "p q r"), (9, "u v"), (9, "u v")]
    for frame in (docs(spark, rows), docs(spark, rows[::-1]).repartition(4)):
        got = [(r["doc_id"], r["text"]) for r in simhash.keep_representatives(frame).collect()]
        want = [(3, one), (5, two), (7, three), (7, "x y z"), (9, "u v"), (None, "p q r")]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(i, i + 1) for i in range(500, 640)] + [(700, 700)]
    pairs += [(900, 901 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(pairs + [(None, 3), (4, None)], "a long, b long").repartition(4)).collect()}
    want = groups(1000, pairs)
    met = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in met}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
