import random

import xxhash
from llm_cases import clashing, empty, odd_docs, odd_rows, rows

from larkseek.llm import simhash
from larkseek.llm.common import table
from larkseek.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(pairs):
    """{(index): smallest id} for (id, fingerprint) rows."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(pairs):
        r = find(k)
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return [smallest.get(find(k)) for k in range(len(pairs))]


def test_given_table(spark, sf):
    docs = table(spark, sf, "documents")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in data]
    want = sorted((i, format(f, "016x"), c) for (i, f), c in zip(prints, brute_classes(prints), strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def test_odd_rows(spark):
    data = [r[:2] for r in odd_rows()]
    prints = [(i, brute_fingerprint(t)) for i, t in data]
    want = sorted(((i, format(f, "016x"), c) for (i, f), c in zip(prints, brute_classes(prints), strict=True)), key=repr)
    assert rows(simhash.near_duplicates(clashing(odd_docs(spark)))) == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_word_count_edges():
    for t in (None, "", " ", "a", "a b", "a b c", "A B c d", "a\x0bb\x1cc d", "x " * 3000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    long = "Alpha beta gamma delta " * 120_000  # several blocks
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def clusters(seed, n):
    """Random fingerprints, many of them with close neighbours."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.getrandbits(64)
        out.append(f)
        for _ in range(rng.randint(0, 12)):
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return sorted(set(out))


def linked(spark, prints, **more):
    df = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long").repartition(5)
    found = {r["node"]: r["root"] for r in components(simhash.links(df, **more)).collect()}
    groups = {}
    for f in prints:
        groups.setdefault(found.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
    return sorted(sorted(g) for g in groups.values())


def brute_groups(prints):
    groups = {}
    for f, c in zip(prints, brute_classes(list(enumerate(prints))), strict=True):
        groups.setdefault(c, set()).add(f)
    return sorted(sorted(g) for g in groups.values())


def test_links_find_every_pair(spark):
    prints = clusters(1, 600)
    assert linked(spark, prints) == brute_groups(prints)


def test_crowded_values_lose_no_link(spark):
    """Fingerprints that agree in 40 bits: every value of some part is crowded."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (rng.getrandbits(24) & rng.getrandbits(24) & rng.getrandbits(24)) for _ in range(700)} | set(clusters(4, 100)))
    assert linked(spark, prints, hot=20) == brute_groups(prints)


def test_thresholds_by_dynamic_programming():
    costs = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 9, 1: 90}]
    assert simhash.allocate(costs, 0) == (7, [0, 1, -1])
    assert simhash.allocate([{0: 1, 1: 3}, {0: 1, 1: 9}], 1) == (4, [1, 0])


def test_skewed_bits_get_unequal_thresholds(spark):
    """Bits 0 to 31 hardly vary: they must not be the key of an exact match alone."""
    rng = random.Random(8)
    prints = sorted({rng.getrandbits(32) << 32 | (1 << rng.randrange(32)) for _ in range(3000)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long")
    parts = simhash.plan(df)
    assert len({t for _, t in parts}) > 1 or len({len(b) for b, _ in parts}) > 1
    assert sum(t + 1 for _, t in parts) >= 3 and all(len(b) == len(set(b)) for b, _ in parts)
    assert linked(spark, prints[:300]) == brute_groups(prints[:300])


def test_components_on_paths_stars_and_trees(spark):
    edges = [(k + 1, k) for k in range(200)] + [(1000 + k, 999) for k in range(50)] + [(5000, 4000), (6000, 5000), (6000, 4500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 999 for k in range(50))
    assert {got[k] for k in (4000, 4500, 5000, 6000)} == {4000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_deduplicate_keeps_one_row_of_each_group(spark):
    docs = clashing(odd_docs(spark))
    kept = simhash.deduplicate(docs)
    assert kept.dtypes == docs.dtypes
    got = kept.collect()
    data = [r[:2] for r in odd_rows()]
    prints = [(i, brute_fingerprint(t)) for i, t in data]
    groups = brute_classes([(k, f) for k, (_, f) in enumerate(prints)])
    assert len(got) == len(set(groups))
    # ids 1 and 2 are copies, 3 to 5 have no words, 9 (in capitals, one more sign) is five bits away
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([1, 3, 6, 7, 8, 9, None], key=repr)
    assert simhash.deduplicate(empty(spark)).collect() == []
