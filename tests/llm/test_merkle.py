import hashlib
import random
import zlib

import pytest
from llm_cases import DOCS, clashing, empty, odd_docs, odd_rows, rows
from pyspark.sql import functions as F

from larkseek.llm import merkle
from larkseek.llm.common import table


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1:run + 3]))
        i //= 3
    return out


def brute(data):
    """All rows by sorting, level by level."""
    groups = {}
    for r in data:
        found = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and found is not None:
            found = found.replace("\n", "")
        groups.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, found)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, own, now) in enumerate(groups[s]):
            path = sides(trees[s], i) + sides(top, k)
            folded = now
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((doc, own, trees[s][-1][0], top[-1][0], h(*(x for p in path for x in (*p[0], *p[1]))), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(docs):
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return rows(merkle.manifest(docs, found={"text": F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}))


@pytest.mark.parametrize("n", [1, 4, 28, 2200])
def test_sizes_around_powers_and_blocks(spark, n):
    """One hot source and some of every size; ids with gaps, negative ones too."""
    rng = random.Random(n)
    ids = rng.sample(range(-3 * n, 100_000), n)
    data = [(i, rng.choice(["a\nb", "", None, "line\n\n", "ü"]), "en", rng.choice(["hot", "hot", "hot", None, "", "é", f"s{i % 5}"]), rng.choice([None, 3])) for i in ids]
    assert run(spark.createDataFrame(data, DOCS).repartition(3)) == brute(data)


def test_repeated_rows_and_ids(spark):
    """A third of all rows is one row, another third shares an id."""
    data = [(7, "same\ntext", "en", "s", 9)] * 40 + [(8, f"text {k}", "en", "s", k) for k in range(40)] + [(k, "x", "en", "s", None) for k in range(100, 140)]
    data += [(None, f"no id {k % 2}\n", None, None, None) for k in range(5)] + [(8, "elsewhere", "en", "t", 1)]
    got = run(spark.createDataFrame(data, DOCS).repartition(4))
    assert got == brute(data)


def test_odd_rows_and_clashing_columns(spark):
    docs = clashing(odd_docs(spark))
    for name in ("grp", "word", "bit", "leaf", "now", "nth", "rank", "total"):
        docs = docs.withColumn(name, F.lit("y"))
    assert run(docs) == brute(odd_rows())
    assert run(empty(spark)) == []


def test_given_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert run(docs) == want and 0 < sum(r[-1] for r in want) < len(want)
