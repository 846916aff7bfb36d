"""Merkle dataset manifest: leaf places by bitmap ranks, levels by keyed slot arrays.

Every row is a leaf. Leaves of a group (a source) stand in the order of their ids, and three
consecutive nodes become one until one is left, the group's subroot. Subroots, in the order of their
groups, become the root in the same way.

No row is sorted. Each task turns its ids into words of 64 bits, only non-zero words are kept, and
words of one group merge by OR. Counts of 512 words each form a directory with prefix sums, counts
of words one below it. A row's rank is the directory's count, plus its bucket's words before, plus
the bits before its own; rank and total give its coordinates on every level. Words and buckets hold
bounded numbers of ids, so a group with a third of all rows is spread like any other.

Levels are reduced six at a time: up to 729 digests of one block stand in an array by their slot.
Proofs run the other way: a block gets the path above it once, and its leaves extend it. A path is
a list of the digests left and right of a node, level by level, from which a leaf is folded.

Defined cases: null ids come first, and share a word; a null group comes first and is no other
group; null fields count as ``-``, which no value can be; rows of one id are ordered by leaf digest,
equal ones being interchangeable; a group of one leaf has it as subroot, a single group's subroot is
the root, and the proof of a row without siblings is the digest of nothing; texts of any length are
hashed whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkseek.llm.common import positions, ranged, scratch, start_of_parts, stored

FANOUT = 3
LEVELS = 6
BLOCK = FANOUT ** LEVELS
#: Places of null ids: a word that no id has.
NO_WORD = -(1 << 60)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of ``fields``, each with its length in bytes before it."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, word, bit and more) with ``rank``, the number of rows of the group with a
    smaller id plus its place among equal ids, and ``total``, the rows of the group."""
    spark = rows.sparkSession
    words = stored(rows.groupBy("grp", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n"))
                   .withColumn("bucket", F.expr("shiftright(word, 9)")), scratch(spark, "bitmap-words"))
    buckets = ranged(words.groupBy("grp", "bucket").agg(F.sum("n").alias("n")), [F.col("grp"), F.col("bucket")], scratch(spark, "bitmap-buckets"), "part")
    # at most one group began before a range, so rows before are one per range
    begun = start_of_parts(buckets.groupBy("part", "grp").agg(F.sum("n").alias("here")), ["grp"], "part", {"here": "earlier"}).where("earlier > 0")
    before = Window.partitionBy("part", "grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    directory = (buckets.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
                 .join(F.broadcast(begun), ["part", "grp"], "left").join(buckets.groupBy("grp").agg(F.sum("n").alias("total")), "grp")
                 .select("grp", "bucket", (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("start"), "total"))
    inside = Window.partitionBy("grp", "bucket").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    words = (words.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(directory, ["grp", "bucket"])
             .select("grp", "word", "bits", "n", (F.col("start") + F.col("inside")).alias("base"), "total"))
    again = words.where("n > bit_count(bits)").select("grp", "word")
    copies = (rows.join(again, ["grp", "word"], "left_semi").groupBy("grp", "word", "bit").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("grp", "word").agg(F.collect_list(F.struct("bit", "n")).alias("copies")))
    words = stored(words.drop("n").join(copies, ["grp", "word"], "left"), scratch(spark, "bitmap-ranks"))
    placed = (rows.join(words, ["grp", "word"])
              .withColumn("rank", F.expr("base + coalesce(aggregate(filter(copies, c -> c.bit < bit), 0L, (a, c) -> a + c.n), bit_count(bits & ~shiftleft(-1L, bit)))"))
              .withColumn("repeated", F.expr("exists(coalesce(copies, array()), c -> c.bit = bit and c.n > 1)"))
              .drop("base", "bits", "copies"))
    if not words.where("copies is not null").limit(1).count():
        return placed.drop("repeated")
    placed = stored(placed, scratch(spark, "bitmap-placed"))
    many = positions(placed.where("repeated").withColumn("place", F.concat_ws(":", "rank", "grp")), "place", ["leaf", "nth"], "copy", "bitmap-copies")
    return (placed.where("not repeated").drop("repeated")
            .unionByName(many.withColumn("rank", F.col("rank") + F.col("copy")).drop("copy", "place", "repeated")))


def _levels(total: str) -> str:
    """Levels that a block of a group with ``total`` nodes is reduced by."""
    return f"least({LEVELS}, size(filter(array({', '.join(f'{FANOUT ** i}L' for i in range(LEVELS))}), x -> x < {total})))"


def _depth(n: int) -> int:
    return next(d for d in range(64) if FANOUT ** d >= n)


def _blocks(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """Blocks of nodes (grp, rank, total, digest, payload): their nodes by slot, and the digests of
    each level, ``level0`` to ``level6``; the last holds one."""
    out = (nodes.groupBy("grp", F.expr(f"rank div {BLOCK}").alias("block"))
           .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct(F.expr(f"int(rank % {BLOCK})").alias("slot"), "digest", *payload))).alias("nodes"))
           .withColumn("levels", F.expr(_levels("total"))).withColumn("level0", F.expr("transform(nodes, x -> x.digest)")))
    for j in range(LEVELS):
        a = f"level{j}"
        node = ", ".join(f"coalesce(get({a}, int({FANOUT} * i + {s})), '')" for s in range(FANOUT))
        out = out.withColumn(f"level{j + 1}", F.expr(f"if(levels > {j}, transform(sequence(0, int((size({a}) - 1) div {FANOUT})), i -> sha2(concat({node}), 256)), {a})"))
    return stored(out, scratch(nodes.sparkSession, name))


def _climb(nodes: DataFrame, payload: list[str], most: int, name: str) -> list[DataFrame]:
    """Tables of blocks from the leaves to one block a group; ``most``: leaves of the largest group."""
    tables = [_blocks(nodes, payload, name)]
    for _ in range(LEVELS, _depth(most), LEVELS):
        nodes = tables[-1].select("grp", F.col("block").alias("rank"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col(f"level{LEVELS}")[0].alias("digest"))
        tables.append(_blocks(nodes, [], name))
    return tables


def _path(slot: str) -> str:
    """Array of (left, right): the digests beside a node's ancestors inside its block, then ``path``."""
    def beside(j: int) -> str:
        at = f"{slot} div {FANOUT ** j}"
        return (f"if(levels > {j}, array(named_struct('left', array_join(slice(level{j}, int({slot} div {FANOUT ** (j + 1)} * {FANOUT} + 1), int(({at}) % {FANOUT})), ''), "
                f"'right', array_join(slice(level{j}, int({at} + 2), int({FANOUT - 1} - ({at}) % {FANOUT})), ''))), array())")
    return f"concat({', '.join(beside(j) for j in range(LEVELS))}, path)"


def _descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with the path above them; ``above`` has a row per group."""
    carried = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        below = blocks.join(above, ["grp", "block"])
        above = (below.select("grp", "block", *carried, F.explode(F.expr(f"transform(nodes, x -> named_struct('slot', x.slot, 'path', {_path('x.slot')}))")).alias("n"))
                 .select("grp", (F.col("block") * BLOCK + F.col("n.slot")).alias("block"), *carried, F.col("n.path").alias("path")))
    return tables[0].join(above, ["grp", "block"])


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    ``found`` gives fields as they are met now, to be checked against the manifest: folded_root is
    made from them and the siblings of the manifest, and ``verified`` says whether it is the root.
    """
    spark = docs.sparkSession
    key = F.col(doc_id).cast("long")
    now = digest([(found or {}).get(c, F.col(c)) for c in fields])
    rows = stored(docs.select(
        key.alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-")).alias("grp"), digest([F.col(c) for c in fields]).alias("leaf"),
        now.alias("now"), F.monotonically_increasing_id().alias("nth"), F.coalesce(F.shiftright(key, 6), F.lit(NO_WORD)).alias("word"),
        F.coalesce(key.bitwiseAND(63), F.lit(0)).cast("int").alias("bit")), scratch(spark, "leaves"))
    leaves = ranks(rows).select("grp", "rank", "total", F.col("leaf").alias("digest"), "doc_id", "now")
    most = rows.groupBy("grp").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    groups = _climb(leaves, ["doc_id", "now"], max(most, 1), "manifest")
    subroots = stored(groups[-1].select("grp", F.col(f"level{LEVELS}")[0].alias("subroot")), scratch(spark, "subroots"))
    n = max(subroots.count(), 1)
    order = positions(subroots.withColumn("all", F.lit("")), "all", ["grp"], "rank", "group-order")
    tree = _climb(order.select(F.col("all").alias("grp"), F.col("rank").cast("long").alias("rank"), F.lit(n).cast("long").alias("total"), F.col("subroot").alias("digest"), F.col("grp").alias("own")),
                  ["own"], n, "manifest-groups")
    path = "array<struct<left:string,right:string>>"
    top = tree[-1].select("grp", F.col(f"level{LEVELS}")[0].alias("root"), F.expr(f"cast(array() as {path})").alias("path"))
    above = (_descend(tree, top).select("root", F.explode(F.expr(f"transform(nodes, x -> named_struct('grp', x.own, 'subroot', x.digest, 'path', {_path('x.slot')}))")).alias("g"))
             .select("g.grp", "g.subroot", "root", "g.path"))
    above = stored(above, scratch(spark, "group-paths"))
    leaf = f"transform(nodes, x -> named_struct('doc_id', x.doc_id, 'leaf', x.digest, 'now', x.now, 'path', {_path('x.slot')}))"
    proof = "sha2(array_join(transform(x.path, p -> concat(p.left, p.right)), ''), 256)"
    fold = "aggregate(x.path, x.now, (h, p) -> sha2(concat(p.left, h, p.right), 256))"
    return (_descend(groups, above)
            .select("subroot", "root", F.explode(F.expr(f"transform({leaf}, x -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'proof', {proof}, 'folded', {fold}))")).alias("x"))
            .select("x.doc_id", "x.leaf", "subroot", "root", F.col("x.proof").alias("proof_sha256"), F.col("x.folded").alias("folded_root"),
                    (F.col("x.folded") == F.col("root")).alias("verified")))
