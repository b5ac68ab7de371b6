"""Operator 11: the prefix trie of conversations, built level by level.

Per depth the live conversations are grouped by (parent node, next turn); the smallest conv_id of a group names the new
node. A conversation that is alone in its node leaves the rounds: the nodes below are its own, one a turn, and one join
lists them all. So there are as many rounds as the longest prefix that two conversations share. Joins from the deepest
level back to the root then sum up leaves and savings. Turns travel as SHA-256 digests, never as texts, and groups are
counted before rows are shuffled, so a first turn that a third of all conversations share is no hot spot."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, Scratch, table
from corpusloom.llm.ranks import NARROW_ROWS, ranked

#: Conversations of one block of ids share the turns of its first.
BLOCK = 20
#: Bytes of joined ids that stand in one row on the way to a node's digest.
CHUNK = 1 << 16


def turns_of(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(c, d, turn, words): the turns by place, each as a digest of role and text, with the words of its text.

    Turns are ordered by turn, nulls first, and ties by role and text; a null role or text is empty, a repeated row is
    a turn of its own. Rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("t"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256)).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    # A tie of turns is settled by role and text through their digest: any order of equal rows gives the same result.
    return ranked(scratch, "turns", rows, "c", [F.col("t").asc_nulls_first(), "turn"], "d").drop("t")


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, d, turn, words), (c, length)): every conversation with the first turns of its block's first one in front."""
    own = scratch.put("own", turns.groupBy("c").agg(F.count("*").alias("n")))
    first = F.col("c") - F.col("c") % BLOCK
    heads = own.select("c", "n", first.alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % 4).alias("h"))
    known = own.select(F.col("c").alias("base"), F.col("n").alias("m"))
    heads = scratch.put("heads", heads.join(known, "base", "left").select("c", "n", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("k")))
    lead = turns.filter("d <= 3 AND c % 20 = 0").withColumnRenamed("c", "base").join(heads.filter("k > 0"), "base").filter("d <= h").select("c", "d", "turn", "words")
    rest = turns.join(heads, "c").filter("d > h").select("c", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "turn", "words")
    lengths = heads.select("c", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    return scratch.put("rebuilt", lead.unionByName(rest).sortWithinPartitions("d")), scratch.put("lengths", lengths)


def digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): SHA-256 of the sorted, comma-joined ids of the conversations that end in a node.

    A digest is read in order, but not as rows: tasks over ranges of sorted ids join them to pieces, and one task a node
    runs through its pieces without holding them."""
    by = ["depth", "conv_id", "c"]
    dealt = ends.repartitionByRange(*by).sortWithinPartitions(*by)
    pieces = dealt.mapInArrow(_pieces, "depth bigint, conv_id bigint, c bigint, ids binary")
    return pieces.repartition("depth", "conv_id").sortWithinPartitions(*by).mapInArrow(_hashes, "depth bigint, conv_id bigint, ends_sha256 string")


def _pieces(batches):
    """Runs of ids of one node, joined by commas, at most CHUNK bytes a row; c is the first id of a row."""
    node, first, ids, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_pylist([{"depth": node[0], "conv_id": node[1], "c": first, "ids": ",".join(ids).encode()}], schema=_PIECES)

    out = []
    for batch in batches:
        for depth, conv_id, c in zip(*(x.to_pylist() for x in batch.columns)):
            text = str(c)
            if node != (depth, conv_id) or size > CHUNK:
                if ids:
                    out.append(row())
                node, first, ids, size = (depth, conv_id), c, [], 0
            ids.append(text)
            size += len(text) + 1
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if ids:
        yield row()


_PIECES = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("c", pa.int64()), ("ids", pa.binary())])


def _hashes(batches):
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, conv_id, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if node != (depth, conv_id):
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, conv_id), hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        if done:
            yield pa.RecordBatch.from_pylist([{"depth": d, "conv_id": n, "ends_sha256": h} for d, n, h in done])
    if node:
        yield pa.RecordBatch.from_pylist([{"depth": node[0], "conv_id": node[1], "ends_sha256": digest.hexdigest()}])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node.

    A node is a distinct sequence of first turns; conv_id is the smallest id of the conversations that start with it,
    and with depth its name. n_leaves counts the childless nodes of its subtree, saved_tokens sums (n_convs - 1) times
    the words of the last turn over it, both with the node itself. The root has depth 0, no parent and no turn.

    An empty table has no node, not even a root, as there is no id to name it. Columns other than conv_id, turn, role
    and text are ignored. Long texts are read once, for their digest and words."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix_trie")
    turns, lengths = rebuilt(scratch, turns_of(scratch, conversations))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS))
    top = lengths.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    levels = [scratch.put("nodes0", top.select(F.lit(0).cast("bigint").alias("depth"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", F.lit(0).cast("bigint").alias("words")))]
    members = [scratch.put("members0", lengths.crossJoin(F.broadcast(top)).select("c", "conv_id", "n_convs", "length"))]  # one row is broadcast
    while True:
        depth = len(levels)
        live = members[-1].filter(f"length >= {depth} AND ({depth} = 1 OR n_convs > 1)").select("c", "length", F.col("conv_id").alias("parent_conv_id"))
        step = scratch.put("step", live.join(turns.filter(f"d = {depth}"), "c").select("c", "length", "parent_conv_id", "turn", "words"))
        groups = step.groupBy("parent_conv_id", "turn").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
        groups = scratch.put(f"groups{depth}", groups)
        if groups.isEmpty():
            break
        levels.append(groups.select(F.lit(depth).cast("bigint").alias("depth"), "conv_id", "parent_conv_id", "n_convs", "words"))
        members.append(scratch.put(f"members{depth}", step.join(groups.drop("words"), ["parent_conv_id", "turn"]).select("c", "conv_id", "n_convs", "length")))
    ends = [m.filter(f"length = {k}").select(F.lit(k).cast("bigint").alias("depth"), "conv_id", "c") for k, m in enumerate(members)]
    # below a node with one member every turn is a node of its own; the root's turns were grouped in any case
    alone = [m.filter(f"n_convs = 1 AND length > {k}").select("c", "length", F.lit(k).alias("from")) for k, m in enumerate(members) if k]
    chains = None
    for rows in alone:
        chains = rows if chains is None else chains.unionByName(rows)

    summed = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        if summed is None:  # the deepest nodes have no children but those of chains
            nodes = nodes.withColumns({"n_children": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint"), "saved": F.lit(0).cast("bigint")})
        else:
            children = summed.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(children, "conv_id", "left").fillna(0, ["n_children", "below", "saved"])
        nodes = nodes.withColumn("n_leaves", F.greatest(F.lit(1), "below")).withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
        summed = scratch.put(f"summed{k}", nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        levels[k] = summed
    out = levels[0]
    for nodes in levels[1:]:
        out = out.unionByName(nodes)
    ended = ends[0]
    for rows in ends[1:]:
        ended = ended.unionByName(rows)
    out = out.join(digests(ended), ["depth", "conv_id"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    if chains is not None:
        parted = chains.select("c", F.col("from").cast("bigint").alias("depth"))
        one = F.lit(1).cast("bigint")
        out = out.join(parted.withColumnRenamed("c", "conv_id").withColumn("more", one), ["depth", "conv_id"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
        below = chains.select("c", "length", F.explode(F.sequence(F.col("from") + 1, F.col("length"))).alias("depth")).select(
            F.col("c").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("c").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
            one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("depth") == F.col("length"), F.sha2(F.col("c").cast("string"), 256)).alias("ends_sha256"),
        )
        out = out.unionByName(below.select(out.columns))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    from corpusloom.llm.snapshot_diff import CRC32

    return f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {CRC32.format(id="c")} % 4 AS h FROM t GROUP BY c),
b AS (SELECT n.c, n.n, n.h, least(n.h, coalesce(m.n, 0)) AS k FROM n LEFT JOIN n AS m ON m.c = n.c - n.c % 20),
s AS (SELECT b.c, t.p AS d, r, x FROM b JOIN t ON t.c = b.c - b.c % 20 AND t.p <= b.h
  UNION ALL SELECT b.c, b.k + t.p - b.h, r, x FROM b JOIN t ON t.c = b.c AND t.p > b.h),
k AS (SELECT c, d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, string_agg(sha256(length(r) || ':' || r || ':' || x), '') OVER (PARTITION BY c ORDER BY d) AS pre FROM s
  UNION ALL SELECT c, 0, 0, '' FROM b),
l AS (SELECT c, max(d) AS len FROM k GROUP BY c),
g AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n, max(w) AS w FROM k GROUP BY d, pre),
m AS (SELECT k.c, k.d, g.conv_id, g.n, g.w FROM k JOIN g ON k.d = g.d AND k.pre = g.pre),
v AS (SELECT g.d, g.conv_id, g.n, g.w, m.conv_id AS parent FROM g LEFT JOIN m ON m.c = g.conv_id AND m.d = g.d - 1),
ch AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
up AS (SELECT a.d, a.conv_id, count(*) FILTER (ch.n_children IS NULL) AS n_leaves, sum((v.n - 1) * v.w) AS saved
  FROM v LEFT JOIN ch ON ch.d = v.d AND ch.conv_id = v.conv_id JOIN m AS a ON a.c = v.conv_id AND a.d <= v.d GROUP BY ALL),
e AS (SELECT m.d, m.conv_id, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS sha FROM m JOIN l ON l.c = m.c AND l.len = m.d GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, coalesce(ch.n_children, 0) AS n_children, up.n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM v JOIN up ON up.d = v.d AND up.conv_id = v.conv_id LEFT JOIN ch ON ch.d = v.d AND ch.conv_id = v.conv_id LEFT JOIN e ON e.d = v.d AND e.conv_id = v.conv_id"""


ORACLE = _oracle()
