"""Conversation prefix trie: nodes by digests of prefixes, subtree sums by heavy-path decomposition."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scans import carried
from weft.session import materialise, release

BLOCK = 256


def numbered(turns: DataFrame, span: int = 4096) -> DataFrame:
    """Rows (conv_id, pos, role, text): turns numbered from 1 by turn (null first), role and text; nulls of these are empty.

    Rows are ranked within `span` values of turn, and the counts of earlier
    spans are carried in, so a conversation of any length spreads over tasks.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(2**62))))
    counts = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("earlier"))
    before = carried(counts, ["conv_id"], "span", sums=["earlier"]).where("earlier > 0")
    nth = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    out = rows.withColumn("nth", nth).join(before, ["conv_id", "span"], "left")
    return out.select("conv_id", (F.col("nth") + F.coalesce("earlier", F.lit(0))).cast("long").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Rows (conv_id, pos, role, text) of each conversation c rebuilt on the first of its family, and one of pos 0 for each.

    c takes the first h turns of conversation c - c % family (h: crc32 of c's
    digits modulo most + 1), fewer if there are fewer, then its own turns after
    its first h. `turns` are numbered.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    first = F.col("conv_id") - F.col("conv_id") % family
    convs = lengths.select("conv_id", first.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.least("len", F.lit(most)).alias("have"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0)))).select("conv_id", "base", "h", "taken")
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs, "base").where("pos <= taken").select("conv_id", "pos", "role", "text")
    kept = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    start = lengths.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return lent.unionByName(kept).unionByName(start)


def _chained(rows: DataFrame, keys: list[str], order: str, digest: str, keep: list[str]) -> DataFrame:
    """`chain`, the digest of all digests of the keys up to a row, over groups of bounded size."""
    held = F.array_sort(F.collect_list(F.struct(order, digest, *keep)))
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x[digest]), 256)))
    grouped = rows.groupBy(*keys).agg(held.alias("held"))
    chains = F.aggregate("held", F.array().cast("array<string>"), step)
    both = grouped.select(*keys, F.explode(F.arrays_zip("held", chains.alias("chain"))).alias("x"))
    return both.select(*keys, *[F.col(f"x.held.{c}").alias(c) for c in (order, *keep)], F.col("x.chain").alias("chain"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, prefix, above, size): the digest of the first depth turns, of those but the last, and the last one's UTF-8 bytes.

    `turns` has a row of pos 0 for each conversation. Digests chain within
    blocks of 256 turns, blocks of a conversation chain among each other, and a
    prefix is told by both: 256-bit digests, so equal ones are the same turns.
    """
    own = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    told = turns.where("pos > 0").select("conv_id", "pos", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), own.alias("told"), F.octet_length("text").cast("long").alias("size"))
    inner = _chained(told, ["conv_id", "block"], "pos", "told", ["size"])
    # Blocks over the first chain the last digests of the blocks before; few conversations have any.
    full = inner.where(F.col("pos") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), F.col("chain").alias("told"))
    outer = _chained(full, ["conv_id"], "block", "told", []).withColumnRenamed("chain", "outer")
    named = inner.join(outer, ["conv_id", "block"], "left").withColumn("prefix", F.concat(F.coalesce("outer", F.lit("")), "chain"))
    above = F.lag("prefix", 1, "").over(Window.partitionBy("conv_id", "block").orderBy("pos"))
    rows = named.select("conv_id", F.col("pos").alias("depth"), "prefix", above.alias("above"), "size", "block")
    # A block's first row hangs under the last of the block before.
    ends = rows.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), F.col("prefix").alias("end"))
    rows = rows.join(ends, ["conv_id", "block"], "left")
    first = (F.col("depth") % BLOCK == 1) & F.col("end").isNotNull()
    rows = rows.select("conv_id", "depth", "prefix", F.when(first, F.col("end")).otherwise(F.col("above")).alias("above"), "size")
    none = F.lit(None).cast("string")
    root = turns.where("pos = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("prefix"), none.alias("above"), F.lit(0).cast("long").alias("size"))
    return rows.unionByName(root)


def ends_digest(ends: DataFrame, span: int = 4096) -> DataFrame:
    """Rows (depth, prefix, ends_sha256) from rows (depth, prefix, conv_id): the digest of the ids, ascending and comma-joined.

    Ids are joined by spans of `span` values on all tasks; what one node's
    digest, a sequential function, then streams through are these strings.
    """
    spans = ends.groupBy("depth", "prefix", F.floor(F.col("conv_id") / span).alias("span")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    spans = spans.select("depth", "prefix", "span", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    kinds = pa.schema([("depth", pa.int64()), ("prefix", pa.string()), ("ends_sha256", pa.string())])

    def read(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for depth, prefix, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "prefix", "ids")), strict=True):
                if (depth, prefix) == now:
                    state.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, prefix), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds.types, strict=True)], schema=kinds)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, state.hexdigest()), kinds.types, strict=True)], schema=kinds)

    dealt = spans.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "span")
    return dealt.select("depth", "prefix", "ids").mapInArrow(read, "depth long, prefix string, ends_sha256 string")


def trie(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Nodes of the prefix trie of `rows` (as from `prefixes`), with sums over their subtrees.

    A node is a distinct prefix, named by its smallest member and its depth. Its
    heavy child is the one with most members (then the smallest name), so a path
    from the root leaves heavy paths at most log2(conversations) times. Each
    heavy path ends in one childless node, whose smallest member names it: the
    path is that conversation's nodes below its last light one. Paths are summed
    from their ends up, those under the most light edges first, and each adds
    its sum to the node it hangs from: a round a number of light edges, the
    driver sees that number alone. Sums along a path run within blocks of
    `block` nodes and then among blocks.
    """
    rows = materialise(rows)
    nodes = rows.groupBy("depth", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("above").alias("above"), F.first("size").alias("size"))
    nodes = materialise(nodes)
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("prefix"))
    kids = below.agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("name"))).alias("heavy"))
    kids = kids.select("depth", "prefix", "n_children", (-F.col("heavy.name")).alias("heavy_id"))
    full = nodes.join(kids, ["depth", "prefix"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    full = materialise(full)
    up = full.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"), "heavy_id")
    named = full.drop("heavy_id").join(up, ["depth", "above"], "left")
    named = named.withColumn("light", (F.col("depth") > 0) & (F.col("conv_id") != F.col("heavy_id"))).drop("heavy_id", "above")
    # Each childless node's smallest member walks its nodes; those below its last light node are its path.
    leaves = full.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("end"))
    walk = rows.join(leaves, (rows["conv_id"] == leaves["path"]) & (rows["depth"] <= leaves["end"])).select("path", "depth", "prefix")
    walk = materialise(walk.join(named, ["depth", "prefix"]))
    heads = walk.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("head"), F.sum(F.col("light").cast("long")).alias("level"))
    paths = materialise(walk.join(heads, "path").where("depth >= head").drop("light"))
    release(walk, full, nodes)
    deepest = paths.agg(F.max("level")).first()[0]
    own = (F.col("n_convs") - 1) * F.when(F.col("depth") > 0, F.col("size")).otherwise(0)
    hung, done = None, []
    for level in range(-1 if deepest is None else int(deepest), -1, -1):
        now = paths.where(F.col("level") == level).withColumn("rank", -F.col("depth"))
        added = [own.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")]
        if hung is not None:
            now = now.join(hung, (now["conv_id"] == hung["at_conv"]) & (now["depth"] == hung["at_depth"]), "left")
            added = [(own + F.coalesce("more_saved", F.lit(0))).alias("saved"), ((F.col("n_children") == 0).cast("long") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")]
        now = now.select(*paths.columns, "rank", *added)
        after = carried(now.select("path", "rank", "saved", "leaves"), ["path"], "rank", sums=["saved", "leaves"], block=block)
        after = after.select("path", "rank", F.col("saved").alias("rest_saved"), F.col("leaves").alias("rest_leaves"))
        summed = now.join(after, ["path", "rank"]).withColumn("saved_tokens", F.col("saved") + F.col("rest_saved")).withColumn("n_leaves", F.col("leaves") + F.col("rest_leaves"))
        summed = materialise(summed.drop("rank", "saved", "leaves", "rest_saved", "rest_leaves"))
        tops = summed.where("depth = head and depth > 0").groupBy(F.col("parent_conv_id").alias("at_conv"), (F.col("depth") - 1).alias("at_depth"))
        hung = tops.agg(F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))
        done.append(summed)
    out = paths.withColumn("saved_tokens", F.lit(None).cast("long")).withColumn("n_leaves", F.lit(None).cast("long")).limit(0) if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = ends_digest(rows.join(lengths, ["conv_id", "depth"], "left_semi").select("depth", "prefix", "conv_id"))
    out = out.join(ends, ["depth", "prefix"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """The prefix trie of all conversations (conv_id, turn, role, text), each rebuilt on its family's first.

    Rows of one turn stand in the order of role and text; repeated rows are
    turns of their own. A null conv_id belongs to no conversation and is left
    out; null roles and texts are empty, a null turn comes first. An empty table
    gives no node, not even a root. Other columns are ignored.
    """
    turns = materialise(numbered(conversations.select("conv_id", "turn", "role", "text")))
    out = trie(prefixes(rebuilt(turns, family, most)))
    return out


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all `conversations`."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(pos) AS len FROM t GROUP BY conv_id),
c AS (SELECT l.conv_id, l.conv_id - l.conv_id % 5 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(l.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM l),
cc AS (SELECT c.*, least(h, coalesce(b.len, 0)) AS taken FROM c LEFT JOIN l b ON b.conv_id = c.base),
r AS (SELECT cc.conv_id, pos, role, text FROM cc JOIN t ON t.conv_id = cc.base WHERE pos <= taken
      UNION ALL SELECT cc.conv_id, pos - h + taken, role, text FROM cc JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, pos AS depth, strlen(text) AS bytes, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM l),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, prefix),
m AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM p JOIN n ON n.depth = p.depth AND n.prefix = p.prefix),
e AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS parent FROM m a JOIN m b ON a.member = b.member AND a.depth = b.depth + 1),
k AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e GROUP BY ALL),
sub AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS in_conv, b.depth AS in_depth FROM m a JOIN m b ON a.member = b.member AND b.depth >= a.depth),
s AS (SELECT sub.conv_id, sub.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
      FROM sub JOIN n ON n.conv_id = in_conv AND n.depth = in_depth LEFT JOIN k ON k.conv_id = in_conv AND k.depth = in_depth GROUP BY ALL),
z AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
x AS (SELECT m.conv_id, m.depth, sha256(string_agg(member::VARCHAR, ',' ORDER BY member)) AS ends FROM m JOIN z ON z.conv_id = member AND z.depth = m.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, e.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(x.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN x USING (conv_id, depth)"""
