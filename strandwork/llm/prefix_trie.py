"""The trie of conversation prefixes, its subtree totals by leaf-peeling.

Every distinct sequence of first turns is a node, named by its turns' hashes added up. Totals go up by messages: who has
heard from all children sends its total to its parent, until only the root is left. A trie may be as deep as its longest
conversation, so whoever sends is a path of nodes and not a node: each node goes on in its child with the most members,
and a path hangs from another where a lesser child does. A path keeps a counter of the paths that hang from it and have
not finished. A lesser child has at most half of the members, so there are no more rounds than log2 of the conversations,
however deep the trie is. Inside a path the totals of its nodes are running sums from its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._ordered import in_ranges, ordered_digests, running
from strandwork.session import settled

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROOT = (0, 0)
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_key(role: Column, text: Column) -> Column:
    """A digest of role and text, which cannot run into one another."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, depth, key, n_words``: each conversation's turns from 1 on by ``turn``, null first, and of equal turns by
    role and then by a digest. Null role or text is empty; rows without a conversation are left out."""
    said, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    light = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        said.alias("role"),
        turn_key(said, body).alias("key"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
    )
    found = running(in_ranges(light, "conv_id", "turn", "role", "key"), "conv_id", [])
    return settled(found.select("conv_id", F.col("nth").alias("depth"), "key", "n_words"))


def on_shared_starts(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``rows`` (as ``numbered`` gives them) with the first h turns of each conversation c replaced by those that c - c%every
    has, h being crc32(c) % most; where that one has fewer, or is absent, so many fewer come in their place."""
    c = F.col("conv_id")
    base, h = (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h")
    length = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    first = rows.where((c % every == 0) & (F.col("depth") < most)).select(c.alias("base"), "depth", "key", "n_words")
    bases = length.where(c % every == 0).select(c.alias("base"), F.col("length").alias("base_length"))
    heads = length.where(c % every != 0).select("conv_id", base, h).join(first, "base").where("depth <= h")
    tails = rows.where(c % every != 0).select("*", base, h).where("depth > h").join(bases, "base", "left")
    moved = tails.withColumn("depth", F.col("depth") - F.col("h") + F.least("h", F.coalesce("base_length", F.lit(0))))
    columns = ["conv_id", "depth", "key", "n_words"]
    return rows.where(c % every == 0).select(*columns).unionByName(heads.select(*columns)).unionByName(moved.select(*columns))


NODE = ["a", "b"]
PARENT = ["pa", "pb"]


def on(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(other, NODE, how)


def totals(hung: DataFrame) -> DataFrame:
    """Peels paths (``path, top, parent_path, parent_depth, leaves, saved``) until none is left: the same rows with what
    their subtrees come to. Rounds settle what is still open, and each path is settled once more when it is done."""
    waits = hung.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("waits"))
    still = settled(hung.join(waits, "path", "left").fillna(0, ["waits"]))
    done = []
    while not still.isEmpty():
        done.append(still.where("waits = 0").drop("waits"))
        told = done[-1].groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        heard = still.where("waits > 0").join(told, "path", "left").fillna(0, ["n", "l", "s"])
        still = settled(heard.select(*hung.columns[:4], (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"), (F.col("waits") - F.col("n")).alias("waits")))
    return reduce(DataFrame.unionByName, done) if done else hung


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` and ``a, b``, the node's name.

    ``rows`` has ``conv_id, depth`` (from 1 on without gaps), ``key`` (equal for equal turns) and ``n_words``;
    ``conversations`` has every ``conv_id`` once, also those without a turn, which end at the root. Without conversations
    there is no node. One conversation of any length, one with very many copies and a node with very many children are each
    spread over all tasks.
    """
    lane = [F.xxhash64(F.lit(n), F.lit(seed), "depth", "key").alias(n) for n, seed in zip(NODE, (0x9E3779B9, 0x85EBCA6B), strict=True)]
    ranged = in_ranges(rows.select("conv_id", "depth", "n_words", *lane), "conv_id", "depth")
    steps = running(ranged, "conv_id", NODE)
    steps = settled(steps.select("conv_id", "depth", "n_words", *[F.col(f"after_{n}").alias(n) for n in NODE], *[F.col(f"before_{n}").alias(p) for n, p in zip(NODE, PARENT, strict=True)]))
    kinds = {f.name: f.dataType for f in steps.schema}
    nowhere = [F.lit(None).cast(kinds["a"]).alias(p) for p in PARENT]
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(x).cast("long").alias(n) for n, x in zip(NODE, ROOT, strict=True)], "conv_id", "n_convs", F.lit(0).cast("long").alias("n_words"), *nowhere)
    inner = steps.groupBy("depth", *NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), *[F.first(p).alias(p) for p in PARENT])
    bare = settled(inner.unionByName(root))

    children = bare.where("depth > 0").groupBy(*[F.col(p).alias(n) for n, p in zip(NODE, PARENT, strict=True)])
    children = settled(children.agg(F.count("*").alias("n_children"), F.max_by(F.struct(*NODE), F.struct("n_convs", -F.col("conv_id"))).alias("heavy")))
    nodes = settled(on(bare, children.drop("heavy"), "left").fillna(0, ["n_children"]).withColumn("weight", (F.col("n_convs") - 1) * F.col("n_words")))
    light = on(nodes, children.select("heavy.*"), "left_anti").select(*NODE, F.lit(True).alias("light"))

    # A leaf's smallest member walks its whole path; the path begins below the last node that is a lesser child.
    leaves = nodes.where("n_children = 0").select("conv_id")
    walks = settled(on(steps.join(leaves, "conv_id", "left_semi").select("conv_id", "depth", *NODE), light, "left"))
    tops = leaves.join(walks.where("light").groupBy("conv_id").agg(F.max("depth").alias("top")), "conv_id", "left").fillna(0, ["top"])
    own = walks.join(tops, "conv_id").where("depth >= top").select(F.col("conv_id").alias("path"), "top", *NODE)
    at_root = tops.where("top = 0").select(F.col("conv_id").alias("path"), "top", *[F.lit(x).cast("long").alias(n) for n, x in zip(NODE, ROOT, strict=True)])
    placed = settled(on(own.unionByName(at_root), nodes.select(*NODE, *PARENT, "depth", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"))))

    sums = placed.groupBy("path", "top").agg(F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved"))
    heads = placed.where("depth = top").select("path", *PARENT)
    holders = placed.select(F.col("path").alias("parent_path"), F.col("depth").alias("parent_depth"), *[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)])
    hung = sums.join(heads.join(holders, PARENT, "left").drop(*PARENT), "path")
    whole = totals(hung.select("path", "top", "parent_path", "parent_depth", "leaves", "saved"))

    heard = whole.where("parent_path is not null").groupBy(F.col("parent_path").alias("path"), F.col("parent_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    valued = placed.join(heard, ["path", "depth"], "left").select("path", (-F.col("depth")).alias("up"), *NODE, (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("weight") + F.coalesce("s", F.lit(0))).alias("saved"))
    summed = running(in_ranges(valued, "path", "up"), "path", ["leaves", "saved"])
    summed = summed.select(*NODE, F.col("after_leaves").alias("n_leaves"), F.col("after_saved").alias("saved_tokens"))

    last = steps.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("at"))
    ends = conversations.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"at.{n}"), F.lit(x).cast("long")).alias(n) for n, x in zip(NODE, ROOT, strict=True)])
    digests = ordered_digests(ends.withColumn("piece", F.col("conv_id").cast("string").cast("binary")), NODE, ["conv_id"], "piece", b",")

    above = nodes.select(*[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    found = on(on(nodes.join(above, PARENT, "left"), summed), digests, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), *NODE)


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of ``turns`` as they are, see ``trie`` and, for nulls and ties, ``numbered``. Repeated rows
    are turns of their own; texts may be empty or of any length; an empty table has no nodes; other columns are not read."""
    rows = numbered(turns, conv_id, turn, role, text)
    return trie(rows, rows.select("conv_id").distinct())


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` rebuilt on shared starts; rows without a conversation are left out."""
    rows = numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return trie(on_shared_starts(rows), rows.select("conv_id").distinct()).drop(*NODE)


#: crc32 of a string, bit by bit.
CRC32_SQL = "xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"

ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, conv_id % 20 = 0 AS own, {CRC32_SQL.format('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.n, role, text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(concat(strlen(role), ':', role, text)), '') OVER w AS name, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
p AS (SELECT conv_id, depth, name, words FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, arg_max(name, depth) AS name FROM p GROUP BY conv_id),
d AS (SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM e GROUP BY name),
k AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY name, depth),
x AS (SELECT k.*, u.name AS parent, u.conv_id AS parent_conv_id FROM k LEFT JOIN k u ON u.depth = k.depth - 1 AND u.name = left(k.name, 64 * (k.depth - 1))),
m AS (SELECT parent, count(*) AS n FROM x WHERE parent IS NOT NULL GROUP BY parent),
z AS (SELECT x.name, CASE WHEN m.n IS NULL THEN 1 ELSE 0 END AS leaf, saved, unnest(range(depth + 1)) AS up FROM x LEFT JOIN m ON m.parent = x.name),
g AS (SELECT left(name, 64 * up) AS name, sum(leaf) AS n_leaves, sum(saved) AS saved FROM z GROUP BY 1)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, x.parent_conv_id, x.n_convs, CAST(coalesce(m.n, 0) AS BIGINT) AS n_children, CAST(g.n_leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, coalesce(d.ends, sha256('')) AS ends_sha256
FROM x JOIN g USING (name) LEFT JOIN m ON m.parent = x.name LEFT JOIN d ON d.name = x.name
"""
