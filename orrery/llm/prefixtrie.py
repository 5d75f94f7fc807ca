"""The prefix trie of conversations by prefix-doubling names.

1. A turn's role and text get a dense number: equal turns, equal names. A block of 2**k turns
   that begins at a multiple of 2**k is the pair of its halves, and pairs are named by the
   distinct ones among all, so log2 of the longest conversation rounds of joins name twice as
   many blocks as there are turns.
2. A prefix of d turns is one of fewer set bits and a block: d without its lowest set bit, and
   the block as long as that bit. From the longest block down, each round names the
   prefixes that end with a block of its length by the pairs (shorter prefix, block). After as many
   rounds as before each turn has the name of the prefix that it ends.
3. Prefixes with one name are a node, identified by its depth and its smallest conversation.
   A conversation is the smallest one of the last nodes on its path and owns these; the sums
   over a node's subtree are those of its owner's nodes from there on, plus all that the
   other conversations through the node own. So subtrees are summed in one grouping of the
   turns, whatever their depth, and no pair of a node and an ancestor is made.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import ordered
from orrery.llm import textops as T


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), digest of role and text, and the text's code points, of each turn.

    Turns are ordered by ``turn``, null first, ties by role and text; null roles and texts are
    empty, repeated rows stay turns of their own, rows without a conv_id are left out.
    """
    text = lambda c: F.coalesce(T.column(conversations, c, "string"), F.lit(""))
    rows = conversations.select(T.column(conversations, id_col, "long").alias("conv_id"), T.column(conversations, turn_col, "long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # the role's length keeps the two apart
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    known = rows.where("conv_id is not null").select("*", said.alias("digest"), F.length("text").cast("long").alias("chars"))
    order = [F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("role"), F.col("text")]
    return ordered.running(known, "conv_id", order, F.lit(1), "place", ["digest", "chars"])


def with_shared_heads(said: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its
    first h, where h = crc32(decimal c) % (most + 1). Returns all conversations with their
    rebuilt number of turns (conv_id, n; 0 is possible), and the rebuilt turns."""
    own = said.groupBy("conv_id").agg(F.max("place").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    first = (F.col("conv_id") - F.col("conv_id") % every).alias("first")
    ids = own.select("conv_id", "own", head.alias("head"), first)
    there = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    ids = ids.join(there, "first", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    ids = T.stored(ids.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    heads = said.where((F.col("conv_id") % every == 0) & (F.col("place") <= most)).withColumnRenamed("conv_id", "first")
    taken = heads.join(ids.select("conv_id", "first", "head"), "first").where("place <= head").select("conv_id", "place", "digest", "chars")
    kept = said.join(ids.select("conv_id", "head", "taken"), "conv_id").where("place > head")
    kept = kept.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "digest", "chars")
    return ids.select("conv_id", "n"), taken.unionByName(kept)


def _named(rows: DataFrame, by: list[str], tables: list[DataFrame]) -> DataFrame:
    """The rows with the number of their distinct values of ``by`` as name, in place of these."""
    ids = T.stored(rows.select(*by).distinct().withColumn("_id", F.monotonically_increasing_id()))
    # a number counts up within each task from the task's number shifted by 33 bits: made dense by a row per task
    counts = ids.groupBy(F.shiftright("_id", 33).alias("_task")).count().orderBy("_task").collect()
    bases, base = [], 0
    for c in counts:
        bases.append((c._task, base))
        base += c["count"]
    tasks = F.broadcast(rows.sparkSession.createDataFrame(bases, "_task long, _base long"))
    dense = ids.join(tasks, F.shiftright("_id", 33) == F.col("_task")).select(*by, (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("name"))
    tables.append(named := T.stored(rows.join(dense, by).drop(*by)))
    T.discard(ids)
    return named


def prefix_names(rebuilt: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """conv_id, depth and name of each prefix, equal ones of a depth having equal names; and the stored tables below."""
    tables: list[DataFrame] = []
    # of each conversation, block j of a level holds the turns from j * 2**level on
    block = _named(rebuilt.select("conv_id", (F.col("place") - 1).alias("j"), "digest"), ["digest"], tables)
    blocks = [block]
    for _ in range(1, longest.bit_length()):
        half = lambda bit: F.max(F.when(F.col("j") % 2 == bit, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b"))
        blocks.append(_named(pairs.where("a is not null and b is not null"), ["a", "b"], tables))
    known = None
    for level in reversed(range(len(blocks))):
        last = blocks[level].where("j % 2 = 0").select("conv_id", ((F.col("j") + 1) * (1 << level)).alias("depth"), F.col("j"), F.col("name").alias("block"))
        ends = last.where("j = 0").select("conv_id", "depth", F.lit(-1).cast("long").alias("before"), "block")
        if known is not None:
            shorter = known.select("conv_id", (F.col("depth") + (1 << level)).alias("depth"), F.col("name").alias("before"))
            ends = ends.unionByName(last.where("j > 0").join(shorter, ["conv_id", "depth"]).select("conv_id", "depth", "before", "block"))
        # depths of different rounds differ, so a depth and a name are enough to know a prefix
        named = _named(ends.withColumn("at", F.col("depth")), ["at", "before", "block"], tables)
        known = named if known is None else known.unionByName(named)
    return known, tables


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(ids: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ids: conv_id and n, the number of its turns, of every conversation. rebuilt: conv_id, place (from
    1), digest, chars. The root is there if there is a conversation.
    """
    spark, none = ids.sparkSession, hashlib.sha256(b"").hexdigest()
    rebuilt = T.stored(rebuilt)
    longest, smallest, number = ids.agg(F.max("n"), F.min("conv_id"), F.count("*")).first()
    if not number:
        return spark.createDataFrame([], _NODES)
    # turnless conversations end at the root
    ends = ids.where("n = 0").select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id")
    if not longest:
        sha = ordered.joined_sha256(ends, ("node", "depth"), "conv_id", "sha").first().sha
        return spark.createDataFrame([(smallest, 0, None, number, 0, 1, 0, sha)], _NODES)
    names, tables = prefix_names(rebuilt, longest)
    # each turn with its node; written first, so that the partition of a node with many conversations can be split
    nodes = T.stored(names.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")))
    paths = T.stored(names.join(nodes, ["depth", "name"]).select("conv_id", F.col("depth").cast("long").alias("depth"), "node", "n_convs"))
    T.discard(*tables)
    chars = rebuilt.select(F.col("conv_id").alias("node"), F.col("place").cast("long").alias("depth"), "chars")
    above = paths.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    own = paths.where("conv_id = node").select("node", "depth", "n_convs").join(chars, ["node", "depth"]).join(above, ["node", "depth"], "left")
    own = T.stored(own.select("node", "depth", "n_convs", "parent", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    children = own.where("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    found = T.stored(own.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    owners = T.stored(found.groupBy("node").agg(F.sum("saved").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.max((F.col("depth") == 1).cast("long")).alias("first")))
    # what the conversations through a node own beyond it; its owner's part depends on the depth
    through = paths.join(owners.withColumnRenamed("node", "conv_id"), "conv_id").groupBy("node", "depth")
    others = through.agg(F.sum(F.when(F.col("conv_id") != F.col("node"), F.col("owned")).otherwise(0)).alias("beside"), F.sum("leaf").alias("n_leaves"))
    onwards = ordered.running(found, "node", [-F.col("depth")], F.col("saved"), "onwards", ["depth", "n_convs", "parent", "n_children"])
    ends = ends.unionByName(paths.join(ids, "conv_id").where("depth = n").select("node", "depth", "conv_id"))
    shas = T.stored(ordered.joined_sha256(ends, ("node", "depth"), "conv_id", "ends_sha256"))
    below = onwards.join(others, ["node", "depth"]).join(shas, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"),
        "depth",
        F.coalesce("parent", F.lit(smallest)).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("onwards") + F.col("beside")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    saved, leaves, first = owners.agg(F.sum("owned"), F.sum("leaf"), F.sum("first")).first()
    sha = shas.where("depth = 0").agg(F.max("ends_sha256")).first()[0]
    root = spark.createDataFrame([(smallest, 0, None, number, first, leaves, saved, sha or none)], _NODES)
    return root.unionByName(below)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations of a table, rebuilt with shared heads. Columns beside conv_id, turn,
    role and text are ignored; an empty table, or one without a conv_id, gives no node."""
    said = turns(conversations)
    return trie(*with_shared_heads(said))
