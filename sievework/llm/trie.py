"""Conversation prefix trie by prefix-doubling naming (operator 11).

The turns of a conversation are cut into aligned blocks of 1, 2, 4, ... turns. A block of one turn is named by its
distinct (role, text), a block of twice the turns by the distinct pair of the names of its halves: a round for each
doubling, in which distinct rows are numbered without gaps and joined back. A prefix of d turns is the chain of the
blocks of d's binary digits, the largest first; from the largest block size down, each round names the prefixes that end
in a block of that size by (name of the prefix before it, name of the block). Prefixes of equal length and name are one
node. So a conversation of n turns costs O(n) rows and the whole table O(log n) rounds, however long conversations are.

What a node knows of its subtree follows without walking it. A node is owned by its smallest member; the nodes that a
conversation owns are the last ones of its path. Children, leaves and saved tokens of a subtree are sums over the members
of the node of what they own, or do not own, further down their paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Scratch, crc32_sql, dense_names, numbered, written

#: Conversations of a family share the start of the one whose id is a multiple of FAMILY; the share is below SHARES turns.
FAMILY, SHARES = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, d, symbol, chars): the turns of each conversation numbered from 1, with a digest of (role, text) and the text's code points.

    In order of turn, null first; rows of the same turn stand in order of role, then of the SHA-256 of the text. Null
    roles and texts are empty; rows without a conversation are left out. Rows are numbered over the whole table by
    ranges, so a conversation may have any share of the rows.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    t = table.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), F.length(text).cast("bigint").alias("chars"),
    )
    placed = numbered(written(t, "turns"), F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(), name="place")
    before = placed.groupBy("conv").agg((F.min("place") - 1).alias("before"))
    symbol = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "digest"), 256)
    return written(placed.join(before, "conv").select("conv", (F.col("place") - F.col("before")).alias("d"), symbol.alias("symbol"), "chars"), "placed-turns")


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and (conv, length) of all conversations, the turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % 100 (all if it has fewer, none without it), and
    goes on with its own turns after its first h, where h is the unsigned CRC-32 of c's decimal digits modulo 6.
    """
    c = F.col("conv")
    n = written(t.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    n = n.select("conv", "n", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % SHARES).alias("h"))
    base = n.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    n = n.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    n = written(n.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "rebuilt-lengths")
    own = t.join(n.select("conv", "h", "taken"), "conv").where("d > h").select("conv", (F.col("taken") + F.col("d") - F.col("h")).alias("d"), "symbol", "chars")
    first = t.where((F.col("d") < SHARES) & (c % FAMILY == 0)).withColumnRenamed("conv", "base")
    taken = first.join(n.select("conv", "base", "taken"), "base").where("d <= taken").select("conv", "d", "symbol", "chars")
    return written(own.unionByName(taken), "rebuilt-turns"), n.select("conv", "length")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the dense name of their keys in place of these."""
    return written(rows.join(dense_names(rows.select(*keys)), keys).drop(*keys), "named")


def prefixes(t: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, d, name, length, total, last) for every prefix of 0 or more turns: equal prefixes of d turns share a name.

    total: code points of all its turns, last: of its last one.
    """
    longest = lengths.agg(F.max("length")).first()[0] or 0
    top = max(0, longest.bit_length() - 1)
    # a block: its number i among those of its size, its name, code points of all and of the last of its turns
    blocks = [_named(t.select("conv", (F.col("d") - 1).alias("i"), "symbol", "chars", F.col("chars").alias("last")), ["symbol"])]
    for _ in range(top):
        left = F.col("i") % 2 == 0
        pairs = blocks[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(left, F.col("name"))).alias("a"), F.max(F.when(~left, F.col("name"))).alias("b"), F.sum("chars").alias("chars"), F.max(F.when(~left, F.col("last"))).alias("last"))
        blocks.append(_named(written(pairs.where("b is not null"), "pairs"), ["a", "b"]))
    zero = F.lit(0).cast("bigint")
    known = lengths.select("conv", zero.alias("d"), zero.alias("name"), "length", zero.alias("total"), zero.alias("last"))
    columns = known.columns
    for k in range(top, -1, -1):
        size = 1 << k
        ends = blocks[k].where("i % 2 = 0").select("conv", (F.col("i") * size).alias("d"), F.col("name").alias("block"), "chars", F.col("last").alias("new_last"))
        longer = ends.join(known, ["conv", "d"]).select("conv", (F.col("d") + size).alias("d"), F.col("name").alias("before"), "block", "length", (F.col("total") + F.col("chars")).alias("total"), F.col("new_last").alias("last"))
        longer = written(longer, "longer")
        # the prefix of one block has the block's name; others are named by the pair
        one = longer.where(F.col("d") == size).withColumn("name", F.col("block"))
        more = longer.where(F.col("d") > size)
        if longest > 2 * size:
            more = more.join(dense_names(more.select("d", "before", "block")), ["d", "before", "block"])
            longer = written(one.select(columns).unionByName(more.select(columns)), "prefixes")
        else:
            longer = one.select(columns)
        known = known.unionByName(longer)
    return known


def _ends(last: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): the SHA-256 of the comma-joined members (conv, ascending) that end at each node.

    A task joins the ids of its range into pieces, at most one for each node and batch; the pieces of a node then pass
    through one hash in order, one at a time, so that nothing but a piece is held however many end at one node.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (c.to_numpy() for c in batch.columns)
            head = np.flatnonzero((np.diff(node, prepend=0) != 0) | (np.diff(depth, prepend=0) != 0) | (np.arange(len(node)) == 0))
            to = np.append(head[1:], len(node))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(head.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (node[head], depth[head], conv[head])), pa.array(text, pa.string())], names=["conv_id", "depth", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for node, depth, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) == at:
                    state.update(b"," + piece.encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (node, depth), hashlib.sha256(piece.encode())
            yield _rows(done)
        yield _rows([(*at, state.hexdigest())] if at else [])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends"])

    by = ["node", "depth", "conv"]
    cut = last.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "conv_id bigint, depth bigint, first bigint, piece string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashes, "conv_id bigint, depth bigint, ends string")


def trie(t: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (``t``: conv, d from 1 to its length, symbol, chars; ``lengths``: conv, length, once each).

    A node is a distinct prefix, from the empty one; its members are the conversations that begin with it. Columns:
    conv_id (the smallest member), depth, parent_conv_id (of its parent, null for the root), n_convs, n_children,
    n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its subtree, members but one times the
    code points of each node's last turn), ends_sha256 (of the comma-joined members that have no further turn). An empty
    table has no node, not even a root.
    """
    with Scratch(t.sparkSession) as scratch:
        return scratch.keep(_nodes(t, lengths), "trie")


def _nodes(t: DataFrame, lengths: DataFrame) -> DataFrame:
    p = prefixes(t, lengths)
    # written, so that both sides of the join are plain shuffles, of which Spark splits the part of a node of very many members
    nodes = written(p.groupBy("d", "name").agg(F.min("conv").alias("node"), F.max("length").alias("deepest")), "nodes")
    p = written(p.join(nodes, ["d", "name"]).select("conv", "d", "node", "length", "total", "last", (F.col("deepest") == F.col("d")).alias("leaf")), "paths")
    own = F.col("conv") == F.col("node")
    facts = p.groupBy("conv").agg(
        F.coalesce(F.min(F.when(own, F.col("d"))), F.max("length") + 1).alias("owned"), F.max_by(F.when(~own, F.col("node")), F.when(~own, F.col("d"))).alias("above"),
        F.coalesce(F.max(F.when(~own, F.col("total"))), F.lit(0)).alias("shared"), F.max((own & F.col("leaf")).cast("int")).alias("leaves"),
    )
    d = F.col("d")
    parent = F.when(own & (d > 0), F.when(d > F.col("owned"), F.col("conv")).otherwise(F.col("above")))
    n = F.count("*")
    found = p.join(facts, "conv").groupBy(F.col("node").alias("conv_id"), d.alias("depth")).agg(
        F.max(parent).alias("parent_conv_id"), n.alias("n_convs"), F.count_if((d + 1 >= F.col("owned")) & (d < F.col("length"))).alias("n_children"), F.sum("leaves").alias("n_leaves"),
        (F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("total"))) + (n - 1) * F.max("last")).alias("saved_tokens"),
    )
    ends = _ends(p.where("d = length").select("node", d.alias("depth"), "conv"))
    found = found.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    return found


def conversation_trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations, see ``turns``, ``rebuilt`` and ``trie``.

    Nulls, ties and turnless conversations as stated there; repeated rows are turns of their own; texts of any length
    enter by their digest; other columns are not read, whatever their names.
    """
    with Scratch(table.sparkSession) as scratch:
        return scratch.keep(_nodes(*rebuilt(turns(table, conv_col, turn_col, role_col, text_col))), "trie")


def oracle() -> str:
    return f"""with x as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as d, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
  n0 as (select conv_id, count(*) as n, conv_id - conv_id % {FAMILY} as base, {crc32_sql('conv_id::varchar')} % {SHARES} as h from x group by 1),
  n as (select n0.conv_id, n0.base, n0.h, least(n0.h, coalesce(b.n, 0)) as taken from n0 left join n0 b on b.conv_id = n0.base),
  r as (select conv_id, (taken + d - h)::bigint as d, role, text from x join n using (conv_id) where d > h union all select n.conv_id, d, role, text from x join n on x.conv_id = n.base where d <= taken),
  p as (select conv_id, d, sha256(string_agg(length(role) || ':' || role || sha256(text), '') over (partition by conv_id order by d)) as p, length(text) as chars from r union all select conv_id, 0, '', 0 from n),
  e as (select conv_id, max(d) as len from p group by 1),
  v as (select d, p, min(conv_id) as node, count(*) as n, max(chars) as chars, bool_and(d = len) as leaf, string_agg(conv_id::varchar, ',' order by conv_id) filter (d = len) as ends from p join e using (conv_id) group by 1, 2),
  path as (select p.conv_id, p.d, v.node from p join v using (d, p)),
  up as (select v.*, path.node as parent from v left join path on path.conv_id = v.node and path.d = v.d - 1),
  sub as (select path.node, path.d, sum((v.n - 1) * v.chars) as saved, count(*) filter (v.leaf) as leaves from v join path on path.conv_id = v.node and path.d <= v.d group by 1, 2),
  kids as (select parent as node, d - 1 as d, count(*) as k from up where d > 0 group by 1, 2)
select up.node as conv_id, up.d::bigint as depth, up.parent as parent_conv_id, up.n::bigint as n_convs, coalesce(kids.k, 0)::bigint as n_children, sub.leaves::bigint as n_leaves, sub.saved::bigint as saved_tokens, sha256(coalesce(up.ends, '')) as ends_sha256
from up join sub using (node, d) left join kids using (node, d)"""
