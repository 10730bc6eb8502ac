"""Merkle manifest of a dataset: ternary hash trees in a van Emde Boas layout, built and read block by block.

Leaves are rows; those of a source, in order of their id, make a tree, and the sources' roots, in order of the source, make the
tree above. A tree of any size is cut into blocks: aligned subtrees over FAN ** depth consecutive leaves. A block is stored
as one byte string in van Emde Boas order: a subtree of h levels is its top of h // 2 levels followed by its bottom subtrees,
each laid out the same way, so a walk from a leaf to the root touches few stretches of memory whatever their size. Where a node lies
follows from its level and place by arithmetic alone (address()); building and fetching siblings both use it. The blocks' roots
are the leaves of the next layer of blocks, and so on until one block is left, so no task holds more than a block and the
number of passes is the logarithm of the rows to the base FAN ** depth. Proofs come down the same way: a layer tells each
block below the siblings on the way from its root upwards.

H is lowercase hex sha256 of its inputs one after the other, digests as hex text. A node is H of a run of up to FAN consecutive
nodes, a last run may be shorter, even one node; a single node is the root as it is.

Defined results. Null values of a leaf are "-". A null source is a source of its own, before all others. Rows that share an id
are leaves of their own in order of their hash; a null id comes first and isn't tampered with. Rows equal in all leaf columns have equal leaves,
and which of their places each gets is left open. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import sized_join, to_arrow, written

FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "tree string, block long, lefts array<string>, rights array<string>"


def nodes_in(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes lie, in van Emde Boas order, that are `depth` below the root of a full tree of `levels` levels."""
    index = np.asarray(index, np.int64)
    base = np.zeros(index.shape, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, bottom = depth - top, levels - top
        which, index = np.divmod(index, FAN**depth)
        base += nodes_in(top) + which * nodes_in(bottom)
        levels = bottom
    return base


@lru_cache(maxsize=32)
def _addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Of each level, leaves first, the addresses of its nodes from left to right."""
    return tuple(address(levels, d, np.arange(FAN**d)) for d in range(levels - 1, -1, -1))


def levels_of(n: int) -> int:
    """Levels of a tree of its own over n leaves."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def build(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The nodes (32 bytes each) of a block in van Emde Boas order, from its leaves in order. Where the last runs are short, nodes are
    missing and stay zero."""
    at = _addresses(levels)
    out = np.zeros((nodes_in(levels), 32), np.uint8)
    out[at[0][: len(leaves)]] = leaves
    n = len(leaves)
    for below, own in zip(at, at[1:]):
        text = out[below[:n]].tobytes().hex().encode()
        n = -(-n // FAN)
        run = 64 * FAN
        made = b"".join(sha256(text[run * i : run * (i + 1)]).digest() for i in range(n))
        out[own[:n]] = np.frombuffer(made, np.uint8).reshape(n, 32)
    return out


def ways(block: np.ndarray, levels: int, n: int) -> list[tuple[list[str], list[str]]]:
    """Of each leaf of a block its siblings before and after it, level by level up to the block's root."""
    at = _addresses(levels)
    left, right = ([[] for _ in range(n)] for _ in range(2))
    count = n
    for level in range(levels - 1):
        text = block[at[level][:count]].tobytes().hex()
        width, step = FAN**level, FAN ** (level + 1)
        for k in range(count):
            first, last = k - k % FAN, min(count, k - k % FAN + FAN)
            before, after = text[64 * first : 64 * k], text[64 * (k + 1) : 64 * last]
            for leaf in range(k * width, min(n, (k + 1) * width)):
                left[leaf].append(before)
                right[leaf].append(after)
        count = -(-n // step)
    return list(zip(left, right))


def folded(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that follows from a leaf and its siblings."""
    for a, b in zip(lefts, rights):
        leaf = sha256((a + leaf + b).encode()).hexdigest()
    return leaf


def layers(leaves: DataFrame, sizes: DataFrame, depth: int = 7) -> list[DataFrame]:
    """The blocks, layer by layer from the leaves up, of leaves (tree, rank, hash as 32 bytes): tables (tree, block, n, levels, nodes).
    sizes: (tree, size), a row a tree. The last layer has one block for each tree that reaches so far; a tree whose only block lies
    lower ends there."""
    spark = leaves.sparkSession
    span = FAN**depth
    schema = "tree string, block long, size long, n int, levels int, nodes binary, root binary"
    shape = to_arrow(schema, spark)

    def one(key, t):
        t = t.sort_by("rank")
        size = t.column("size")[0].as_py()
        got = np.frombuffer(b"".join(t.column("hash").to_pylist()), np.uint8).reshape(-1, 32)
        levels = levels_of(len(got)) if size <= span else depth + 1
        nodes = build(got, levels)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [size], [len(got)], [levels], [nodes.tobytes()], [nodes[0].tobytes()]], schema=shape)

    rows = sized_join(leaves, sizes, ["tree"], "inner")
    out = []
    while True:
        made = rows.withColumn("block", F.floor(F.col("rank") / span)).groupBy("tree", "block").applyInArrow(one, schema)
        out.append(written(made, "merkle-blocks"))
        rows = out[-1].where(F.col("size") > span).select("tree", F.col("block").alias("rank"), F.col("root").alias("hash"), F.ceil(F.col("size") / span).alias("size"))
        if not rows.limit(1).count():
            return out


def roots(blocks: list[DataFrame], depth: int = 7) -> DataFrame:
    """(tree, root) of each tree: the only block of its last layer has it."""
    span = FAN**depth
    done = [b.where(F.col("size") <= span).select("tree", "root") for b in blocks]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def proofs(blocks: list[DataFrame], above: DataFrame | None = None, depth: int = 7, leaves: bool = False) -> DataFrame:
    """PROOF of each block of the lowest layer: the siblings on the way from its root up to its tree's root, and further up as `above`
    (tree, lefts, rights) says. With leaves, of each leaf instead, block being its rank."""
    shape = to_arrow(PROOF, blocks[0].sparkSession)
    span = FAN**depth
    none = F.array().cast("array<string>")

    def below(key, t, p):
        r, p = t.to_pylist()[0], p.to_pylist()[0]
        rows = ways(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["levels"], r["n"])
        first = r["block"] * span
        return pa.table([[r["tree"]] * r["n"], range(first, first + r["n"]), [a + p["lefts"] for a, _ in rows], [b + p["rights"] for _, b in rows]], schema=shape)

    told = None
    for layer in reversed(blocks):
        ends = layer.where(F.col("size") <= span).select("tree", "block")
        ends = ends.withColumns({"lefts": none, "rights": none}) if above is None else sized_join(ends, above.select("tree", "lefts", "rights"), ["tree"], "inner")
        told = ends if told is None else told.unionByName(ends)
        if leaves or layer is not blocks[0]:
            own = layer.select("tree", "block", "n", "levels", "nodes").toDF("tree", "block", "n", "levels", "nodes")  # columns of its own: told may come from the same table
            told = written(own.groupBy("tree", "block").cogroup(told.groupBy("tree", "block")).applyInArrow(below, PROOF), "merkle-proofs")
    return told


def value(c: Column) -> Column:
    """How a value enters a leaf: - if null, else its bytes in UTF-8, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, columns: tuple[str, ...] = COLUMNS, text_col: str = "text") -> Column:
    """H of a row's columns; `text` stands in for the text column."""
    return F.sha2(F.concat(*[value(text if c == text_col else F.col(f"`{c}`")) for c in columns]).cast("binary"), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", depth: int = 7, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, rank, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    tampered: a text that is checked against the manifest instead of the row's own, null if the row is checked as it is."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    other = F.lit(None).cast("string") if tampered is None else tampered
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), source.alias("source"), F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("tree"),
                       F.unhex(leaf(text, columns, text_col)).alias("hash"), F.when(other.isNotNull(), F.unhex(leaf(other, columns, text_col))).alias("seen"))
    # hashes once, into a table; the row's place in it tells equal rows apart, however many there are
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "merkle-leaves")
    rows = numbered(rows, "doc_id", "hash", "place", within=("tree",), out="rank").drop("place")
    rows = rows.withColumn("block", F.floor(F.col("rank") / FAN**depth))
    sizes = written(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "merkle-sizes")
    own = layers(rows.select("tree", "rank", "hash"), sizes, depth)
    # "-" comes before "=", so the trees' order is that of the sources, null first
    subroots = written(numbered(roots(own, depth), "tree", out="rank"), "merkle-subroots")
    top = layers(subroots.select(F.lit("").alias("tree"), "rank", F.col("root").alias("hash")), subroots.agg(F.count(F.lit(1)).alias("size")).select(F.lit("").alias("tree"), "size"), depth)
    root = next((bytes(r.root).hex() for r in roots(top, depth).limit(1).collect()), "")

    def each(key, t, b):
        r = b.to_pylist()[0]
        t = t.sort_by("rank")
        hashes, seen, out = t.column("hash").to_pylist(), t.column("seen").to_pylist(), ([], [])
        for (lefts, rights), h, s in zip(ways(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["levels"], r["n"]), hashes, seen):
            lefts, rights = lefts + r["lefts"], rights + r["rights"]
            out[0].append(sha256("".join(x for pair in zip(lefts, rights) for x in pair).encode()).hexdigest())
            out[1].append(folded((h if s is None else s).hex(), lefts, rights))
        return pa.table([t.column("doc_id"), t.column("source"), t.column("rank"), [h.hex() for h in hashes], [r["subroot"].hex()] * r["n"], out[0], out[1]], schema=proved)

    schema = "doc_id long, source string, rank long, leaf string, subroot string, proof_sha256 string, folded_root string"
    proved = to_arrow(schema, spark)
    above = written(proofs(top, None, depth, leaves=True).select(F.col("block").alias("rank"), "lefts", "rights").join(subroots.select("rank", "tree"), "rank").drop("rank"), "merkle-above")
    blocks = sized_join(own[0].select("tree", "block", "n", "levels", "nodes"), proofs(own, above, depth), ["tree", "block"], "inner")
    blocks = sized_join(blocks, subroots.select("tree", F.col("root").alias("subroot")), ["tree"], "inner")
    out = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(each, schema)
    return out.select("doc_id", "source", "rank", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
