"""Near-duplicate documents by a chosen-path set similarity join over minwise signatures.

A document is the set of its five-word shingles. Documents with equal sets are one class at once. Each tree of the join starts
with all classes in its root; a node sends a class to the children of a few chosen signature places (1 / similarity of them on
average), a child being named by the place and its minwise value, so classes at the threshold meet in one child a level on
average. Nodes of at most `limit` classes are compared exhaustively by signature; larger ones branch again. Independent trees
repeat this: a pair misses all of them with a probability of about 0.25 ** trees at the threshold. Every pair that signatures
propose is confirmed on the full sets.

In a node only pairs that can still join two components matter. Members of a large node are first held against one of them
(a star), and nodes that are one component branch no further. A node is dense if branching does not thin it out (at least DENSE of its
members would stay in large nodes); it is compared exhaustively instead, as are nodes that are still large after `depth` levels.
Dense nodes that share documents (the trees find the same group again and again) are one group, and a group is cut into blocks of
4 * `limit`: every block of members outside the group's largest component meets every block, so no pair of different components is
left out. Where more than ODD_BLOCKS blocks are outside, the group's members are joined by their rarest shingles instead (an exact prefix filter), which
grows with the pairs near the threshold and not with the group's square. The rows of a level that do branch lessen by a factor of DENSE at least.

Nodes and cells propose a spanning forest of their likeliest pairs; among what is then still apart every likely pair is tested on
the full sets: as a row where a node has few of them, inside its node where they are many. So a group of thousands of near copies
gives links, not all its pairs.

Defined results. Fewer than five words: the whole sequence is the one shingle. No words or null text: an empty set, linked with
nothing, its own component. Rows that repeat an id are one document with the links of all its texts. A null id keeps a null
component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, keyed, rows_without, sized, sized_join, splitmix, to_arrow, written
from .components import components

WIDTH = 5
PLACES = 128
#: Share of a node's members that may stay in large nodes when it branches.
DENSE = 0.8
#: Blocks of odd members of a dense group that are compared exhaustively; wider groups are joined by rare shingles.
ODD_BLOCKS = 4
#: Members of a wide group from which on a shingle is counted.
MANY = 8
_FEATURES = "id long, n_shingles long, set_key binary, low binary, high binary, roots array<long>"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MUL = splitmix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = splitmix(np.arange(1001, PLACES + 1001, dtype=np.uint64))


class Shingler:
    """Shingle sets as ascending 64-bit hashes; keeps word hashes (a bounded cache)."""

    def __init__(self, most: int = 300_000):
        self.words: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = min(WIDTH, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)  # a short sequence differs from any shingle of WIDTH words
        for j in range(n):
            out = out * _PRIME + splitmix(h[j : j + len(out)])
        return np.unique(splitmix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """PLACES minwise values, 64 bits each."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[a : a + 2048, None] * _MUL + _ADD).min(axis=0), out=low)
    return splitmix(low)


def features(docs: DataFrame, id_col: str, text_col: str, trees: int, share: float) -> DataFrame:
    """_FEATURES of every whole text; set_key is null for an empty set. low and high are the two lowest bytes of each minwise
    value, roots the children of the trees' roots that the text is in (named by whole values)."""
    shape = to_arrow(_FEATURES, docs.sparkSession)
    tops = splitmix(np.arange(1, trees + 1, dtype=np.uint64))
    tops, places = (np.concatenate(x) for x in zip(*((tops[r], p) for r, p in (_chosen(tops, share, k) for k in range(2)))))

    def run(batches):
        make = Shingler()
        for b in batches:
            rows: list[tuple] = []
            for t in b.column("text"):
                s = make(t.as_py())
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                sig = signature(s)
                roots = _child(tops, places, sig[places]).view(np.int64).tolist()
                rows.append((len(s), hashlib.md5(s.tobytes()).digest(), sig.astype("u1").tobytes(), (sig >> np.uint64(8)).astype("u1").tobytes(), roots))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(shape)[1:]))], schema=shape)

    return id_text(docs, id_col, text_col).mapInArrow(run, _FEATURES)


def _chosen(node: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, place): the k-th chosen place of the nodes that have one: all have a first, and a second with the probability that makes
    1 / share on average."""
    there = np.ones(len(node), bool) if k == 0 else (splitmix(node) >> np.uint64(40)) < np.uint64(int((1 / share - 1) * (1 << 24)))
    at = np.flatnonzero(there)
    return at, (splitmix(node[at] + np.uint64(7 + k)) % np.uint64(PLACES)).astype(np.int64)


def _child(node: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The child of a node for a value at a place."""
    return splitmix(splitmix(node ^ (place.astype(np.uint64) + np.uint64(1)) * _PRIME) + value)


def _branch(own: DataFrame, sigs: DataFrame, share: float) -> DataFrame:
    """(parent, node, a) of the next level from members (node, a); a class meets its signature once, with all its nodes."""
    schema = "parent long, node long, a long"
    shape = to_arrow(schema, own.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                sig = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).astype(np.uint64)
                sig |= np.frombuffer(b"".join(part.column("high").to_pylist()), np.uint8).astype(np.uint64) << np.uint64(8)
                sig, nodes = sig.reshape(-1, PLACES), part.column("nodes")
                of = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(nodes).to_numpy(zero_copy_only=False))
                node = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                a = part.column("a").to_numpy(zero_copy_only=False)[of]
                for k in range(2):
                    i, place = _chosen(node, share, k)
                    child = _child(node[i], place, sig[of[i], place])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i].view(np.int64), child.view(np.int64), a[i])], schema=shape)

    return own.groupBy("a").agg(F.collect_list("node").alias("nodes")).join(sigs, "a").select("a", "nodes", "low", "high").mapInArrow(run, schema)


def _likely(sig: np.ndarray, comp: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members (rows of sig), likeliest first, whose signatures agree in a share of at least `least` places and
    whose components differ."""
    n = len(sig)
    if n == 2:
        both = np.arange(int(comp[0] != comp[1] and (sig[0] == sig[1]).mean() >= least))
        return both, both + 1
    found, step = [], max(1, (1 << 22) // (n * PLACES))
    for a in range(0, n, step):
        agree = np.count_nonzero(sig[a : a + step, None, :] == sig[None, :, :], axis=2)
        i, j = np.nonzero((agree >= least * PLACES) & (comp[a : a + step, None] != comp[None, :]))
        up = i + a < j
        found.append((agree[i[up], j[up]], i[up] + a, j[up]))
    agree, i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-agree, kind="stable")
    return i[order], j[order]


def _forest(i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs, in their order, that a greedy spanning forest of the components takes."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out, names = [], comp.tolist()
    for x, y in zip(i.tolist(), j.tolist()):
        u, v = root(names[x]), root(names[y])
        if u != v:
            up[u] = v
            out.append((x, y))
    return out


def _by_node(members: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """make(rows of one node) -> rows of schema, for members by node. Nodes are whole within a partition and bounded in size."""
    shape = to_arrow(schema, members.sparkSession)

    def run(batches):
        held: list[tuple] = []
        out = lambda found: pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], f.type) for k, f in enumerate(shape)], schema=shape)
        for b in batches:
            found: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                if held and held[0][0] != row[0]:
                    found += make(held)
                    held = []
                held.append(row)
            yield out(found)
        yield out(make(held))

    return members.select(columns).repartition("node").sortWithinPartitions("node", "a").mapInArrow(run, schema)


def _unpack(rows: list[tuple], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, comp, i, j) of rows (node, a, comp, low ...): their likely pairs."""
    a, comp = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    if len(rows) < 2 or (comp == comp[0]).all():
        return a, comp, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return a, comp, *_likely(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, PLACES), comp, least)


def _propose(members: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the spanning forest of each node's likeliest pairs; members are (node, a, comp, low)."""

    def pairs(rows):
        a, comp, i, j = _unpack(rows, least)
        return [(int(min(a[x], a[y])), int(max(a[x], a[y]))) for x, y in _forest(i, j, comp)]

    return _by_node(members, ["node", "a", "comp", "low"], pairs, "a long, b long").distinct()


def _remaining(members: DataFrame, least: float) -> DataFrame:
    """(node, a, b) of what is likely in a node: the pairs themselves (node is null) where they are at most twice its members, else each
    member that has a likely partner (b is null)."""

    def pairs(rows):
        a, _, i, j = _unpack(rows, least)
        if len(i) > 2 * len(rows):
            return [(rows[0][0], x, None) for x in np.unique(a[np.concatenate([i, j])]).tolist()]
        return [(None, int(min(a[x], a[y])), int(max(a[x], a[y]))) for x, y in zip(i, j)]

    return _by_node(members, ["node", "a", "comp", "low"], pairs, "node long, a long, b long").distinct()


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the full shingle sets of the documents in ids (id)."""
    rows = id_text(docs, id_col, text_col).join(sized(ids), "id", "left_semi")
    schema = "id long, s binary"
    shape = to_arrow(schema, docs.sparkSession)

    def run(batches):
        make = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([make(t.as_py()).tobytes() for t in part.column("text")], pa.binary())], schema=shape)

    return written(rows.mapInArrow(run, schema).distinct(), "shingle-sets")


def _similar(x, y, share: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True)) if not isinstance(x, frozenset) else len(x & y)
    return both > 0 and both >= share * (len(x) + len(y) - both) - 1e-9


def _confirm(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those pairs (a, b) of documents whose full sets have the similarity."""

    def test(batches):
        for b in batches:
            good = [_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), share) for x, y in zip(b.column("sa"), b.column("sb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()


def _confirm_in_nodes(members: DataFrame, least: float, share: float) -> DataFrame:
    """(a, b): confirmed links that join different components within a node; members are (node, a, comp, low, s). Likely pairs
    are tried likeliest first and never leave the task; a pair whose components are joined already is not tried."""

    def links(rows):
        _, _, i, j = _unpack(rows, least)
        sets, up, out = {}, {}, []

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def set_of(i):
            if i not in sets:
                sets[i] = frozenset(np.frombuffer(rows[i][4], "<u8").tolist())
            return sets[i]

        for x, y in zip(i.tolist(), j.tolist()):
            u, v = root(rows[x][2]), root(rows[y][2])
            if u != v and _similar(set_of(x), set_of(y), share):
                up[u] = v
                out.append((rows[x][1], rows[y][1]))
        return out

    return _by_node(members, ["node", "a", "comp", "low", "s"], links, "a long, b long").distinct()


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least `least` places."""

    def test(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least, pa.bool_()))

    both = pairs.join(sigs.select("a", F.col("low").alias("x")), "a").join(sigs.select(F.col("a").alias("b"), F.col("low").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _as_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(m: DataFrame, labels: DataFrame | None) -> DataFrame:
    """m with comp: the component of a, or a itself."""
    if labels is None:
        return m.withColumn("comp", F.col("a"))
    m = m.join(labels.select(F.col("node").alias("a"), "component"), "a", "left")
    return m.withColumn("comp", F.coalesce("component", "a")).drop("component")


def _apart(m: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Labelled rows of the nodes that hold more than one component."""
    m = _labelled(m, labels)
    mixed = m.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("node")
    return m.join(mixed, "node", "left_semi")


def _cells(dense: DataFrame, labels: DataFrame | None, block: int) -> tuple[DataFrame, DataFrame]:
    """((node, a), (g, a, comp)) of the groups that dense members (node, a) form: cells such that every two members of different components
    share one, and the members of groups that have too many odd members for it.

    The members of a group's largest component (core) and the others (odd) are dealt over blocks; each odd block meets every block. That
    is only done for up to ODD_BLOCKS odd blocks: members of wider groups are joined by rare shingles (_by_prefix)."""
    first = dense.groupBy("node").agg(F.min("a").alias("first"))
    group = components(dense.join(first, "node").select(F.col("a").alias("u"), F.col("first").alias("v")))
    rows = written(_labelled(group.select(F.col("component").alias("g"), F.col("node").alias("a")), labels), "near-groups")
    by = rows.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
    plan = by.where("n > top.n").select("g", F.col("top.comp").alias("core"), F.ceil(F.col("top.n") / block).alias("cores"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("odds"))
    wide = rows.join(plan.where(F.col("odds") > ODD_BLOCKS).select("g"), "g", "left_semi")
    rows = rows.join(plan.where(F.col("odds") <= ODD_BLOCKS), "g")
    deal = lambda n: F.pmod(F.xxhash64("a"), n)
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    cell = lambda kind, i, j: F.xxhash64("g", F.lit(kind), i.cast("long"), j.cast("long"))
    i = deal(F.col("odds"))
    odd = F.concat(each(F.col("odds"), lambda j: cell("odd", F.least(i, j), F.greatest(i, j))), each(F.col("cores"), lambda j: cell("core", i, j)))
    core = each(F.col("odds"), lambda k: cell("core", k, deal(F.col("cores"))))
    return rows.select(F.explode(F.when(F.col("comp") == F.col("core"), core).otherwise(odd)).alias("node"), "a"), wide.select("g", "a", "comp")


def _by_prefix(wide: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of members (g, a, comp) of a group, of different components, that may have the similarity: all that have it, and few
    others.

    Shingles are ordered by the members that have them, rarest first. Of two similar sets the one that isn't larger has a shingle of the
    other's first (1 - share) part among its own first (1 - 2 share / (1 + share)) part; the pair is kept if the places of the shingle that
    brought it here still allow enough of them in common. What all members share comes last in the order, so it brings no pair together
    unless their rest is too short to tell them apart."""
    schema = "g long, a long, comp long, own long, n int, h long"
    shape = to_arrow(schema, wide.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                own = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("s")]
                sizes = [len(x) for x in own]
                cols = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("g", "a", "comp")]
                cols.append(np.repeat(np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64).view(np.int64), sizes))  # an id may have several sets
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], schema=shape)

    rows = written(wide.join(sets.withColumnRenamed("id", "a"), "a").select("g", "a", "comp", "s").mapInArrow(run, schema), "near-shingles")
    # only what many have needs a count: all else comes first, in any order
    many = written(rows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("f")).where(f"f >= {MANY}"), "near-frequent")
    ranked = sized_join(rows, many, ["g", "h"], max_rows=1_000_000).withColumn("r", F.row_number().over(Window.partitionBy("g", "a", "own").orderBy(F.coalesce("f", F.lit(0)), "h")))
    ahead = lambda c: F.col("n") - F.ceil(F.lit(c) * F.col("n") - 1e-9) + 1
    ranked = written(ranked.where(F.col("r") <= ahead(share)).select("g", "a", "comp", "n", "h", "r", (F.col("r") <= ahead(2 * share / (1 + share))).alias("few")), "near-prefixes")
    one = ranked.select("g", "h", *[F.col(c).alias(f"{c}1") for c in ("a", "comp", "n", "r")])
    two = ranked.where("few").select("g", "h", *[F.col(c).alias(f"{c}2") for c in ("a", "comp", "n", "r")])
    after = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a1") != F.col("a2")))
    common = F.least("r1", "r2") + F.least(F.col("n1") - F.col("r1"), F.col("n2") - F.col("r2"))
    fits = (F.col("n2") >= share * F.col("n1") - 1e-9) & (common >= share / (1 + share) * (F.col("n1") + F.col("n2")) - 1e-9)
    return one.join(two, ["g", "h"]).where((F.col("comp1") != F.col("comp2")) & after & fits).select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")).distinct()


def groups(docs: DataFrame, share: float = 0.75, trees: int = 12, limit: int = 256, depth: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest id reachable by links."""
    least = share - 4 * (share * (1 - share) / PLACES) ** 0.5  # of the agreement of two signatures at the threshold
    feats = written(features(docs, id_col, text_col, trees, share), "near-features")
    # an id whose rows differ in text stands for all of them
    classes = feats.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("a"), F.min(F.struct("low", "high", "roots")).alias("x"))
    classes = written(classes.select("set_key", "a", "x.*"), "near-classes")
    sigs = classes.select("a", "low", "high")
    # an id with several texts joins their classes
    again = feats.where("set_key is not null").select("id", "set_key").join(classes.select("set_key", "a"), "set_key").where("id <> a").select(F.col("id").alias("u"), F.col("a").alias("v"))
    shared = again.join(again.groupBy("u").agg(F.count_distinct("v").alias("n")).where("n > 1").select("u"), "u", "left_semi")
    named = again.join(classes.select(F.col("a").alias("u")).distinct(), "u", "left_semi")
    all_links = written(shared.unionByName(named).distinct(), "near-same-ids")

    nodes = written(classes.select(F.explode("roots").alias("node"), "a"), "near-nodes")
    sizes = written(nodes.groupBy("node").count().where("count > 1"), "near-sizes")
    leaves, dense, labels = [nodes.join(sizes.where(F.col("count") <= limit).select("node"), "node", "left_semi")], [], None
    large = sizes.where(F.col("count") > limit).select("node")
    if large.limit(1).count():
        own = nodes.join(large, "node", "left_semi")
        # most of a large group is linked with one of its members; nodes that are one component need no branching
        star = own.groupBy("node").agg(F.min_by("a", F.xxhash64("a")).alias("p"))
        star = own.join(star, "node").where("a <> p").select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b")).distinct()
        star = written(_agreeing(star, sigs, least), "near-star")
        sets = _sets(star.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, id_col, text_col)
        all_links = all_links.unionByName(_as_links(written(_confirm(star, sets, share), "near-links")))
        labels = written(components(all_links), "near-labels")
        own = written(_apart(own, labels).select("node", "a"), "near-large")
        for _ in range(depth - 1):
            if not own.limit(1).count():
                break
            nodes = written(_branch(own, sigs, share), "near-nodes")
            sizes = written(nodes.groupBy("node").count().where("count > 1"), "near-sizes")
            still = written(_apart(nodes.join(sizes.where(F.col("count") > limit).select("node"), "node", "left_semi"), labels).select("parent", "node", "a"), "near-large")
            before = own.groupBy(F.col("node").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
            tight = still.groupBy("parent").agg(F.count(F.lit(1)).alias("m")).join(before, "parent").where(F.col("m") >= DENSE * F.col("n")).select("parent")
            tight = written(tight, "near-dense")
            dense.append(own.join(tight.select(F.col("parent").alias("node")), "node", "left_semi"))
            leaf = nodes.join(sizes.where(F.col("count") <= limit).select("node"), "node", "left_semi")
            leaves.append(leaf.join(tight, "parent", "left_anti").select("node", "a"))
            own = still.join(tight, "parent", "left_anti").select("node", "a")
        dense.append(own)
        own = dense[0]
        for x in dense[1:]:
            own = own.unionByName(x)
        own = written(own, "near-dense")
        if own.limit(1).count():
            cells, wide = _cells(own, labels, 4 * limit)
            leaves.append(cells)
            wide = written(wide, "near-wide")
            if wide.limit(1).count():
                sets = _sets(wide.select(F.col("a").alias("id")).distinct(), docs, id_col, text_col)
                pairs = written(_by_prefix(wide, sets, share), "near-prefix-pairs")
                all_links = all_links.unionByName(_as_links(written(_confirm(pairs, sets, share), "near-links")))
    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    members = written(_apart(members.distinct(), labels).select("node", "a", "comp"), "near-members")
    low = sigs.select("a", "low")

    pairs = written(_propose(members.join(low, "a"), least), "near-pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, id_col, text_col)
    all_links = all_links.unionByName(_as_links(written(_confirm(pairs, sets, share), "near-links")))
    labels = written(components(all_links), "near-labels")

    # every likely pair that is still apart
    left = written(_apart(members.select("node", "a"), labels), "near-left")
    left_pairs = written(_remaining(left.join(low, "a"), least), "near-left-pairs")
    tried = left_pairs.where("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    inside = left.join(left_pairs.where("b is null").select("node", "a"), ["node", "a"], "left_semi")
    tried, inside = written(tried, "near-pairs"), written(inside, "near-left")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("id")).unionByName(inside.select(F.col("a").alias("id"))).distinct()
    sets = sets.unionByName(_sets(wanted.join(sets.select("id"), "id", "left_anti"), docs, id_col, text_col))
    more = _confirm(tried, sets, share).unionByName(_confirm_in_nodes(inside.join(low, "a").join(sets.withColumnRenamed("id", "a"), "a"), least, share))
    more = written(more, "near-links")
    if more.limit(1).count():
        labels = written(components(all_links.unionByName(_as_links(more))), "near-labels")
    label = labels.select(F.col("node").alias("a"), "component")
    of_class = classes.select("set_key", "a").join(label, "a", "left").select("set_key", F.coalesce("component", "a").alias("component"))
    out = feats.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **k) -> DataFrame:
    """docs with one row of each group: the one with the smallest id. Rows count, whatever their ids: those without an id are
    grouped as well (a row with an id stays before them), and of rows that are equal in id and text one stays. All columns stay as
    they are."""
    rows = keyed(docs, id_col, text_col)
    found = written(groups(rows, id_col="row", **k).select(F.col("doc_id").alias("row"), "component_id"), "near-found")
    several = found.groupBy("component_id").count().where("count > 1").select("component_id")
    members = found.join(several, "component_id", "left_semi").distinct()
    ranked = rows.select("row", "id").join(members, "row").distinct()
    stays = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    gone = written(members.select("row").join(stays, "row", "left_anti"), "near-gone")
    again = written(found.groupBy("row").count().where("count > 1").select("row"), "near-equal")
    return rows_without(docs, gone, id_col, text_col, once=again)
