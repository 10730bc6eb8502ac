import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, for each node the list of (siblings before, siblings after)), by the definition."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for w, k in zip(ways, at):
            w.append((runs[k // 3][: k % 3], runs[k // 3][k % 3 + 1 :]))
        at = [k // 3 for k in at]
        nodes = [H(*r) for r in runs]
    return nodes[0], ways


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted results of the operator's query."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    within = [climb([x[2] for x in trees[s]]) for s in order]
    root, tops = climb([r for r, _ in within])
    out = []
    for s, (sub, ways), top in zip(order, within, tops):
        for (_, _, leaf, r), way in zip(trees[s], ways):
            seen = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = plain_leaf(*r[:4], r[4].replace("\n", ""))
            proof = H(*[x for a, b in way + top for x in a + b])
            for a, b in way + top:
                seen = H(*a, seen, *b)
            out.append((r[0], leaf, sub, root, proof, seen, seen == root))
    return sorted(out, key=str)


def run(df, depth=7):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(df, depth=depth, tampered=F.when(even, F.translate("text", "\n", "")))
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


COLS = "doc_id long, source string, lang string, n_chars long, text string"


def some(n, seed):
    r = random.Random(seed)
    pick = lambda: r.choice([None, "", "é", "src", "src", "src", "Z", "a\x00b", "￿", "😀"])
    return [(i * 3 + 1, pick(), r.choice([None, "en"]), r.choice([None, 0, -5]), r.choice([None, "", "a\nb", f"row {i}\n\n", "é漢😀"])) for i in range(n)]


@pytest.mark.parametrize("n,depth", [(1, 7), (2, 1), (3, 1), (4, 1), (10, 1), (100, 1), (100, 2), (300, 3), (300, 7)])
def test_equals_the_definition(spark, n, depth):
    rows = some(n, n + depth)
    random.Random(1).shuffle(rows)
    assert run(spark.createDataFrame(rows, COLS).repartition(5), depth) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 97:05d}", "en", 1, f"t{i}") for i in range(200)]
    assert run(spark.createDataFrame(rows, COLS), 2) == brute(rows)


def test_ties_and_repeats(spark):
    """Rows that share an id are ordered by hash; equal rows take places of their own."""
    rows = [(7, "s", None, 1, "same\n")] * 9 + [(7, "s", None, 1, "other")] * 2 + [(None, "s", None, None, "no id\n"), (None, None, None, None, None)]
    assert run(spark.createDataFrame(rows, COLS), 1) == brute(rows)


def test_layout_is_van_emde_boas():
    """Every node has an address of its own, and each aligned subtree of half height is one stretch of memory."""

    def layout(levels, depth, index):
        if levels == 1:
            return [(depth, index)]
        top = levels // 2
        out = layout(top, depth, index)
        for k in range(3**top):
            out += layout(levels - top, depth + top, index * 3**top + k)
        return out

    for levels in range(1, 8):
        want = {node: i for i, node in enumerate(layout(levels, 0, 0))}
        got = {(d, k): int(a) for d in range(levels) for k, a in enumerate(merkle.address(levels, d, np.arange(3**d)))}
        assert got == want and len(want) == merkle.nodes_in(levels)


def test_a_changed_leaf_is_found(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, COLS)
    got = merkle.manifest(df, tampered=F.when(F.col("doc_id") == 31, F.lit("changed"))).select("doc_id", "verified").collect()
    assert all(r.verified == (r.doc_id != 31) for r in got)


def test_odd_rows(odd, empty):
    assert merkle.manifest(empty).count() == 0
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert run(odd) == brute(rows)


def test_query_and_written_sql(spark, docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows) and 0 < sum(r[6] for r in got) < len(got)
    duck = duckdb.connect()
    duck.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(duck.execute(queries.ORACLES["op13_merkle_manifest"]).fetchall(), key=str) == got
