import random

from pyspark.sql import functions as F

from quillspark.llm import near_dup


def brute(rows):
    """component by id, all pairs compared."""
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((root(i), root(j)))
                up[v] = u
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def result(df, **k):
    return sorted(tuple(r) for r in near_dup.groups(df, **k).collect())


def test_equals_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == brute(rows)


def test_large_groups_and_small_nodes(spark):
    """Limits far below the group sizes: nodes branch, large ones are dealt over blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g, (size, edits) in enumerate([(60, 1), (50, 6), (30, 14), (20, 30)]):
        base = [word() for _ in range(220)]
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(100))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert result(df, limit=8, depth=2) == brute(rows)


def test_odd_rows(odd, empty):
    assert near_dup.groups(empty).count() == 0
    got = result(odd.where("doc_id is not null"))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    assert near_dup.groups(odd).where("doc_id is null and component_id is null").count() == 1


def test_an_id_with_two_texts_joins_both(spark):
    t = ["one two three four five six seven", "red blue green grey pink teal gold"]
    df = spark.createDataFrame([(1, t[0]), (5, t[0]), (5, t[1]), (7, t[1]), (3, t[1])], "doc_id long, text string")
    assert {r.component_id for r in near_dup.groups(df).collect()} == {1}


def test_links_between_blocks_of_a_large_node(spark):
    """One tree whose only node holds all documents: pairs of near copies are dealt to different blocks of it."""
    rng = random.Random(55)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    common, rows = some(120), []
    for _ in range(12):
        own = some(100)
        for v in range(2):
            x = list(own)
            x[rng.randrange(100)] = f"x{v}"
            rows.append((len(rows), " ".join(common + x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, limit=4, trees=1, depth=1) == brute(rows)


def test_a_leaf_whose_first_pair_between_two_components_fails(spark):
    """8 and 9 are linked by a large node's star; in their leaves the forest may take (8, 10), which is no link; (9, 10) is."""
    rng = random.Random(53)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    common, own = some(120), some(80)
    texts = []
    for edits in (2, 1, 1):
        x = common + own
        for _ in range(edits):
            x[rng.randrange(len(x))] = f"x{rng.randrange(10**6)}"
        texts.append(x)
    texts[2][180:194] = [f"y{k}" for k in range(14)]
    rows = [(8 + k, " ".join(x)) for k, x in enumerate(texts + [common + some(80) for _ in range(7)])]
    want = brute(rows)
    assert [r[2] for r in want[:3]] == [8, 8, 8]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), limit=7, trees=4, depth=3) == want


def test_a_small_limit_loses_no_pair_of_a_node(spark):
    """One tree without branching: 150 pairs under a frequent line; what its nodes hold is found whatever the limit."""
    rng = random.Random(7)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    common, rows = some(60), []
    for _ in range(150):
        own = some(60)
        for v in range(2):
            x = list(own)
            x[rng.randrange(60)] = f"x{v}"
            rows.append((len(rows), " ".join(common + x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = result(df, limit=100_000, trees=1, depth=1)
    assert result(df, limit=16, trees=1, depth=1) == whole
    assert result(df, limit=16, depth=3) == brute(rows)


def _under_boilerplate(n, seed=4, pairs=0):
    """n texts that share 60 of 85 words, which joins none of them; the first `pairs` have a near copy."""
    rng = random.Random(seed)
    some = lambda k: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(k)]
    common = some(60)
    texts = [common + some(25) for _ in range(n)]
    texts += [t[:-1] + ["changed"] for t in texts[:pairs]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_wide_groups_are_joined_by_rare_shingles(spark, monkeypatch):
    """The same components whether a dense group's odd members are compared in cells or by prefixes."""
    monkeypatch.setattr(near_dup, "ODD_BLOCKS", 0)
    rows = _under_boilerplate(150, pairs=20)
    rows += [(1000, rows[3][1]), (1000, rows[70][1]), (1001, rows[5][1] + " and a little more")]  # an id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, limit=8) == brute(rows)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, base = [], [word() for _ in range(200)]
    for i in range(90):  # from near copies to texts just beyond the threshold, of different lengths
        w = base[: rng.randint(120, 200)]
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, limit=6, depth=2) == brute(rows)


def test_prefix_pairs_are_all_and_few(spark):
    """Every similar pair is proposed, and texts under one boilerplate propose none however many they are."""
    from pyspark.sql import functions as F

    for n in (200, 800):
        rows = _under_boilerplate(n, pairs=10)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        wide = df.select(F.lit(0).cast("long").alias("g"), F.col("doc_id").alias("a"), F.col("doc_id").alias("comp"))
        got = {tuple(r) for r in near_dup._by_prefix(wide, near_dup._sets(df.select(F.col("doc_id").alias("id")), df, "doc_id", "text"), 0.75).collect()}
        assert {(i, n + i) for i in range(10)} <= got and len(got) <= 20


def test_one_row_of_each_group_stays(spark):
    t = ["one two three four five six seven", "one two three four five six seven", "red blue green grey pink teal gold"]
    rows = [(None, t[0], 1), (4, t[0], 2), (2, t[1], 3), (None, t[2], 4), (None, t[2], 5), (7, "other words stand in this text", 6), (7, "other words stand in this text", 7), (7, "and more words of another text", 8), (9, None, 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("_gone", F.lit(1)).withColumn("row_key", F.lit(1))
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r.n for r in kept.collect())
    assert [n for n in got if n < 4] == [3] and len({4, 5} & set(got)) == 1 and len({6, 7} & set(got)) == 1
    assert {8, 9, 10} <= set(got) and len(got) == 6
