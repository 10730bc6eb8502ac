import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.common import written


def check(df, window, **k):
    """Every id once, sequences gapless and full or a power of two; returns the pieces."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in df.collect()}
    rows = packing.pack(packing.token_table(df), window, **k).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(docs[i])
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0
    return rows


def test_every_id_once(docs):
    check(docs, 1024)
    check(docs, 256, part_tokens=20_000, grain=16)


def test_special_and_odd_white_space(spark):
    rows = [(1, "a<|endoftext|>b"), (2, "tab\tand  double \r\n space"), (3, None), (4, ""), (5, "\x85 é 漢 😀"), (6, " lead"), (7, "trail ")]
    check(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"), 64)


def test_windows_hold_the_target_proportions(spark):
    rows = [(i, "word " * 300, f"s{0 if i % 6 < 3 else i % 6}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = check(df, 1024, part_tokens=20_000)
    total: dict = {}
    for r in pieces:
        total.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        total[r.sequence_id][r.source] += r.length
    full = [x for x in total.values() if sum(x.values()) == 1024]
    assert np.mean([x.get("s0", 0) for x in full]) == pytest.approx(512, rel=0.1)
    assert np.mean([abs(x.get("s0", 0) - 512) <= 192 for x in full]) > 0.8


def test_deficits_carry_over_parts(spark):
    df = spark.createDataFrame([(i, "one two three", f"s{i % 2}") for i in range(50)], "doc_id long, text string, source string")
    t = written(packing.token_table(df), "t")
    a = sorted(map(tuple, packing.pack(t, 16, part_tokens=30).collect()))
    assert a == sorted(map(tuple, packing.pack(t, 16, part_tokens=30).collect())) and len({r[5] >> 32 for r in a}) > 3


def test_odd_rows(odd, empty):
    assert packing.packed(empty).count() == 0
    distinct = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(distinct, 1024)
    assert packing.packed(odd).selectExpr("sum(length)").first()[0] == packing.token_table(odd).selectExpr("sum(n_tokens)").first()[0]


def test_a_windows_gain_is_worked_out_when_a_queue_runs_dry(monkeypatch):
    from collections import deque

    calls, plain = [], np.maximum
    monkeypatch.setattr(packing.np, "maximum", lambda *a: calls.append(1) or plain(*a))
    queues = [deque([(0, 700), (1, 900)]), deque([(2, 400)]), deque()]
    windows = list(packing.fill(queues, np.array([0.6, 0.4, 0.0]), np.zeros(3), 16, 4))
    assert len(windows) == 125 and all(sum(x[3] for x in w) == 16 for w in windows)
    assert len(calls) == 2 and not any(queues)
