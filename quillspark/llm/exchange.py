"""Totals of 64-bit keys that blocks of documents count, told to each block that has the key.

Blocks send their keys to buckets by the first bits of the key; a bucket adds up and answers. With as many buckets as data, every block
would have a row for every bucket, so rows would grow with the square of the data. Hence buckets come in levels of `radix` bits: on
a level up to 2 ** radix units with the same first bits meet, their keys become one unit's, cut by the next bits, and only the last
level adds up for good. Answers go down the same levels. A row then holds about a 2 ** -radix part of a unit's keys however many blocks
there are, rows grow in proportion to the data (times the levels), and no group is larger than a few blocks' keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, packed_counts, packed_keys, to_arrow, unpacked_counts, unpacked_keys, written

SENT = "n int, bucket long, unit long, keys binary, counts binary"
ANSWER = "n int, bucket long, unit long, totals binary, types long, tokens long"


def sent_rows(n: int, unit: int, keys: np.ndarray, counts: np.ndarray | None, bits: int, radix: int) -> list[tuple]:
    """SENT rows of a block's ascending keys and their counts (None: one each, which takes no room)."""
    return [(n, k, unit, packed_keys(keys[s]), b"" if counts is None else packed_counts(counts[s])) for k, s in by_bucket(keys, min(bits, radix))]


def table(rows: list[tuple], shape: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)


def _added(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(keys of each row, different keys, their totals, where each key of all rows is among them)."""
    each = [unpacked_keys(x.as_buffer()) for x in t.column("keys")]
    kinds, index = np.unique(np.concatenate(each), return_inverse=True)
    totals = np.zeros(len(kinds), np.int64)
    if "counts" in t.column_names:
        counts = [unpacked_counts(c.as_buffer()) if len(c.as_buffer()) else np.ones(len(k), np.int64) for c, k in zip(t.column("counts"), each)]
        np.add.at(totals, index, np.concatenate(counts))
    return each, kinds, totals, index


def _answers(t: pa.Table, each: list[np.ndarray], values: np.ndarray, shape: pa.Schema, types: int = 0, tokens: int = 0) -> pa.Table:
    """An answer to each row: values are those of all rows' keys, one after the other."""
    at = np.cumsum([0, *map(len, each)]).tolist()
    rest = [0] * (len(each) - 1)
    out = [packed_counts(values[a:b]) for a, b in zip(at, at[1:])]
    return pa.table([t.column("n"), t.column("bucket"), t.column("unit"), pa.array(out, pa.binary()), pa.array([types, *rest], pa.int64()), pa.array([tokens, *rest], pa.int64())], schema=shape)


def add_up(sent: DataFrame, bits: int, tag: str, radix: int = 8, tell: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, top): ANSWER rows, one for each of the SENT rows, with the totals of its keys; and those of the last level, whose types
    and tokens are the numbers of different keys with a count, and of all counts. tell: what is answered instead of the totals, from
    the ascending different keys of a bucket of the last level and their totals."""
    spark = sent.sparkSession
    sent_shape, answer_shape = to_arrow(SENT, spark), to_arrow(ANSWER, spark)
    levels, have = [], min(bits, radix)

    def merge(more: int):
        def one(key, t):
            _, kinds, totals, _ = _added(t)
            return table([(key[0].as_py(), k, key[2].as_py(), packed_keys(kinds[s]), packed_counts(totals[s])) for k, s in by_bucket(kinds, more)], sent_shape)

        return one

    while have < bits:  # up
        more = min(bits, have + radix)
        rows = written(sent, tag + "-sent")
        levels.append((rows, more - have))
        sent = rows.withColumn("group", F.shiftright("unit", radix)).groupBy("n", "bucket", "group").applyInArrow(merge(more), SENT)
        have = more

    def add(key, t):
        each, kinds, totals, index = _added(t)
        told = totals if tell is None else tell(kinds, totals)
        return _answers(t, each, told[index], answer_shape, int((totals > 0).sum()), int(totals.sum()))

    top = answers = written(sent.groupBy("n", "bucket").applyInArrow(add, ANSWER), tag + "-totals")

    def down(key, t, a):
        each, kinds, _, index = _added(t)
        a = a.sort_by("below")
        totals = np.concatenate([unpacked_counts(x.as_buffer()) for x in a.column("totals")])
        return _answers(t, each, totals[index], answer_shape)

    for rows, step in reversed(levels):  # down: a unit's answers, bucket by bucket, are those of its different keys in order
        left = rows.drop("counts").withColumn("group", F.shiftright("unit", radix))
        right = answers.select("n", F.shiftright("bucket", step).alias("bucket"), F.col("unit").alias("group"), F.col("bucket").alias("below"), "totals")
        answers = written(left.groupBy("n", "bucket", "group").cogroup(right.groupBy("n", "bucket", "group")).applyInArrow(down, ANSWER), tag + "-totals")
    return answers, top
