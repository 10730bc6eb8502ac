"""Mixture-controlled packing: deficit round robin over source queues fills every window to the target token proportions.

Documents are tokenised once into a table, dealt over parts source by source in turn (so every part holds an even slice of every source,
a hot one too), and each part is packed on its own: a window adds share * window to each source's deficit, sources with a
deficit of at least `grain` are served in turn, and what is left of the window goes to the largest deficits. Deficits carry
over from window to window. From part to part they carry too: what the earlier parts owe or are ahead for a source follows
from their token totals alone (share * tokens of the part - tokens of the source in it), so it is a running sum over a small
table and parts need not wait for each other. Targets default to the sources' shares of all tokens, with which every queue
runs dry at the same time; other targets hold as long as their sources last, and then the rest shares the windows.

Defined results. A null text is empty: its document is the end id alone. A null source is the source "". Equal ids or rows are
packed once each. An empty table gives no pieces. The last window of a part is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import running
from .common import to_arrow, written
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = 0) -> DataFrame:
    """(id, source, n_tokens, ids, turn) of every whole text, the end id included; ids are little-endian 16-bit numbers, and turn numbers
    the texts of a source within a task from a place of their own, whatever their ids."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, source string, n_tokens long, ids binary, turn long"
    shape, end = to_arrow(schema, docs.sparkSession), int(end_id)

    def run(batches):
        from pyspark import TaskContext

        enc, task, turns = encoder(), TaskContext.get().partitionId(), {}
        for b in batches:
            for a in range(0, b.num_rows, 500):  # small batches out: ids of a few hundred documents at a time
                part, ids, turn = b.slice(a, 500), [], []
                for t in part.column("text").to_pylist():
                    x = enc.ids(t)
                    x.append(end)
                    ids.append(x.tobytes())
                for s in part.column("source").to_pylist():
                    turns[s] = turns.get(s, zlib.crc32(f"{task} {s}".encode())) + 1
                    turn.append(turns[s])
                yield pa.RecordBatch.from_pydict({"turn": turn, "id": part.column("id"), "source": part.column("source"), "n_tokens": [len(x) // 2 for x in ids], "ids": ids}, schema=shape)

    return rows.mapInArrow(run, schema)


def fill(queues: list[deque], share: np.ndarray, deficit: np.ndarray, window: int, grain: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Windows, each a list of (source, document, start, length). queues: for each source (document, tokens) in order."""
    left = np.array([sum(n for _, n in q) for q in queues], np.int64)
    at = [0] * len(queues)  # tokens of each queue's first document that are out already
    live = left > 0
    gain, turn = None, 0

    def serve(s: int, take: int, out: list) -> int:
        nonlocal gain
        has = left.item(s)
        take = served = min(take, has)
        left[s] = has - take
        deficit[s] -= take
        if take == has:
            live[s], gain = False, None
        queue, start = queues[s], at[s]
        while take:
            doc, n = queue[0]
            step = min(take, n - start)
            out.append((s, doc, start, step))
            start += step
            take -= step
            if start == n:
                queue.popleft()
                start = 0
        at[s] = start
        return served

    while live.any():
        if gain is None:  # what a window adds changes only when a queue has run dry
            weights = np.where(live, np.maximum(share, 1e-12), 0)
            gain = weights / weights.sum() * window
        deficit += gain
        room, out = window, []
        ready = np.flatnonzero(live & (deficit >= np.minimum(grain, left))).tolist()
        first = turn % max(1, len(ready))
        for s in ready[first:] + ready[:first]:
            if not room:
                break
            room -= serve(s, min(room, max(1, int(deficit.item(s)))), out)
        turn += 1
        while room and live.any():
            s = int(np.argmax(np.where(live, deficit, -np.inf)))
            room -= serve(s, min(room, max(grain, int(deficit.item(s)))), out)
        yield out


def _cut(windows: Iterator[list], window: int) -> Iterator[list]:
    """The windows; a last, partial one comes as sequences of power-of-two lengths."""
    for w in windows:
        n = sum(x[3] for x in w)
        if n == window:
            yield w
            continue
        parts = deque(w)
        while n:
            size = 1 << (n.bit_length() - 1)
            n, seq = n - size, []
            while size:
                s, doc, start, length = parts.popleft()
                step = min(length, size)
                seq.append((s, doc, start, step))
                size -= step
                if step < length:
                    parts.appendleft((s, doc, start + step, length - step))
            yield seq


def pack(tokens: DataFrame, window: int = 1024, grain: int = 64, part_tokens: int = 1 << 20, targets: DataFrame | None = None) -> DataFrame:
    """Pieces (PIECE) of token_table()'s rows. targets: (source, share); sources without a row get 0."""
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    tokens = tokens.withColumn("part", F.pmod("turn", F.lit(parts)).cast("int"))
    have = written(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("have")), "packing-totals")
    if targets is None:
        targets = have.groupBy("source").agg((F.sum("have") / F.lit(max(1, total))).alias("share"))
    size = have.groupBy("part").agg(F.sum("have").alias("size"))
    sources = have.select("source").distinct().join(targets.select("source", "share"), "source", "left").fillna(0.0, ["share"])
    owed = have.join(size, "part").join(sources, "source")
    # what a part is owed when it starts: a running sum in two levels, without its own share
    mine = F.col("share") * F.col("size") - F.col("have")
    plan = running(owed.select("part", "source", "share", mine.alias("mine"), mine.alias("carry")), "part", of={"carry": F.col("carry")}, within=("source",))
    plan = plan.select("part", "source", "share", (F.col("carry") - F.col("mine")).alias("carry"))
    shape = to_arrow(PIECE, tokens.sparkSession)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        names = sorted(right.column("source").to_pylist())
        told = {s: (a, c) for s, a, c in zip(*(right.column(x).to_pylist() for x in ("source", "share", "carry")))}
        left = left.sort_by([("id", "ascending"), ("ids", "ascending")])
        n = left.column("n_tokens").to_pylist()
        queues = {s: deque() for s in names}
        for i, s in enumerate(left.column("source").to_pylist()):
            queues[s].append((i, n[i]))
        share, carry = (np.array([told[s][k] for s in names], float) for k in (0, 1))
        pieces, in_seq = [], []
        for seq in _cut(fill([queues[s] for s in names], share, carry, window, grain), window):
            pieces += seq
            in_seq.append(len(seq))
        # what a document or a sequence says of its pieces is looked up for all of them at once
        ids = [np.frombuffer(x.as_buffer(), "<u2") for x in left.column("ids")]
        crcs = [zlib.crc32(ids[doc][start : start + length].astype("<u4")) for _, doc, start, length in pieces]
        _, doc, start, length = np.array(pieces, np.int64).reshape(-1, 4).T
        end = np.cumsum(length)
        first = np.cumsum(in_seq) - in_seq  # the first piece of each sequence
        offset = end - length - np.repeat((end - length)[first], in_seq)
        of = left.select(["id", "n_tokens", "source"]).take(pa.array(doc))
        cols = (of.column("id"), start, length, crcs, of.column("n_tokens"), (part << 32) + np.repeat(np.arange(len(in_seq)), in_seq), offset, of.column("source"))
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(cols, shape)], schema=shape)

    return tokens.groupBy("part").cogroup(plan.groupBy("part")).applyInArrow(run, PIECE)


def packed(docs: DataFrame, window: int = 1024) -> DataFrame:
    """Documents tokenised (once, into the shared folder) and packed."""
    return pack(written(token_table(docs), "tokens"), window)
