"""Token counts of documents in flat token files that have no index: a vectorised scan for the end-of-document id.

A flat file is a run of fixed-size blocks of 16-bit ids; documents lie across block boundaries. Each block is searched on its
own for the end id (one vector comparison); what crosses a boundary is stitched with a prefix scan over block summaries: a
running sum of tokens, a running sum of ends and a running maximum of the last end's place, first within groups of blocks and
then over the groups, so that no task takes in all blocks of a long file.

Defined results. A null or empty text is a document of no tokens and gives a count of 0. Ids after a file's last end id are a
document that was not ended: closed is false. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, to_arrow, written
from .tokens import END, encoder

GROUP = 512


def flat_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 16, end_id: int = END) -> DataFrame:
    """Texts as flat token files, in the shared folder: rows (file, block_no, ids) hold the blocks and rows (file, doc_no, id)
    which document was written where (the scan does not read those)."""
    schema = "file string, block_no long, ids binary, doc_no long, id long"
    shape, end = to_arrow(schema, docs.sparkSession), np.array([end_id], "<u2").tobytes()

    def run(batches):
        enc, name, rest, block_no, doc_no = encoder(), uuid.uuid4().hex, bytearray(), 0, 0

        def rows(whole: bool):
            nonlocal block_no
            out = []
            while len(rest) >= 2 * block or whole and rest:
                out.append(bytes(rest[: 2 * block]))
                del rest[: 2 * block]
            first, block_no = block_no, block_no + len(out)
            return {"file": [name] * len(out), "block_no": list(range(first, block_no)), "ids": out, "doc_no": [None] * len(out), "id": [None] * len(out)}

        for b in batches:
            for t in b.column("text").to_pylist():
                rest += enc.ids(t, special=False).tobytes() + end
                if len(rest) > 64 * block:
                    yield pa.RecordBatch.from_pydict(rows(False), schema=shape)
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({"file": [name] * n, "block_no": [None] * n, "ids": [None] * n, "doc_no": list(range(doc_no, doc_no + n)), "id": b.column("id")}, schema=shape)
            doc_no += n
        yield pa.RecordBatch.from_pydict(rows(True), schema=shape)

    return written(id_text(docs, id_col, text_col).mapInArrow(run, schema), "token-files")


def scan(blocks: DataFrame, end_id: int = END) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) from blocks (file, block_no, ids); start and n_tokens count ids, without ends."""
    schema = "file string, block_no long, n long, ends array<int>"
    shape = to_arrow(schema, blocks.sparkSession)

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column("ids")]
            yield pa.RecordBatch.from_pydict({"file": b.column("file"), "block_no": b.column("block_no"), "n": [len(x) for x in ids], "ends": [np.flatnonzero(x == end_id).astype(np.int32) for x in ids]}, schema=shape)

    found = written(blocks.select("file", "block_no", "ids").mapInArrow(run, schema), "token-ends")
    found = found.withColumn("g", F.floor(F.col("block_no") / GROUP))
    own = found.select("file", "g", "block_no", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    within = Window.partitionBy("file", "g").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("file", "g").agg(F.sum("n").alias("gn"), F.sum("k").alias("gk"))
    over = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "g", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("gk").over(over), F.lit(0)).alias("k0"))
    own = own.withColumns({"bn": F.coalesce(F.sum("n").over(within), F.lit(0)), "bk": F.coalesce(F.sum("k").over(within), F.lit(0))}).join(sums, ["file", "g"])
    own = own.select("file", "g", "block_no", (F.col("n0") + F.col("bn")).alias("at"), (F.col("k0") + F.col("bk")).alias("doc0"), "n", (F.col("n0") + F.col("bn") + F.col("last")).alias("last_end"))
    # the last end before a block: within its group, else the last of earlier groups
    last_g = own.groupBy("file", "g").agg(F.max("last_end").alias("ge"))
    last_g = last_g.select("file", "g", F.max("ge").over(over).alias("e0"))
    own = own.withColumn("be", F.max("last_end").over(within)).join(last_g, ["file", "g"])
    own = own.select("file", "block_no", "at", "doc0", "n", F.coalesce("be", "e0", F.lit(-1)).alias("before"), "last_end")
    rows = found.select("file", "block_no", "ends").join(own, ["file", "block_no"])
    closed = rows.select("file", "at", "doc0", "before", "ends", F.posexplode("ends").alias("i", "e"))
    start = F.when(F.col("i") == 0, F.col("before") + 1).otherwise(F.col("at") + F.element_at("ends", F.greatest(F.lit(1), F.col("i"))) + 1)
    closed = closed.select("file", (F.col("doc0") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("at") + F.col("e") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = own.groupBy("file").agg(F.max(F.col("at") + F.col("n")).alias("n"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("e"))
    k = found.groupBy("file").agg(F.sum(F.size("ends")).alias("doc_no"))
    open_ = whole.where("n > e + 1").join(k, "file").select("file", "doc_no", (F.col("e") + 1).alias("start"), (F.col("n") - F.col("e") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document, by way of flat files and the scan."""
    files = flat_files(docs, id_col, text_col)
    counts = scan(files.where("block_no is not null"))
    names = files.where("doc_no is not null").select("file", "doc_no", "id")
    return names.join(counts, ["file", "doc_no"]).select(F.col("id").alias("doc_id"), "n_tokens", "closed")
