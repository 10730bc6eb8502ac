"""Registered queries of the operators, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontam, licenses, lm, merkle, near_dup, packing, pii, ppm, quality, repeats, token_counts, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op3_cut_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_read(spark, sf_dir, "documents"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(_read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])], F.sha2(pii.written_spans(F.col("base")), 256).alias("base_sha256"), pii.written_spans(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.model_scores(_read(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents")).drop("source")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(_read(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.languages(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(_read(spark, sf_dir, "documents"), tampered=F.when(even, F.translate("text", "\n", "")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_cut_repeats, op4_decontaminate, op5_near_duplicates, op6_sanitise, op7_token_counts, op8_warc_round_trip, op9_lm_scores, op10_pack, op11_alignment, op12_language_id, op13_merkle_manifest)}
# crc32, bit by bit: a character's code is mixed in, then eight steps
_SQL_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""


def _sql_leaf(text: str) -> str:
    value = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_siblings(nodes: str, tree: str) -> str:
    run = f"(partition by {tree}lvl, idx // 3 order by idx rows between"
    return f"select *, coalesce(string_agg(h, '') over {run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over {run} 1 following and unbounded following), '') as r from {nodes} where n > 1"


ORACLES: dict[str, str] = {
    "op13_merkle_manifest": f"""with recursive leaves as (select doc_id, coalesce('=' || source, '-') as tree, {_sql_leaf("text")} as leaf, case when {_SQL_CRC} % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf("text")} end as seen,
row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n from documents),
nodes as (select tree, 0 as lvl, idx, n, leaf as h from leaves union all select tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from nodes where n > 1 group by tree, lvl, n, idx // 3),
subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops as (select 0 as lvl, idx, n, subroot as h from subs union all select lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from tops where n > 1 group by lvl, n, idx // 3),
s as ({_sql_siblings("nodes", "tree, ")}), t as ({_sql_siblings("tops", "")}),
up as (select doc_id, tree, idx, 0 as lvl, n, seen as h, '' as proof from leaves union all select u.doc_id, u.tree, u.idx // 3, u.lvl + 1, (u.n + 2) // 3, sha256(s.l || u.h || s.r), u.proof || s.l || s.r from up u join s on u.tree = s.tree and u.lvl = s.lvl and u.idx = s.idx where u.n > 1),
over as (select doc_id, subs.idx, 0 as lvl, subs.n, up.h, up.proof from up join subs on up.tree = subs.tree where up.n = 1 union all select o.doc_id, o.idx // 3, o.lvl + 1, (o.n + 2) // 3, sha256(t.l || o.h || t.r), o.proof || t.l || t.r from over o join t on o.lvl = t.lvl and o.idx = t.idx where o.n > 1)
select l.doc_id, l.leaf, subs.subroot, tops.h as root, sha256(o.proof) as proof_sha256, o.h as folded_root, o.h = tops.h as verified
from leaves l join subs on l.tree = subs.tree join over o on o.doc_id = l.doc_id and o.n = 1 join tops on tops.n = 1""",
}
