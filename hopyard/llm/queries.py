"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopyard.llm import addresses, body, discovery, increments, linkage, mixing, residue, spans, tokenizer
from hopyard.session import materialize, table


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


AS_OF = "2026-08-05T00:00:00Z"
#: One more than makes a compacted run, so that the last batch meets one.
BATCHES = spans.FANOUT + 1


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = (
        table(spark, folder, "valid_base_config").select(F.col("config_no").alias("id"), "address")
        .unionByName(table(spark, folder, "overture_fixture").select(F.col("place_no").alias("id"), "address"))
        .unionByName(table(spark, folder, "candidate").select(F.col("cand_id").alias("id"), "address"))
        .unionByName(table(spark, folder, "observation").where("venue_id = 'unassigned'").select(F.col("obs_id").alias("id"), F.col("matched_address").alias("address")))
    )
    return addresses.expand(*addresses.same_location(records))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    poi = table(spark, folder, "overture_fixture").select(F.col("place_no").alias("id"), "name", "address", "phone")
    seen = table(spark, folder, "observation").select(F.col("obs_id").alias("id"), F.col("matched_name").alias("name"), F.col("matched_address").alias("address"), F.col("matched_phone").alias("phone"))
    return linkage.link(poi, seen).select(F.col("left_id").alias("place_no"), F.col("right_id").alias("obs_id"), "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_links(spark, folder).select("place_no", "obs_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.surviving(table(spark, folder, "claim"), AS_OF)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    history = increments.History(spark)
    gone = table(spark, folder, "removed_venues")
    # Below zero, as a removed venue comes before every candidate.
    name = F.coalesce(F.nullif(F.trim("norm_name"), F.lit("")), F.col("name"))
    history.seed(gone.select((-F.col("tomb_no")).alias("id"), (-F.col("tomb_no")).alias("root"), name.alias("name"), F.col("norm_address").alias("address")))
    rows = table(spark, folder, "candidate").select(F.col("cand_id").alias("id"), F.col("cand_id").alias("root"), "name", "address", "batch_no")
    keys = materialize(increments.keyed(rows).join(rows.select("id", "batch_no"), "id"), "keys")
    # The number of batches, not of rows.
    batches = sorted(r[0] for r in rows.select("batch_no").distinct().collect() if r[0] is not None)
    found = None
    for n in batches:
        roots = history.add_keyed(keys.where(F.col("batch_no") == n).drop("batch_no"))
        found = roots if found is None else found.unionByName(roots)
    return found.where("root <> id").select(F.abs("root").alias("first_id"), F.col("id").alias("cand_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return body.main_lines(table(spark, folder, "fetch_result"), "page_id", "html")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(table(spark, folder, "fetch_result"), "page_id", "url", "html")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"), "doc_id", "text", _ranks())


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    sizes = tokenizer.count_tokens(docs, "doc_id", "text", _ranks())
    # Counted once; what follows reads the counts several times.
    rows = materialize(docs.select("doc_id", mixing.plain_label(F.col("source")).alias("source")).join(sizes, "doc_id"), "sizes")
    targets = table(spark, folder, "mix_target").withColumn("source", mixing.plain_label(F.col("source")))
    return mixing.mix(rows.select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size")), targets)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def _spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    found, members = spans.shared_spans(docs, "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int"), BATCHES)
    return docs, found, members


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    _, found, members = _spans(spark, folder)
    return spans.shared_pairs(found, members)


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    docs, found, members = _spans(spark, folder)
    return spans.shared_extent(docs, "doc_id", "text", found, members)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_links, p4_found, p5_found, p6_found, p8_ids, p9_mix, p9_shares, p10_found, p10_shared)}


def oracle_sql() -> dict[str, str]:
    return {}
