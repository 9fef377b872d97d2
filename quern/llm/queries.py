"""Queries of the training-data problems (p3, p8, p9, p10) on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.runtime import materialize
from ..registry import query
from ..sources.tables import load
from . import linkage, mixing, packing, spam, tokens

# ---------------------------------------------------------------- p3


def payment_records(spark: SparkSession, sf: str) -> DataFrame:
    r = linkage.records(load(spark, sf, "core_banking"), 0, "transaction_id", "amount", "currency", "value_date", "narrative")
    r = r.unionByName(linkage.records(load(spark, sf, "aggregator"), 1, "agg_id", "transaction_amount", "currency", "transaction_date", "memo"))
    r = r.unionByName(linkage.records(load(spark, sf, "manual_entries"), 2, "entry_id", "debit_credit_amount", "currency", "entry_date", "notes", typed=True))
    return r.unionByName(linkage.records(load(spark, sf, "reporting_system"), 3, "txn_ref", "net_amount", "currency", "posting_date", "description"))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.links(payment_records(spark, sf)).select("key_a", "key_b")


@query("p3_links")
def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with the confidence of each."""
    return linkage.links(payment_records(spark, sf))


# ---------------------------------------------------------------- p8


@query("p8_packed")
def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text's containers of each size, with the tokens in them."""
    return packing.pack(tokens.token_sizes(load(spark, sf, "documents"), ["doc_id"]), load(spark, sf, "pack_sizes"))


@query("p8_fills")
def p8_fills(spark: SparkSession, sf: str) -> DataFrame:
    packs = load(spark, sf, "pack_sizes")
    return packing.fills(packing.pack(tokens.token_sizes(load(spark, sf, "documents"), ["doc_id"]), packs), packs)


# ---------------------------------------------------------------- p9


@query("p9_choice")
def p9_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn, each as often as it is used."""
    sizes = materialize(tokens.token_sizes(load(spark, sf, "documents"), ["doc_id", "source"]), "sizes")
    return mixing.mix(sizes, load(spark, sf, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(tokens.token_sizes(load(spark, sf, "documents"), ["doc_id", "source"]), load(spark, sf, "mix_targets"))


# ---------------------------------------------------------------- p10


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.judged_pages(load(spark, sf, "documents")).where("is_spam and doc_id is not null").select("doc_id").distinct()
