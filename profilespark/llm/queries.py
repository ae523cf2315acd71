"""The registered queries of this subpackage, with production parameters over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_clusters, cluster_sql
from .common import documents
from .context_mixing import mixing_scores
from .knn import TOP_K_SQL, top_k
from .licenses import license_scan
from .line_dedup import line_matches
from .packing import pack
from .pairwise_ranking import quality_scores
from .passages import repeated_passages
from .pieces import piece_digest
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .url_filter import shown_documents, url_verdicts, verdict_sql
from .whitening import whitened

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@register("op4_voronoi_top_k", TOP_K_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(documents(spark, sf, "embeddings"))


@register("op5_simhash_golay")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(documents(spark, sf))


@register("op9_quality_rules")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(documents(spark, sf), documents(spark, sf, "labels"))


@register("op6_license_patience")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan(documents(spark, sf))


@register("op7_sentencepiece_viterbi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return piece_digest(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@register("op8_line_edit_join")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return line_matches(documents(spark, sf)).drop("text_hash")


@register("op1_best_fit_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@register("op2_url_templates", verdict_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = documents(spark, sf, "pages")
    return url_verdicts(pages, shown_documents(pages, documents(spark, sf, "labels")))


@register("op3_repeated_passages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(documents(spark, sf))


@register("op10_pairwise_quality")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(documents(spark, sf), documents(spark, sf, "labels"))


@register("op11_context_mixing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mixing_scores(documents(spark, sf))


@register("op12_ns_centroids", cluster_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_clusters(documents(spark, sf, "embeddings"))


@register("op13_whitening")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(documents(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
