"""The queries of this folder, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import ann, byte_bpe, embed_dedup, line_rules, manifest, mixing, oracle, pii, quality, simhash, spelling, suffix_dedup, token_counts, toxicity
from glyphmill.llm.common import table


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file, read on the driver; operators broadcast it to the workers."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, log_ratio, gumbel_key, selected of every document."""
    return quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.training_rows(scored)).alias("held_out"), "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").decode())


#: The tree of the mix. Weights are relative among siblings; a name that isn't listed weighs 1.
WEIGHTS = {
    "domain": {"crawl": 30.0, "reference": 45.0, "forum": 20.0, "other": 5.0},
    "lang": {"en": 60.0, "de": 15.0, "fr": 15.0, "es": 10.0},
    "source": {},
}
BUDGET, EPOCHS, SEED = 0.8, 2, 11


def domain() -> Column:
    """Domain of a source: src0 is the crawl, src1 to src9 are references, other numbers forums."""
    number = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int)")
    return F.when(number == 0, "crawl").when(number < 10, "reference").when(number >= 10, "forum").otherwise("other")


def mix_options() -> dict:
    return {"domain": domain(), "weights": WEIGHTS, "budget": BUDGET, "max_epochs": EPOCHS, "seed": SEED}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, times of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), **mix_options())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20, factor=ANN_FACTOR)


#: How far the triangle inequality is relaxed; measured recall is in the README.
ANN_FACTOR = 1.2


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify_documents(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_spelling": op11_spelling,
    "op12_manifest": op12_manifest,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": oracle.REPEATS,
    "op4_embedding_near_dedup": oracle.LINKED_VECTORS,
    "op8_mixing": oracle.mix_sql(WEIGHTS, BUDGET, EPOCHS, SEED),
    "op11_spelling": oracle.VARIANTS,
    "op12_manifest": oracle.manifest_sql(),
    "op13_quality_rules": oracle.line_rules_sql(),
}
