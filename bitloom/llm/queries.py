"""The registered queries of the text operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import decontaminate, embeddings, html_text, infill, langid, licenses, neardup, packing, pii, quality, search, secrets, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the place."""
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base test and verdict of every document."""
    return quality.score(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, sources in their overall proportions."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(_read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their two-word shingles."""
    return neardup.groups(_read(spark, sf_dir, "documents"), words=2, percent=80)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses in every document."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels of the rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and put together again."""
    return infill.digests(_read(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more: links and groups."""
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.98)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_html_text": op5_html_text,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_licenses": op7_licenses,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_duplicates": op12_embedding_duplicates,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op7_licenses": licenses.oracle(),
    "op11_fill_in_middle": infill.oracle(),
    "op12_embedding_duplicates": embeddings.oracle(),
    "op13_ranked_search": search.oracle(),
}
