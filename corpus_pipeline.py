"""The corpus pipeline: each stage works on all that the one before it kept. Part of the subpackage tessera.llm.

Stages take any table with doc_id and text, whatever other columns it has and however these are named, and all but the
last return its columns. An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, pii, quality, simhash
from tessera.llm.common import mark, materialize, release


def _kept(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of docs, with the columns of docs; those besides doc_id and text have other names meanwhile, so
    that none is replaced by a column that work adds."""
    names = {c: c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)}
    out = work(docs.withColumnsRenamed(names))
    return out.select(*[F.col(new).alias(c) for c, new in names.items()])


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them. Repeated rows stay or go together."""
    return _kept(docs, lambda d: quality.judged(d).where("kept"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id, and of equal ids or repeated rows one. Null and
    empty texts are one component; a null doc_id is no smallest one where there is another."""
    return simhash.representatives(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of an item go, however long they are, and so do those that are contaminated by
    items shorter than a window. An item of a few words alone, which any long text may hold by chance, removes none.
    Null and empty texts stay; repeated rows stay or go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = f"NOT contaminated AND longest_hit < {decontamination.WINDOW}"
    return _kept(docs, lambda d: decontamination.decontaminated(d, items).where(clean))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold surrogates; n_chars, if there is one, is that of the new text. A null text stays null, an empty one
    empty; repeated rows are changed alike."""
    out = _kept(docs, lambda d: pii.surrogates(d, pii.key_of(spark)))
    return out.withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and where they are packed. A null or empty text is one piece, the closing id; repeated rows are packed each."""
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", _quality),
    ("simhash_near_dedup", _near_duplicates),
    ("decontamination", _decontamination),
    ("pii_surrogates", _pii),
    ("best_fit_packing", _packing),
]

#: The estimate of the first stage iterates, and the fingerprints of the second hash shingles; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        began = mark()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = materialize(out)
        release(began, mark() - 1)  # what the stage wrote on its way
