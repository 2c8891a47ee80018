"""A training corpus from raw documents: filter, de-duplicate, decontaminate, sanitise, pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.llm import decontaminate, jaccard_join, packing, pii, quality
from tablerecon.llm.common import new_folder, stored, table, unused
from tablerecon.llm.sampling import fold


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier gives label 0.

    A null or empty text has no features and goes by the share of label 1 in
    the training rows.  Rows of one text stay or go together, whatever their
    ids; no rows give no rows; columns of any name are kept.
    """
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    model, name = quality.fit(docs, labels, "quality"), unused(docs, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).select(*_names(docs))


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) keep the row with the smallest id.

    What is kept is one row of each group of texts, not of each id: of rows
    that share the smallest id one is taken by a hash of all their columns, so
    different texts under one id stay if they are no near copies.  Null ids
    come last.  A text without words (null, empty, blank) is near no other and
    stays, as often as it occurs; no rows give no rows; columns of any name are
    kept.
    """
    mark, h, picked = (unused(docs, n) for n in ("row_mark", "row_h", "picked"))
    parts = [c for n in docs.columns for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]
    whole = F.struct(*[F.xxhash64(F.lit(k), *parts) for k in (1, 2)])
    marked = docs.withColumn(mark, F.concat_ws(":", *[whole[f"col{k}"].cast("string") for k in (1, 2)]))
    own = marked.select("doc_id", "text", F.col(mark).alias("mark"))
    groups = stored(jaccard_join.near_duplicates(own, width=5, percent=80, carry="mark"), "near-duplicates")
    # Equal rows are counted first, so that a group's choice needs no row twice.
    rows = groups.where("component is not null").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "n")).alias("best"))
    once = best.select(F.col("best.mark").alias(picked), (F.col("best.n") > 1).alias(h))
    alone = groups.where("component is null").select(F.col("mark").alias(picked)).distinct().withColumn(h, F.lit(False))
    found = marked.join(once.unionAll(alone), F.col(mark) == F.col(picked))
    several = found.where(F.col(h)).dropDuplicates([mark])
    return found.where(~F.col(h)).unionAll(several).select(*_names(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    A text without words holds none and stays; rows of one text stay or go
    together; no rows give no rows; columns of any name are kept.
    """
    prefix = unused(docs, "found_")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix=prefix)
    return found.where(F.col(prefix + "n_hit") == 0).select(*_names(docs))


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and take out terms that give it away; ``n_chars`` follows.

    Every row stays; a null text stays null, with null ``n_chars``; rows of one
    text get one text; no rows give no rows; columns of any name are kept.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*_names(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, without padding.

    A null or empty text is its end id alone; each row is packed, repeated ones
    too; no rows give no rows; other columns are not read.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_a_group),
    ("decontamination", drop_contaminated),
    ("personal data", take_out_personal_data),
    ("packing", pack),
]

#: Learned models, an automaton and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
