"""Readers of the corpus tables and of CoNLL-U annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograph import schema
from stylograph.session import spread

LFS = "version https://git-lfs"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows take much work, over all cores."""
    return spread(read_table(spark, folder, name))


def read_csv(spark: SparkSession, path: str, columns: T.StructType = schema.SUBSET) -> DataFrame:
    """A CSV delivery under an explicit schema: header, quotes doubled, line breaks inside quotes, NA and nothing as null.

    A file that is only the pointer of a large-file store is refused.
    """
    head = spark.read.text(path).limit(1).collect()
    if head and (head[0][0] or "").startswith(LFS):
        raise ValueError(f"{path} is a pointer to a file that was not fetched")
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in columns])
    raw = spark.read.csv(path, schema=strings, header=True, multiLine=True, quote='"', escape='"', nullValue="NA", maxCharsPerColumn=-1)
    casts = [F.expr(f"try_to_date(`{f.name}`, 'yyyy-MM-dd')").alias(f.name) if isinstance(f.dataType, T.DateType) else F.expr(f"try_cast(nullif(`{f.name}`, '') AS {f.dataType.simpleString()})").alias(f.name) for f in columns]
    return raw.select(*casts)


def read_conllu(texts: DataFrame, doc_id: str = "doc_id", text: str = "conllu") -> DataFrame:
    """The token table of CoNLL-U texts.

    A blank line ends a sentence. Comments, rows of fewer than six fields, and ids with '-' or '.' give no token. Null and
    empty texts give no row. sent_id counts the sentences that have a token, tok_id the tokens of a sentence, from 0.
    """
    lines = texts.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))
    by_line = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.trim("line") == ""
    parts = F.split("line", "\t")
    tokens = (
        lines.withColumn("block", F.sum(blank.cast("int")).over(by_line))
        .where(~blank & ~F.col("line").startswith("#"))
        .withColumn("f", parts)
        .where((F.size("f") >= 6) & ~F.col("f")[0].rlike("[-.]"))
    )
    by_block = Window.partitionBy("doc_id").orderBy("block")
    in_sentence = Window.partitionBy("doc_id", "block").orderBy("pos")
    return tokens.select(
        F.col("doc_id"),
        (F.dense_rank().over(by_block) - 1).alias("sent_id"),
        (F.row_number().over(in_sentence) - 1).alias("tok_id"),
        F.col("f")[1].alias("form"),
        F.col("f")[2].alias("lemma"),
        F.col("f")[3].alias("upos"),
        F.col("f")[4].alias("xpos"),
        F.col("f")[5].alias("feats"),
    )
