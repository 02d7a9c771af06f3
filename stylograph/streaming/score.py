"""Attribution of texts that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.functions.text import squish
from stylograph.operators.lexicon import function_words
from stylograph.operators.profiles import MAX_PROFILE_BYTES


def function_word_vector(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``features``: the share of each function word among the tokens of the text. Row by row, so it runs on a stream."""
    words = function_words()
    toks = F.regexp_extract_all(F.lower(squish(F.coalesce(F.col(text), F.lit("")))), F.lit(r"(?U)[\p{L}\p{M}]+|\p{N}+|\S"), F.lit(0))
    out = df.withColumn("__k", toks)
    n = F.greatest(F.size("__k"), F.lit(1))
    counts = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.size(F.filter("__k", lambda t: t == w)) / n)
    return out.withColumn("features", counts).drop("__k")


def nearest_author(stream: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds predicted and score: Burrows' Delta of each row's ``features`` to the profiles (author, mean, std arrays), which are few.

    Stateless: the profiles are joined as one row that holds them all, after a check that they take no more than MAX_PROFILE_BYTES; of
    more ValueError is raised. For those score each batch of the stream by ``delta.delta_scores`` in foreachBatch, which goes by blocks.
    """
    size = profiles.agg(F.sum(8 * (F.size("mean") + F.size("std")))).first()[0] or 0
    if size > MAX_PROFILE_BYTES:
        raise ValueError(f"{size} bytes of profiles are more than are broadcast ({MAX_PROFILE_BYTES}); use delta.delta_scores in foreachBatch")
    one = profiles.groupBy().agg(F.collect_list(F.struct("author", "mean", "std")).alias("p"))  # one entry an author
    guard = lambda s: F.when(s > 0, s).otherwise(1.0)
    def distance(p):
        both = F.zip_with("features", p["mean"], lambda x, m: F.abs(x - m))
        return F.aggregate(F.zip_with(both, p["std"], lambda d, s: d / guard(s)), F.lit(0.0), lambda a, b: a + b) / F.size("features")
    scored = F.array_min(F.transform("p", lambda p: F.struct(F.round(distance(p), 9).alias("score"), p["author"].alias("author"))))
    return stream.crossJoin(F.broadcast(one)).withColumn("b", scored).select(*stream.columns, F.col("b.author").alias("predicted"), F.col("b.score").alias("score"))
