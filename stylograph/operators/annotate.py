"""Annotation of texts into sentences and tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylograph import schema
from stylograph.functions.text import clean_text
from stylograph.operators.lexicon import word_tags

SENTENCE = r"[^.!?…]*[.!?…]+|[^.!?…]+$"
TOKEN = r"(?U)[\p{L}\p{M}]+|\p{N}+|\S"


def tag_of(form, low):
    """Part of speech by rule: punctuation, symbol, number, else the function-word lexicon, else X."""
    tags: dict[str, list[str]] = {}
    for w, t in word_tags().items():
        tags.setdefault(t, []).append(w)
    out = F.when(form.rlike(r"^\p{P}+$"), "PUNCT").when(form.rlike(r"^\p{S}+$"), "SYM").when(form.rlike(r"^\p{N}+$"), "NUM")
    for t, words in sorted(tags.items()):
        out = out.when(low.isin(words), t)
    return out.otherwise("X")


def annotate_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token table made by rules, without a shuffle: a sentence ends after a run of . ! ? and …, lemma is the lower-case form.

    Null, empty and blank texts give no row. An approximation that stands in for a trained annotator.
    """
    cleaned = df.select(F.col(doc_id).alias("doc_id"), clean_text(text).alias("__t"))
    sents = cleaned.select("doc_id", F.posexplode(F.filter(F.regexp_extract_all("__t", F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s) != "")).alias("sent_id", "__s"))
    toks = sents.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("__s", F.lit(TOKEN), F.lit(0))).alias("tok_id", "form"))
    toks = toks.withColumn("lemma", F.lower("form"))
    return toks.select("doc_id", "sent_id", "tok_id", "form", "lemma", tag_of(F.col("form"), F.col("lemma")).alias("upos"), F.lit("").alias("xpos"), F.lit("").alias("feats"))


def annotate_udpipe(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token table made by UDPipe, where the package and a model are installed; the model is loaded once a Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        if not os.path.exists(model_path):
            raise FileNotFoundError(f"no UDPipe model at {model_path}; pass the path of a downloaded one")
        from ufal.udpipe import Model, Pipeline

        model = Model.load(model_path)
        if model is None:
            raise RuntimeError(f"the UDPipe model at {model_path} cannot be loaded")
        pipe = Pipeline(model, "tokenize", Pipeline.DEFAULT, Pipeline.DEFAULT, "conllu")
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "conllu": [pipe.process(t) for t in pdf["t"]]})

    from stylograph.sources.tables import read_conllu

    raw = df.select(F.col(doc_id).cast("string").alias("doc_id"), clean_text(text).alias("t"))
    return read_conllu(raw.mapInPandas(run, "doc_id string, conllu string"))


def as_documents(tokens: DataFrame) -> DataFrame:
    """doc_id and sentences, an array of arrays of token structs in text order; the nested view of the token table."""
    fields = [f.name for f in schema.TOKENS if f.name not in ("doc_id", "sent_id", "tok_id")]
    sents = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", *fields))).alias("s"))
    docs = sents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "s"))).alias("d"))
    return docs.select("doc_id", F.transform("d", lambda x: F.transform(x["s"], lambda t: F.struct(*[t[f].alias(f) for f in fields]))).alias("sentences"))


def pos_bigrams(tokens: DataFrame) -> DataFrame:
    """Each pair of neighbouring tags of a sentence as ``gram``, joined by an underscore."""
    nxt = F.lead("upos").over(Window.partitionBy("doc_id", "sent_id").orderBy("tok_id"))
    return tokens.withColumn("__n", nxt).where(F.col("__n").isNotNull()).select("doc_id", F.concat_ws("_", "upos", "__n").alias("gram"))
