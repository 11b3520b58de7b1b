"""Encoding of a corpus with a public tokenizer by one global shuffle of distinct words.

Texts are cut into pre-tokens with built-in expressions, each distinct pre-token is encoded
once, its ids are joined back and put together by position. Pre-tokens that hold a large part
of all rows meet a broadcast row instead of a shuffled one (lookup_join), so no partition
depends on how often a word occurs. Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.skew import lookup_join
from siftwell.session import materialise

# Fixed value: the pre-token pattern of the byte-level BPE vocabularies, in Java's syntax. White space is written out
# as Unicode's White_Space, which is what the tokenizers' \s means.
_WS = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def tokenizer_folder() -> str:
    """The folder of the public vocabulary files: SIFTWELL_TOKENIZERS or that of the installed package."""
    if folder := os.environ.get("SIFTWELL_TOKENIZERS"):
        return folder
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load_encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=load_ranks(path), special_tokens={})


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))


def _pretokens_elsewhere(rows: DataFrame) -> DataFrame:
    """(.., words): the pre-tokens of texts with code points that this JVM's Unicode tables don't know yet, cut by the tokenizer library itself."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for batch in batches:
            yield batch.drop(columns="_text").assign(words=[[t[i:j] for _, (i, j) in split(t)] for t in batch["_text"]])

    return rows.mapInPandas(cut, rows.drop("_text").schema.add("words", T.ArrayType(T.StringType())))


def encode_words(words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """(word, ids) for a table of distinct pre-tokens."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = load_encoding(path)._encode_single_piece
        for batch in batches:
            yield pd.DataFrame({word: batch[word], "ids": [one(w.encode("utf-8")) for w in batch[word]]})

    return words.select(word).mapInPandas(encode, T.StructType([T.StructField(word, T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """One row (key, ids) per row of docs: the token ids of its text, without special tokens.

    A null or empty text has the empty list; a blank text has the ids of its white space;
    strings that look like special tokens are ordinary text. Texts are never cut. Repeated
    rows (same key and text) give repeated results; rows of one key with different texts are
    kept apart. Other columns are ignored; an empty table gives an empty result.
    """
    path = os.path.join(folder or tokenizer_folder(), vocabulary)
    base = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    filled = base.filter("_text <> ''")
    unknown = F.rlike("_text", F.lit(r"\p{Cn}"))
    cut = filled.filter(~unknown).select("_key", "_h", pretokens(F.col("_text")).alias("words")).unionByName(_pretokens_elsewhere(filled.filter(unknown)))
    cut = materialise(cut, "pretokens")  # texts are cut once; the count, the hot words and the others read the pieces
    tokens = cut.select("_key", "_h", F.posexplode("words").alias("_pos", "word"))
    words = materialise(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "words")  # both the distinct words and what is hot among them
    ids = encode_words(words, path)
    joined = lookup_join(tokens, ids, ["word"], "inner", counts=words)
    parts = joined.groupBy("_key", "_h").agg(F.array_sort(F.collect_list(F.struct("_pos", "ids"))).alias("p"), (F.max("_pos") + 1).alias("_size"))
    # A row that is there several times has each position as often.
    once = parts.withColumn("_copies", F.size("p") / F.col("_size")).withColumn("p", F.when(F.col("_copies") == 1, F.col("p")).otherwise(F.array_distinct("p")))
    every = once.select("_key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies").cast("bigint"))).alias("_c")).drop("_c")
    empty = base.filter("_text is null or _text = ''").select("_key", F.array().cast("array<int>").alias("ids"))
    return every.unionByName(empty).select(F.col("_key").alias(key), "ids")


def token_bytes(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """The token-byte table (token, bytes); its size is that of the vocabulary file."""
    ranks = load_ranks(os.path.join(folder or tokenizer_folder(), vocabulary))
    return spark.createDataFrame([(v, bytearray(k)) for k, v in ranks.items()], "token int, bytes binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """One row (key, text) per row of encoded; ids outside the vocabulary raise, an empty or null list gives ''.

    The token-byte table is broadcast: it holds as many rows as the vocabulary file, about 50,000 short ones.
    """
    spark = encoded.sparkSession
    rows = encoded.select(F.col(key).alias("_key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids")).withColumn("_row", F.monotonically_increasing_id())
    flat = rows.select("_key", "_row", F.posexplode("_ids").alias("_pos", "token"))
    joined = flat.join(F.broadcast(token_bytes(spark, vocabulary, folder)), "token", "left").withColumn("bytes", F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("unknown token "), F.col("token")))).otherwise(F.col("bytes")))
    pieces = joined.groupBy("_key", "_row").agg(F.array_sort(F.collect_list(F.struct("_pos", F.hex("bytes").alias("x")))).alias("p"))
    text = pieces.select(F.col("_key").alias(key), F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")), "utf-8").alias("text"))
    return text.unionByName(rows.filter(F.size("_ids") == 0).select(F.col("_key").alias(key), F.lit("").alias("text")))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_tokens) of each row of docs; see encode_corpus."""
    return encode_corpus(docs, key, text, **how).select(key, F.size("ids").cast("bigint").alias("n_tokens"))
