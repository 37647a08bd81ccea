"""Token counts by a separator scan over flat token files.

A flat token file is a sequence of fixed-width token ids with an end-of-document id behind each document, and no index. It is
read in blocks. Each block is searched for separators with vector operations and gives its inner documents' lengths, the
tokens before its first separator and those behind its last. What a block's first document has in the blocks before it, and how
many documents those end, is an exclusive scan over the blocks' summaries: within groups of blocks first, then
over the groups, so that no task sees more than a group.

Flat files are kept as tables of blocks (file, block, data), which Spark reads and writes in any store; raw files become such a
table by raw_blocks().
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, text_of, written

#: The pre-tokenizer's pattern of the public byte-level BPE vocabulary with 50,257 ids (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class TokenFileParams:
    """vocabulary: a file of base64 tokens and ranks. eod: id behind each document. block: tokens of a block. group: blocks
    that are scanned together."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    eod: int = 50256
    block: int = 1 << 16
    group: int = 256
    dtype: str = "<u2"


    def __post_init__(self) -> None:
        kind = np.dtype(self.dtype)
        if kind.kind != "u" or not 0 <= self.eod <= np.iinfo(kind).max or self.block < 1 or self.group < 1:
            raise ValueError("tokens are unsigned, eod is one of them, block and group are positive")


_encoders: dict[int, object] = {}


def vocabulary_of(p: TokenFileParams) -> bytes:
    """The vocabulary file, read by the driver; its ids must fit into p.dtype, and leave eod free."""
    with open(p.vocabulary, "rb") as f:
        content = f.read()
    ids = [int(line.split()[1]) for line in content.splitlines()]
    if max(ids) > np.iinfo(np.dtype(p.dtype)).max or p.eod in ids:
        raise ValueError(f"the ids of {p.vocabulary} do not fit into {p.dtype}, or {p.eod} is one of them")
    return content


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, made once in each process."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def write_flat(docs: DataFrame, p: TokenFileParams = TokenFileParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, data, ids): docs as flat token files, one for each partition, written to the shared folder.

    ids are the doc_ids of the documents that end in a block: kept beside the tokens to name the counts, not used by the scan.
    A document without text is a separator alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(p))
    dtype, block, eod = np.dtype(p.dtype), p.block, p.eod

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary.value).encode_to_numpy
        end = np.array([eod], dtype)
        file, number, parts, held, ids = None, 0, [], 0, []
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                file = file if file is not None else int(b["file"].iat[0])
                tokens = encode(t, disallowed_special=()).astype(dtype) if t else end[:0]
                parts += [tokens, end]
                held += len(tokens) + 1
                if held > block:  # a block is given out once something follows it, so that its ids are complete
                    flat, at = np.concatenate(parts), 0
                    while held > block:
                        rows.append((file, number, flat[at : at + block].tobytes(), ids))
                        at, held, number, ids = at + block, held - block, number + 1, []
                    parts = [flat[at:]]
                ids.append(d)
            yield pd.DataFrame(rows, columns=["file", "block", "data", "ids"])
        if held:
            yield pd.DataFrame([(file, number, np.concatenate(parts).tobytes(), ids)], columns=["file", "block", "data", "ids"])

    rows = docs.select(F.spark_partition_id().alias("file"), F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return written(rows.mapInPandas(of, "file int, block int, data binary, ids array<string>"), "tokens")


def raw_blocks(spark: SparkSession, path: str, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """(file, block, data) of raw flat token files, whose names are the file column; an odd last byte is an error."""
    bounded_batches(spark)
    size, block = np.dtype(p.dtype).itemsize, p.block

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                if len(content) % size:
                    raise ValueError(f"{name} does not hold whole tokens")
                step = block * size
                for at in range(0, len(content), step):
                    yield pd.DataFrame({"file": [name], "block": [at // step], "data": [content[at : at + step]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "file string, block int, data binary")


def _scan(blocks: DataFrame, p: TokenFileParams) -> DataFrame:
    """Of each block: tokens, separators, tokens before the first and behind the last one, lengths of the documents between."""
    kind = blocks.schema["file"].dataType.simpleString()
    dtype, eod = np.dtype(p.dtype), p.eod

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, block, data in zip(b["file"], b["block"], b["data"], strict=True):
                tokens = np.frombuffer(data, dtype)
                at = np.flatnonzero(tokens == eod)
                n = len(tokens)
                rows.append((file, block, n, len(at), int(at[0]) if len(at) else n, int(n - 1 - at[-1]) if len(at) else n, np.diff(at) - 1))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "ends", "head", "tail", "inner"])

    return blocks.select("file", "block", "data").mapInPandas(of, f"file {kind}, block int, n long, ends long, head long, tail long, inner array<long>")


def _open_before(ends: str, tail: str, order) -> Column:
    """Tokens behind the last separator in the rows before: their tails since the last row that has a separator. A row without
    one has all its tokens as its tail."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_before = F.coalesce(F.sum(tail).over(before), F.lit(0))
    return all_before - F.coalesce(F.last(F.when(F.col(ends) > 0, F.col("_upto")), ignorenulls=True).over(before), F.lit(0))


def count_tokens(blocks: DataFrame, p: TokenFileParams = TokenFileParams()) -> DataFrame:
    """(file, ordinal, n_tokens, terminated): each document of flat token files, in order from 0; separators do not count.

    Tokens behind a file's last separator are a document that is not terminated. Empty files have no documents; a separator at
    once behind another ends a document of 0 tokens.
    """
    bounded_batches(blocks.sparkSession)
    found = _scan(blocks, p).withColumn("_group", F.floor(F.col("block") / F.lit(p.group)))
    summary = written(found, "scan")  # a few numbers for each block and one for each document
    inside = Window.partitionBy("file", "_group").orderBy("block")
    upto = F.sum("tail").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    local = summary.withColumn("_upto", F.coalesce(upto, F.lit(0)))  # tails of the group's blocks before this one
    local = local.withColumn("_open", _open_before("ends", "tail", inside))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("_ended", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    whole = local.groupBy("file", "_group").agg(F.sum("ends").alias("_ends"), F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("_open") + F.col("tail")), "block").alias("_tail"))
    across = Window.partitionBy("file").orderBy("_group")  # a row for each group of blocks
    whole = whole.withColumn("_upto", F.coalesce(F.sum("_tail").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = whole.withColumn("_gopen", _open_before("_ends", "_tail", across)).withColumn("_gended", F.coalesce(F.sum("_ends").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = whole.select("file", "_group", "_gopen", "_gended", (F.lead("_group").over(across).isNull()).alias("_last"))
    joined = local.join(last, ["file", "_group"])
    open_now = F.col("_open") + F.when(F.col("_ended") == 0, F.col("_gopen")).otherwise(0)
    first = F.when(F.col("ends") > 0, F.array(open_now + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    at = (F.col("_gended") + F.col("_ended")).alias("_first")
    done = joined.select("file", at, F.posexplode(F.concat(first, F.col("inner"))).alias("_i", "n_tokens"))
    done = done.select("file", (F.col("_first") + F.col("_i")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    end = joined.where("_last").groupBy("file").agg(F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(open_now + F.col("tail")), "block").alias("n_tokens"), F.max(F.col("_gended") + F.col("_ended") + F.col("ends")).alias("ordinal"))
    return done.union(end.where("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False)))


def document_token_counts(docs: DataFrame, p: TokenFileParams = TokenFileParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), one row for each row of docs, counted from the flat token files that hold them.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows stay repeated. Other columns are ignored. An empty
    table gives an empty one.
    """
    blocks = write_flat(docs, p, id_col, text_col)
    counted = count_tokens(blocks, p)
    order = Window.partitionBy("file", "_group").orderBy("block")
    sizes = blocks.select("file", "block", "ids", F.floor(F.col("block") / F.lit(p.group)).alias("_group"), F.size("ids").cast("long").alias("_n"))
    whole = sizes.groupBy("file", "_group").agg(F.sum("_n").alias("_n"))
    whole = whole.select("file", "_group", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    named = sizes.withColumn("_own", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(whole, ["file", "_group"])
    named = named.select("file", (F.col("_before") + F.col("_own")).alias("_first"), F.posexplode("ids").alias("_i", "_id"))
    named = named.select("file", (F.col("_first") + F.col("_i")).alias("ordinal"), F.col("_id").cast("long").alias("doc_id"))
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
