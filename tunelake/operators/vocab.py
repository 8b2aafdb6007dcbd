"""Vocabulary and token ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tunelake.operators.segmented import global_position
from tunelake.session import cut_lineage

# Reserved ids of the built vocabulary.
PAD_TOKEN, PAD_ID = "<pad>", 0
UNK_TOKEN, UNK_ID = "<unk>", 1
N_SPECIAL = 2

BLOCK_ROWS = 1024


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all tokens); a null list has none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return lengths, column.flatten()


def _counted(batches):
    """Each slice's distinct tokens with their counts."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            _, tokens = _lists(b.column(0).slice(at, BLOCK_ROWS))
            counts = pc.value_counts(tokens.drop_null())
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["token", "n"])


def vocab_table(df: DataFrame, tokens: Column | str, size: int | None = None) -> DataFrame:
    """(token, count, id): tokens by falling count, ties by token; every token unless ``size`` limits them.

    Tasks count the tokens of a slice of rows before the shuffle, so a very
    frequent token costs one row per slice.  Ids are global positions: a range
    shuffle of the distinct tokens, no single-task sort.
    """
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return _numbered(df.select(t.alias("t")).mapInArrow(_counted, "token string, n long"), size)


def _numbered(parts: DataFrame, size: int | None) -> DataFrame:
    """Vocabulary of partial counts (token, n)."""
    counts = parts.groupBy("token").agg(F.sum("n").cast("bigint").alias("count"))
    placed = global_position(counts, [F.desc("count"), F.asc("token")], "_place")
    if size is not None:
        placed = placed.where(F.col("_place") < size)
    return placed.select("token", "count", (F.col("_place") + N_SPECIAL).cast("bigint").alias("id"))


def _to_blocks(n_sides: int, schema: pa.Schema):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                sides = [_lists(part.column(1 + s)) for s in range(n_sides)]
                words = pa.concat_arrays([tokens for _, tokens in sides]).dictionary_encode()
                index, lists, start = words.indices.cast(pa.int32()), [], 0
                for lengths, tokens in sides:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                    lists.append(pa.ListArray.from_arrays(offsets, index.slice(start, len(tokens))))
                    start += len(tokens)
                known = index.drop_null().to_numpy()
                counts = np.bincount(known, minlength=len(words.dictionary))
                rest = [None] * (part.num_rows - 1)
                of_block = pa.array([words.dictionary.to_pylist()] + rest, pa.list_(pa.string()))
                counted = pa.array([counts] + rest, pa.list_(pa.int64()))
                block = pa.array(np.full(part.num_rows, (task << 32) + made, np.int64))
                made += 1
                yield pa.RecordBatch.from_arrays([block, part.column(0), of_block, counted, *lists], schema=schema)
    return run


def encode_columns(df: DataFrame, id_col: str, token_arrays: dict[str, Column], vocab: DataFrame | None = None,
                   size: int | None = None) -> DataFrame:
    """Map each token array to ids (unknown -> ``UNK_ID``), keeping order; one row out for each row in.

    Without ``vocab`` the vocabulary is that of these arrays (``size`` limits it as in
    ``vocab_table``), counted from the blocks, so the texts are read and cut once.

    Rows are cut into blocks, whose tokens become positions in the block's list
    of distinct words; that table is written once.  The words of the blocks meet the
    vocabulary in a join, one row for each word and block however often it
    occurs, and a row's ids are looked up in the list of its block.  Rows are never
    taken apart, so repeated ids and retried tasks can't mix them.
    """
    names = list(token_arrays)
    schema = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_id", df.schema[id_col].dataType),
                           T.StructField("_words", T.ArrayType(T.StringType())), T.StructField("_counts", T.ArrayType(T.LongType()))]
                          + [T.StructField(f"_{s}", T.ArrayType(T.IntegerType())) for s in names])
    rows = df.select(F.col(id_col), *[arr.alias(f"_t{i}") for i, arr in enumerate(token_arrays.values())])
    blocks = cut_lineage(rows.mapInArrow(_to_blocks(len(names), to_arrow_schema(schema)), schema))
    lists = blocks.where(F.col("_words").isNotNull())
    words = lists.select("_block", F.posexplode("_words").alias("pos", "token"))
    if vocab is None:
        vocab = _numbered(lists.select(F.explode(F.arrays_zip(F.col("_words").alias("token"), F.col("_counts").alias("n")))
                                       .alias("w")).select("w.token", "w.n"), size)
    lookup = vocab.select("token", F.col("id").alias("_token_id"))
    ids = words.join(lookup, on="token", how="left").groupBy(F.col("_block").alias("_of_block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_token_id", F.lit(UNK_ID)).cast("bigint").alias("id")))).alias("_ids"))
    joined = blocks.drop("_words", "_counts").join(ids, F.col("_block") == F.col("_of_block"), "left")
    return joined.select(F.col("_id").alias(id_col), *[
        F.transform(f"_{s}", lambda i: F.get(F.col("_ids.id"), i)).alias(f"{s}_ids") for s in names])
