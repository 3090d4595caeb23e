"""Embedding texts by a model given by the caller, as an Arrow job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 64


def embedding_text(title: Column, abstract: Column, separator: str = " [SEP] ") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(separator), F.coalesce(abstract, F.lit("")))


#: Tokens of a text that a model of this kind reads, its two marks left out.
MOST_TOKENS = 510


def token_cut(tokenizer_file: str, most: int = MOST_TOKENS) -> Callable[[list[str]], list[str]]:
    """A function that cuts texts after their first ``most`` tokens, by a file of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)

    def cut(texts: list[str]) -> list[str]:
        found = tokenizer.encode_batch(texts, add_special_tokens=False)
        return [t[: e.offsets[most - 1][1]] if len(e.ids) > most else t for t, e in zip(texts, found, strict=True)]

    return cut


def embed(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", id: str = "id", batch: int = BATCH, cut: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """(id, embedding): ``load`` is called once a task and returns a function from texts to a matrix; so is ``cut``, for the texts it gets.

    Texts of like length stand together, so that batches are padded little; a null text is ''.
    """
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        model, short = load(), cut() if cut else list
        for b in batches:
            texts = b.column(1).to_pylist()
            for low in range(0, len(texts), batch):
                x = np.asarray(model(short(texts[low : low + batch])), np.float32)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, len(x)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "embedding"])

    own = df.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).sortWithinPartitions(F.length("text"))
    return own.mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id)
