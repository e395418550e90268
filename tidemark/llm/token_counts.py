"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven offline, by the library itself, when
the tokenizer file is loaded. Pre-tokens among them count one; only the others are merged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import word_bpe
from .common import id_text, lean, outer_id, raw_bytes, slices


@lru_cache(2)
def _counter(path: str):
    """texts -> token counts, as the library of the file's format gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return word_bpe.load(path).counts


def _counts(path: str, limit: int):
    def run(batches):
        count = _counter(path)
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 4 << 20):
                n = np.array(count([flat[at[r] : at[r + 1]].tobytes().decode() for r in range(i, j)]), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(np.diff(at[i : j + 1])), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    No special tokens are added; special strings inside a text are handled as the library does by
    default. Null texts count as empty; null and repeated ids are kept; other columns are not read.
    """
    found = id_text(documents, id_col, text_col).mapInArrow(lean(_counts(tokenizer, limit)), "id long, n_bytes long, n_tokens long, over_limit boolean")
    return found.select(outer_id().alias(id_col), "n_bytes", "n_tokens", "over_limit")
