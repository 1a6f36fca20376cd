"""Token counts of a public byte-pair tokenizer, Arrow batch by Arrow batch."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A ranks file (lines "base64 rank"), readable at the same path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that cuts text before merging; it belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a ranks file, loaded once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, loss): tokens of each whole text, and those that bear loss: all after the first line, the title.

    A text of one line bears loss throughout. Null and empty texts have no tokens. Cutting before the white space that
    ends the first line cuts between pieces of the pattern, so the parts' counts add up to the whole's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(tokenizer).encode_ordinary
        for b in batches:
            tokens, loss = [], []
            for text in b.column(2).to_pylist():
                if not text:
                    tokens.append(0)
                    loss.append(0)
                    continue
                lead, _, rest = text.lstrip().partition("\n")
                if not rest.strip():
                    n = len(code(text))
                    tokens.append(n)
                    loss.append(n)
                    continue
                at = len(text) - len(text.lstrip()) + len(lead.rstrip())
                n = len(code(text[at:]))
                tokens.append(n + len(code(text[:at])))
                loss.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], names=["doc_id", "source", "tokens", "loss"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, source string, tokens bigint, loss bigint")
