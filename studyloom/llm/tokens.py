"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.plans.lineage import spread

#: A byte-level BPE vocabulary for many languages as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is cut before the merges: letters, numbers, other signs, each with one blank before, then white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the kind of vocabulary file; loaded once in each worker."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens of every row whose text isn't null; empty text has 0. Texts are counted whole."""
    rows = docs.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counter(vocabulary)
        for batch in batches:
            n = pa.array(sizes(batch.column(batch.num_columns - 1).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return spread(rows).mapInArrow(count, f"{fields}, n_tokens int")
