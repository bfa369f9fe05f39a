"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the vocabulary files lie unless a path is given.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer of the byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """A function from text to its number of tokens, loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda text: len(whole.encode(text, add_special_tokens=False).ids)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def n_tokens(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for a null or empty one. Strings of special tokens count as ordinary text."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        size = encoder(path)
        return pd.Series([size(t) if t else 0 for t in texts], dtype="int64")

    # Marked so, it runs once a row: a filter on it isn't pushed below the projection that computes it.
    return count.asNondeterministic()(text)
