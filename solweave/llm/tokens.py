"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_size(text: Column | str, tokenizer: str = "bytes") -> Column:
    """Tokens of the whole text, without special tokens; a null text has a null size.

    ``bytes``: the byte-level tokenizer, one token for each UTF-8 byte, counted in the JVM. Otherwise the
    path of a vocabulary: ``*.json`` (tokenizers), ``*.tiktoken`` (ranks) or ``*.model`` (sentencepiece).
    """
    col = F.col(text) if isinstance(text, str) else text
    if tokenizer == "bytes":
        return F.octet_length(col).cast("bigint")
    return _counter(tokenizer)(col)


def _counter(path: str) -> Callable[[Column], Column]:
    cache: dict[str, Callable[[str], int]] = {}

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if path not in cache:
            cache[path] = _load(path)
        f = cache[path]
        return texts.map(lambda t: None if t is None else f(t)).astype("Int64")

    return count


def _load(path: str) -> Callable[[str], int]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(piece.encode(t, num_threads=1))
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(enc.encode_ordinary(t))
    raise ValueError(f"no tokenizer is known for {path}")
