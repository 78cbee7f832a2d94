"""Token counts of a public tokenizer, given by the path of its vocabulary of ranks."""

import base64
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary file on every node; never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published word pattern of that vocabulary: no word goes on past a space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a task keeps at most; the store is emptied beyond that.
KEPT = 500_000

_loaded: dict[tuple[str, str], Callable[[str], int]] = {}


def counter(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[str], int]:
    """Exact number of tokens of a text.

    A word of the pattern holds a space at its begin only, so a text may be cut before every single space and the
    counts of the parts added; parts repeat and are counted once. Around runs of white space it is not cut.
    """
    if (vocabulary, pattern) in _loaded:
        return _loaded[vocabulary, pattern]
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    class Kept(dict):
        """Tokens of a part that follows a space."""

        def __missing__(self, part: str) -> int:
            if len(self) >= KEPT:
                self.clear()
            n = len(encode(" " + part))
            if len(part) <= 64:
                self[part] = n
            return n

    kept, runs = Kept(), re.compile(r"(?<=\S) (?=\S)")

    def count(text: str) -> int:
        if not text:
            return 0
        parts = runs.split(text) if "  " in text else text.split(" ")
        return len(encode(parts[0])) + sum(map(kept.__getitem__, parts[1:]))

    _loaded[vocabulary, pattern] = count
    return count


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; null for null."""

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(vocabulary)
        return pa.array([None if t is None else count(t) for t in texts.to_pylist()], pa.int64())

    return tokens(text)


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text, with n_tokens; rows with a null text are left out."""
    return df.filter(F.col(text).isNotNull()).withColumn("n_tokens", n_tokens(F.col(text), vocabulary)).drop(text)
