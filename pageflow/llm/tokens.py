"""Token counts of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, and how texts are split before it is used; a cluster gives its own path by this setting.
TOKENIZER_CONF = "spark.pageflow.tokenizer"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: Texts are encoded in pieces of about so many characters, cut at line ends or spaces, so that the cost stays in proportion.
PIECE = 100_000


def tokenizer_path(df: DataFrame) -> str:
    """The session's tokenizer file, by default the one in the public collection."""
    path = df.sparkSession.conf.get(TOKENIZER_CONF, None)
    if path:
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path(DEFAULT_FILE)
    except ImportError:
        return f"/opt/tokenizers/{DEFAULT_FILE}"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], int]:
    """A function that counts a text's tokens; special tokens' strings are ordinary text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(sp.encode(text))
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(e.encode_ordinary(text))


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind("\n", at + 1, at + PIECE), text.rfind(" ", at + 1, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def with_tokens(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, kept columns, tokens): the token count of every text, 0 for null and empty ones."""
    path = tokenizer_path(df)
    kept = df.select(F.col(id_col).cast("bigint").alias("id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            n = [sum(map(count, _pieces(t))) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return kept.mapInArrow(run, schema)
