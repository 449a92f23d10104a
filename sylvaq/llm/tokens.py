"""Exact token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.ship import ship

#: Rank file and split pattern of the public vocabulary; both are parameters of every operator that counts.
VOCABULARY = os.environ.get("SYLVAQ_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's word cache after which it starts afresh.
CACHE = 1_000_000


class TokenCounter:
    """Counts tokens word by word with a cache.

    The split pattern always cuts between a character that is not white space and
    a single blank followed by another such character, and around a line break
    followed by one. Lines of plainly spaced words are therefore counted as the
    sum over their words, each with its leading blank, which a dictionary answers
    for all but new words; any other line is encoded as it is. The sum equals the
    length of the encoded text.
    """

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = enc.encode_ordinary
        encode = self.encode

        class Lengths(dict):
            prefix = ""

            def __missing__(self, key: str) -> int:
                if len(self) > CACHE:
                    self.clear()
                n = self[key] = len(encode(self.prefix + key))
                return n

        class Spaced(Lengths):
            prefix = " "

        class Breaks(Lengths):
            def __missing__(self, key: str) -> int:
                n = self[key] = (len(encode(key[:-1])) if len(key) > 1 else 0) + len(encode("\n"))
                return n

        self._first, self._spaced, self._breaks = Lengths(), Spaced(), Breaks()
        self._cut = re.compile(r"(\s*\n)(?=\S)").split

    def _line(self, line: str) -> int:
        if not line:
            return 0
        if "  " in line or line[-1] == " " or not line.isprintable():
            return len(self.encode(line))
        words = line.split(" ")
        return self._first[words[0]] + sum(map(self._spaced.__getitem__, words[1:]))

    def _uneven(self, text: str) -> int:
        parts = self._cut(text)
        n = self._line(parts[0])
        for i in range(1, len(parts), 2):
            n += self._breaks[parts[i]] + self._line(parts[i + 1])
        return n

    def count(self, text: str) -> int:
        """Tokens of ``text``; 0 for an empty one."""
        n = breaks = 0
        for line in text.split("\n"):
            if line:
                if line[0].isspace() or line[-1].isspace():
                    return self._uneven(text)
                if breaks:
                    n += 1 if breaks == 1 else self._breaks["\n" * breaks]
                    breaks = 0
                n += self._line(line)
            breaks += 1
        return n + (len(self.encode("\n" * (breaks - 1))) if breaks > 1 else 0)


@lru_cache(maxsize=4)
def counter(vocabulary: str, pattern: str = PATTERN) -> TokenCounter:
    """One counter per Python worker."""
    return TokenCounter(vocabulary, pattern)


def token_counts(df: DataFrame, key: str, text: str, extra: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *extra, tokens, head_tokens): tokens of the whole text and of its first line.

    A narrow map, no shuffle; only the named columns are read. NULL and empty
    texts have 0 tokens. Repeated rows stay.
    """
    ship(df.sparkSession)
    keep = [key, *(extra or [])]
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = narrow.select(*keep).withColumns({"tokens": F.lit(0).cast("bigint"), "head_tokens": F.lit(0).cast("bigint")}).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            total = [c.count(t) if t else 0 for t in texts]
            head = [n if n and (at := t.find("\n")) < 0 else c.count(t[:at]) if n else 0 for t, n in zip(texts, total)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total, pa.int64()), pa.array(head, pa.int64())], names=names)

    return narrow.mapInArrow(run, schema)
