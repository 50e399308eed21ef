"""Token counts: Arrow batches go in, lengths come out; token lists never leave a task."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import by_bytes, text_column

KNOWN = 300_000  # pieces whose length a worker remembers
LONG = 64  # longer pieces aren't remembered, and are cut further
_DIGIT = re.compile(r"(?<=[0-9])(?=[0-9A-Za-z])")
_LOADED: dict = {}


class Lengths:
    """Token counts of texts by the tokenizer file at ``path``.

    A text is cut at blanks and line feeds. The vocabulary's own rules let no token,
    composition or special string reach over one, so counts of pieces add up; in a
    piece of over ``LONG`` characters the same holds behind a digit that an ASCII letter or
    digit follows, as a digit is always a token's whole text. Pieces not yet known are
    encoded together, in batches of about equal bytes.
    """

    def __init__(self, path: str, batch: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.known: dict[str, int] = {}
        self.batch = batch

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in by_bytes(pieces, self.batch):
            out += [len(x) for x in self.coder.encode_batch(pieces[a:b], add_special_tokens=False)]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN:
            self.known.clear()
        out: list[int] = []
        for a, b in by_bytes(texts, self.batch * 4):
            cut, new, rest, owner = [], set(), [], []
            for i, t in enumerate(texts[a:b]):
                pieces = t.replace("\n", " ").split(" ")
                if len(max(pieces, key=len)) > LONG:
                    long = [x for p in pieces if len(p) > LONG for x in _DIGIT.split(p)]
                    pieces = [p for p in pieces if len(p) <= LONG] + [x for x in long if len(x) <= LONG]
                    far = [x for x in long if len(x) > LONG]
                    rest += far
                    owner += [i] * len(far)
                cut.append(pieces)
                new |= set(pieces).difference(self.known)
            order = sorted(new)
            own = dict(zip(order, self.encode(order), strict=True))
            self.known |= own
            sums = [sum(map(self.known.__getitem__, pieces)) for pieces in cut]
            for i, n in zip(owner, self.encode(rest), strict=True):
                sums[i] += n
            out += sums
        return out


def lengths(path: str) -> Lengths:
    """The process's counter for ``path``: a worker reads the file once."""
    if path not in _LOADED:
        _LOADED[path] = Lengths(path)
    return _LOADED[path]


def token_count(spark: SparkSession, path: str):
    """A column function text -> struct<n_tokens>."""
    return text_column(lambda texts: {"n_tokens": lengths(path).counts(texts)}, [("n_tokens", pa.int64())], spark, "n_tokens long")


def count_tokens(documents: DataFrame, path: str | Path, limit: int = 2048, text: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row, in no certain order.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids give one
    row each; other columns are not read.
    """
    whole = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    out = documents.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), token_count(documents.sparkSession, str(path))(whole).alias("_r"))
    return out.select("doc_id", "n_bytes", F.col("_r.n_tokens").alias("n_tokens"), (F.col("_r.n_tokens") > limit).alias("over_limit"))
