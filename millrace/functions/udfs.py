"""Functions no built-in expression can state, as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FNV_BASIS, FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
TOKEN = re.compile(r"[^\W_]+")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = int(FNV_BASIS)
    for b in data:
        h = ((h ^ b) * int(FNV_PRIME)) & 0xFFFFFFFFFFFFFFFF
    return h


def hashed_bow(dim: int):
    """Text → unit vector of token counts at FNV-1a buckets; null where there is no token.

    Tokens are runs of letters and digits in lower case. Each distinct token of a batch is hashed once.
    """
    if dim < 1:
        raise ValueError("dim must be at least 1")

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            self[word] = at = fnv1a(word.encode()) % dim
            return at

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        bucket = Buckets().__getitem__
        out: list[np.ndarray | None] = []
        for first in range(0, len(texts), 1_000):
            tokens = [TOKEN.findall(t.lower()) if t is not None else [] for t in texts.iloc[first : first + 1_000]]
            length = np.array([len(x) for x in tokens])
            at = np.fromiter((bucket(w) for x in tokens for w in x), np.int64, int(length.sum()))
            v = np.bincount(np.repeat(np.arange(len(tokens)) * dim, length) + at, minlength=len(tokens) * dim).reshape(-1, dim)
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1)).astype(np.float32)
            unit = v.astype(np.float32) / np.where(length, norm, 1)[:, None].astype(np.float32)
            out += [u if n else None for u, n in zip(unit, length)]
        return pd.Series(out, dtype=object)

    return embed


MARKER = re.compile(r"\[(\d{1,9})\]")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def cited_markers(texts: pd.Series) -> pd.Series:
    """Numbers of the ``[n]`` marks in a text, in order; one right behind a name or a closing bracket indexes something
    and is no mark, but marks may follow each other directly."""

    def scan(text: str | None) -> list[int] | None:
        if text is None:
            return None
        out, end = [], -1
        for m in MARKER.finditer(text):
            before = text[m.start() - 1] if m.start() else " "
            if m.start() == end or not (before.isascii() and before.isalnum() or before in "_)]}"):
                out.append(int(m.group(1)))
                end = m.end()
        return out

    return texts.map(scan)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and numbers as they were spelled; other text stays as it is."""

    class Spelled(float):
        def __new__(cls, s: str):
            x = float.__new__(cls, 0)
            x.s = s
            return x

    def write(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + write(v) for k, v in sorted(x.items())) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(write, x)) + "]"
        return x.s if isinstance(x, Spelled) else json.dumps(x, ensure_ascii=False)

    def key(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return write(json.loads(text, parse_int=Spelled, parse_float=Spelled))
        except ValueError:
            return text

    return texts.map(key)
