"""Digests that Spark lacks, as Pandas UDFs: the same values as BLAKE2b over the same bytes.

The native SHA-256 forms in ``columns`` are what plans use; these are for results that must equal earlier ones.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F


def blake2b_unit(key: Column, seed: int = 42) -> Column:
    """The first 8 bytes of the digest of ``seed:key``, as a share of their range."""

    @F.pandas_udf("double")
    def of(keys: pd.Series) -> pd.Series:
        digest = lambda k: hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest()
        return keys.map(lambda k: int.from_bytes(digest(k), "big") / 2**64, na_action="ignore")

    return of(key.cast("string"))


def blake2b_lines(lines: Column) -> Column:
    """The 10-byte digest of an array of lines, each ended by a newline, in hexadecimal digits."""

    @F.pandas_udf("string")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ls: hashlib.blake2b("".join(f"{x}\n" for x in ls).encode(), digest_size=10).hexdigest(), na_action="ignore")

    return of(lines)
