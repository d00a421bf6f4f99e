"""Hashes of titles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as a bigint from 0 to 2^32 - 1."""
    unit = lambda h, u: (h.bitwiseXOR(u.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def step(h: Column, c: Column) -> Column:
        cp = F.ascii(c)
        over = cp - 0x10000  # such a code point is two units
        return F.when(cp <= 0xFFFF, unit(h, cp)).otherwise(unit(unit(h, F.shiftright(over, 10) + 0xD800), over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def _fnv(token: str) -> int:
    h = 2166136261
    for u in memoryview(token.encode("utf-16-le")).cast("H"):
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return h


@F.arrow_udf(T.LongType())
def _majority(tokens: pa.Array) -> pa.Array:
    """A batch at a time: each different token is hashed once, bits are added up as prefix sums over all tokens of the batch."""
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))))
    coded = pc.list_flatten(tokens).dictionary_encode()
    hashes = np.array([_fnv(t) for t in coded.dictionary.to_pylist()], np.int64)
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    n, out = np.diff(ends), np.zeros(len(tokens), np.int64)
    for k in range(32):
        ones = np.concatenate(([0], np.cumsum(h >> k & 1)))
        out |= (2 * np.diff(ones[ends]) > n).astype(np.int64) << k
    return pa.array(out, mask=tokens.is_null().to_numpy(zero_copy_only=False))


def simhash32(tokens: Column) -> Column:
    """Bit k is set if more tokens' hashes have it than not; 0 without tokens, null for null. Null tokens don't count."""
    return _majority(F.filter(tokens, lambda t: t.isNotNull()))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
