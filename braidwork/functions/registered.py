"""The function library for SQL: table functions and scalar functions that a session can call by name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from braidwork.config import AMBIGUOUS_ALIASES, HOLDING_SUFFIXES

_LATIN = re.compile(r"[A-Za-z]{1,2}\Z")
_MARKS, _LIGHT = re.compile(r"\(주\)|㈜|\(유\)|주식회사"), re.compile(r"\s+|[.,'\"“”‘’·\-_/]")
_SPELLED = T.StructType([T.StructField("alias", T.StringType()), T.StructField("alias_norm", T.StringType()), T.StructField("alias_type", T.StringType()), T.StructField("is_ambiguous", T.BooleanType())])
_PAIRS = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("token", T.StringType())])


def _norm(name: str) -> str:
    return _LIGHT.sub("", _MARKS.sub("", unicodedata.normalize("NFC", name))).lower()


@udtf(returnType=_SPELLED)
class AliasExpand:
    """alias_expand(name, ticker, english, former, brands, holding): a row a spelling of a company; nulls bring none."""

    def eval(self, name: str, ticker: str, english: str, former: list, brands: list, holding: bool) -> Iterator[tuple]:
        short = next((name[: -len(s)] for s in HOLDING_SUFFIXES if holding and name and name.endswith(s) and len(name) > len(s)), None)
        every = [(name, "OFFICIAL"), (ticker, "TICKER"), (english, "ENGLISH"), *((f, "FORMER") for f in former or []), *((b, "BRAND") for b in brands or []), (short, "SHORT")]
        seen = set()
        for alias, kind in every:
            alias = (alias or "").strip(" ")
            norm = _norm(alias)
            if norm and not _LATIN.match(alias) and (kind, norm) not in seen:
                seen.add((kind, norm))
                yield alias, norm, kind, norm in AMBIGUOUS_ALIASES or len(norm) <= 1


@udtf(returnType=_PAIRS)
class TitleTokens:
    """title_tokens(title): overlapping pairs of letters and digits with their places from 0; null and empty titles bring none."""

    def eval(self, title: str) -> Iterator[tuple]:
        kept = "".join(c for c in title or "" if unicodedata.category(c)[0] in "LN")
        if len(kept) == 1:
            yield 0, kept
        for i in range(len(kept) - 1):
            yield i, kept[i : i + 2]


#: Scalar functions in SQL itself, so that the optimiser sees through them: signature to body.
SCALARS = {
    "name_norm(name STRING) RETURNS STRING": r"""lower(regexp_replace(regexp_replace(regexp_replace(name, '\\(주\\)|㈜|\\(유\\)|주식회사', ''), '\\s+', ''), '[.,\'"“”‘’·\\-_/]', ''))""",
    "hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "half_up(x DOUBLE) RETURNS DOUBLE": "floor(x + 0.5D)",
    "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 1D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session; returns their names. Doing it again changes nothing."""
    spark.udtf.register("alias_expand", AliasExpand)
    spark.udtf.register("title_tokens", TitleTokens)
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return ["alias_expand", "title_tokens", *(s.split("(")[0] for s in SCALARS)]
