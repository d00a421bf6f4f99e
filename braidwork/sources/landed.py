"""Landed responses as a Python data source (S1, S4, S5, S6): batch reads with pushed-down filters, and a stream by etag marks.

A response is one JSON file, <path>/<source_id>/<number>.json, whose name is its number in the source's order, zero-padded: status,
etag, last_modified and body. A fetcher that the engine doesn't have lands them; a 304 has no body.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source_id string, number bigint, status int, etag string, last_modified string, body string"
#: Files that one partition reads at most.
FILES = 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _numbers(path: str, source: str | None = None) -> dict[str, list[int]]:
    """The numbers of each source's responses, in order; names only, no file is opened. With `source`, path is its own folder."""
    files, root = _open(path)
    out: dict[str, list[int]] = {}
    for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = f.base_name.removesuffix(".json")
        if f.type == fs.FileType.File and f.base_name.endswith(".json") and name.isdigit():
            out.setdefault(source or f.path.rsplit("/", 2)[-2], []).append(int(name))
    return {s: sorted(n) for s, n in sorted(out.items())}


def _response(path: str, source: str, number: int) -> dict:
    files, root = _open(path)
    with files.open_input_stream(f"{root}/{source}/{number:012d}.json") as f:
        return json.loads(f.read())


def _mark(r: dict) -> tuple[str | None, str | None]:
    return r.get("etag"), r.get("last_modified")


@dataclass
class Part(InputPartition):
    """A run of one source's responses, and the number of the one before it, if any."""

    source: str
    numbers: list[int]
    before: int | None = None


def _parts(numbers: dict[str, list[int]], after: dict[str, int] | None = None, upto: dict[str, int] | None = None) -> list[Part]:
    out = []
    for s, every in numbers.items():
        first = next((i for i, n in enumerate(every) if after is None or n > after.get(s, -1)), len(every))
        last = len(every) if upto is None else sum(n <= upto.get(s, -1) for n in every)
        out += [Part(s, every[i : min(i + FILES, last)], every[i - 1] if i else None) for i in range(first, last, FILES)]
    return out


def _rows(path: str, part: Part) -> Iterator[tuple]:
    """The part's responses that bring anything: neither 304 nor with the marks of the last one that did."""
    last = None
    if part.before is not None:  # the marks before the run: those of the last response that has any
        earlier = (n for n in reversed(_numbers(f"{path}/{part.source}", part.source)[part.source]) if n <= part.before)
        last = next((m for m in (_mark(_response(path, part.source, n)) for n in earlier) if any(m)), None)
    for n in part.numbers:
        r = _response(path, part.source, n)
        mark = _mark(r)
        if r.get("status", 200) != 304 and not (any(mark) and mark == last):
            yield part.source, n, r.get("status", 200), *mark, r.get("body")
        last = mark if any(mark) else last


class BatchReader(DataSourceReader):
    """Filters on source_id decide which folders are read; the rest is left to Spark."""

    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Part]:
        found = _numbers(self.path)
        return _parts({s: n for s, n in found.items() if self.wanted is None or s in self.wanted}) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """An offset is the last response of each source with its marks; it moves only when a source has one with other marks."""

    def __init__(self, path: str) -> None:
        self.path, self.last = path, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = dict(self.last)
        for s, numbers in _numbers(self.path).items():
            old = now.get(s)
            if old is None or numbers[-1] > old["number"]:
                for n in reversed(numbers):  # the newest response that is one
                    if old is not None and n <= old["number"]:
                        break
                    r = _response(self.path, s, n)
                    etag, modified = _mark(r)
                    if r.get("status", 200) != 304 and (old is None or not (etag or modified) or [etag, modified] != [old["etag"], old["last_modified"]]):
                        now[s] = {"number": n, "etag": etag, "last_modified": modified}
                        break
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = {**start, **{s: o for s, o in self.last.items() if s in end}} if not self.last else self.last
        at = lambda offsets: {s: o["number"] for s, o in offsets.items()}
        return _parts({s: n for s, n in _numbers(self.path).items() if s in end}, at(start), at(end)) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LandedResponses(DataSource):
    """spark.read.format("landed_responses").load(path), and readStream alike."""

    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:  # noqa: ANN001
        return BatchReader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001, N802
        return StreamReader(self.options["path"])


def responses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The landed responses that bring anything new, as SCHEMA. With filters on source_id only those folders are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedResponses)
    return (spark.readStream if stream else spark.read).format("landed_responses").load(path)


OVERVIEW = "status string, message string, corp_name string, corp_name_eng string, stock_name string, stock_code string, ceo_nm string, corp_cls string, jurir_no string, bizr_no string, adres string, hm_url string, induty_code string, est_dt string, acc_mt string"
HOLDER = "rcept_no string, corp_cls string, nm string, relate string, stock_knd string, bsis_posesn_stock_co string, bsis_posesn_stock_qota_rt string, trmend_posesn_stock_co string, trmend_posesn_stock_qota_rt string, rm string"
DISCLOSURE = "corp_code string, corp_name string, stock_code string, corp_cls string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string"


def _answer(df: DataFrame, schema: str, what: str) -> DataFrame:
    """df with `a`, the body as a struct; a status other than 000 and 013 (no data), or a body that isn't such JSON, is an error."""
    a = df.withColumn("a", F.from_json("body", schema))
    fault = F.concat_ws(" ", F.lit(f"{what}: status"), F.coalesce("a.status", F.lit("missing")), "a.message")
    return a.where(F.when(F.col("a.status").isin("000", "013"), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def overviews(df: DataFrame) -> DataFrame:
    """One row of company facts a response (source_id is the company's code); with status 013 facts are null."""
    return _answer(df, OVERVIEW, "overview").select("source_id", "number", "a.*")


def shareholders(df: DataFrame) -> DataFrame:
    """A row a shareholder, `ordinal` in the list's order; no data is no row."""
    a = _answer(df, f"status string, message string, list array<struct<{', '.join(x.replace(' ', ':', 1) for x in HOLDER.split(', '))}>>", "shareholders")
    return a.where("a.status = '000'").select("source_id", "number", F.posexplode("a.list").alias("ordinal", "r")).select("source_id", "number", "ordinal", "r.*")


def disclosures(df: DataFrame) -> DataFrame:
    """A row a disclosure, in the list's order; no data is no row."""
    a = _answer(df, f"status string, message string, list array<struct<{', '.join(x.replace(' ', ':', 1) for x in DISCLOSURE.split(', '))}>>", "disclosures")
    return a.where("a.status = '000'").select("source_id", "number", F.posexplode("a.list").alias("ordinal", "r")).select("source_id", "number", "ordinal", "r.*")
