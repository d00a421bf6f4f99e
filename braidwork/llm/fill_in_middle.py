"""Fill-in-middle transformation: DuckDB rewrites each Arrow batch inside mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.common import mapped, table

#: A unit is a run of white space with the word after it, or the white space at the end. The unit pattern of the contract.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bytes of text that one DuckDB statement is given at most, a longer single text aside: its lists of units bound the memory.
PIECE = 8 << 20
MADE = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def statement(seed: int, rate: int, spm: int) -> str:
    """The SQL over a relation `batch` (key, text), both texts and never null. A row a row, in order."""
    drawn = ", ".join(f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH units AS (SELECT text, regexp_extract_all(text, '{UNIT}') AS u, sha256('{int(seed)}:' || key) AS hash FROM batch),
drawn AS (SELECT text, u, len(u) AS n, {drawn} FROM units),
planned AS (SELECT text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {int(rate)} THEN 'plain' WHEN h4 % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix FROM planned)
SELECT n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM cut"""


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows; after its first text, which may be of any length, a run has fewer than `most` bytes."""
    if batch.num_rows:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _run(sql: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": True})
        con.execute("SET temp_directory = ''")  # nothing is spilled to a folder of this machine
        for whole in batches:
            for batch in slices(whole, 1, PIECE):
                con.register("batch", pa.Table.from_batches([batch]).select([0, 1]).rename_columns(["key", "text"]))
                made = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                kept = pa.Table.from_batches([batch]).drop_columns(batch.schema.names[:2])
                for f in MADE:
                    kept = kept.append_column(f.name, made.column(f.name).cast(_ARROW[f.dataType]))
                yield from kept.to_batches()
        con.close()

    return run


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, then n (units), form (plain, spm or psm), prefix_chars, middle_chars and output, the rewritten text.

    About `rate` texts in a hundred are cut in three and put in another order, `spm` in a hundred of them with the suffix
    first; a text's draws come from the hash of seed and key alone, so reruns and any partitioning agree. A map: no shuffle.

    * null text is empty; an empty text, or one with a marker in it, stays plain;
    * a null key counts as the empty text, rows that repeat are rewritten alike, an empty table gives no rows;
    * only key, text and `keep` are read, so other columns may have any name; a kept column named as a made one is an error;
    * very long texts are cut whole. A statement holds the units of 8 MB of texts, or of one longer text: about nine times its
      bytes (a text of 200 MB took 1.8 GB).
    """
    given = [F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))]
    return mapped(docs, given, keep, MADE, _run(statement(seed, rate, spm)))


def restored(output: Column, form: Column) -> Column:
    """The text that transformed() made output from. A marker can't arise where two parts meet, so the first of each is the real one."""
    head, middle = F.split_part(output, F.lit("<M>"), F.lit(1)), F.split_part(output, F.lit("<M>"), F.lit(2))
    body = F.substring(head, 4, 2147483647)
    psm = F.concat(F.split_part(body, F.lit("<S>"), F.lit(1)), middle, F.split_part(body, F.lit("<S>"), F.lit(2)))
    spm = F.concat(F.split_part(body, F.lit("<P>"), F.lit(2)), middle, F.split_part(body, F.lit("<P>"), F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten, with digests of the output and of the text rebuilt from it."""
    made = transformed(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT *, len(u) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS draw FROM d),
q AS (SELECT *, list_sort([draw[1] % (n + 1), draw[2] % (n + 1)]) AS ends, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR draw[3] % 100 >= 50 THEN 'plain' WHEN draw[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM p),
r AS (SELECT *, array_to_string(u[:ends[1]], '') AS a, array_to_string(u[ends[1] + 1:ends[2]], '') AS b, array_to_string(u[ends[2] + 1:], '') AS c FROM q)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM r"""
