"""Fill-in-middle transformation by DuckDB inside the tasks.

Each Arrow batch is registered in a DuckDB connection of its task and rewritten by one SQL
statement: lines by regexp_extract_all, cuts by list_slice and array_to_string, draws from
sha256 of the row's id. No Python code sees a row. The draws depend on nothing but the id and
the seed, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, SHARE, SPM_SHARE = 7, 100, 50
UNIT = r"[^\n]*\n|[^\n]+"
#: Bytes of text that DuckDB sees at once; a longer text comes alone.
SLICE_BYTES = 2_000_000

_SQL = """
WITH drawn AS (
    SELECT doc, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '{unit}') AS units
    FROM texts
), numbered AS (
    SELECT doc, text, units, len(units) AS n,
           CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
    FROM drawn
), cut AS (
    SELECT doc, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {share} THEN 'plain'
                WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), parts AS (
    SELECT doc, text, n, form,
           CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, 1, CAST(a AS BIGINT)), ''), '') END AS prefix,
           CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, CAST(a AS BIGINT) + 1, CAST(b AS BIGINT)), ''), '') END AS middle,
           CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, CAST(b AS BIGINT) + 1, CAST(n AS BIGINT)), ''), '') END AS suffix
    FROM cut
)
SELECT doc, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                 ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
FROM parts
"""


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about so many bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64)) // most
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: each whole text with its middle moved last.

    A text's n units are its lines, each with its line feed. Two cuts and the form are drawn
    from sha256 of seed and key. ``plain`` keeps the text: empty and null texts, texts that hold
    one of the three marks, and those that ``share`` percent leave out. Else ``spm_share``
    percent put the suffix first (``spm``), the others the prefix (``psm``). Lengths are code
    points, null for ``plain``. Rows of one key draw alike; a null key draws as the empty
    string. Other columns are ignored. An empty table gives an empty result.
    """
    kind, most = docs.schema[key].dataType.simpleString(), SLICE_BYTES
    sql = _SQL.format(seed=int(seed), share=int(share), spm=int(spm_share), unit=UNIT, p=PREFIX, s=SUFFIX, m=MIDDLE)
    given = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        try:
            for batch in batches:
                for part in slices(batch, "text", most):
                    con.register("texts", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("texts")
        finally:
            con.close()

    out = given.mapInArrow(run, f"doc {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("doc", key)


def restored(output: Column, form: Column) -> Column:
    """The original text, from the output and its form alone."""

    def after(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + len(mark), F.length(output))

    def until(part: Column, mark: str) -> Column:
        return F.substring(part, F.lit(1), F.locate(mark, part) - 1)

    # An output holds each mark once: texts that hold one are plain.
    psm = F.concat(until(after(PREFIX), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their form, and read back from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: Cuts by lengths of lines, not by lists of units.
OP12_SQL = r"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), counted AS (
    SELECT doc_id, text, h, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS n FROM given
), drawn AS (
    SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[25:32])::BIGINT % 100 AS d4 FROM counted
), cut AS (
    SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN d4 < 50 THEN 'spm' ELSE 'psm' END AS form,
           list_transform(string_split(text, chr(10)), lambda line: length(line) + 1) AS sizes
    FROM drawn
), placed AS (
    SELECT *, least(length(text), coalesce(list_sum(sizes[1 : least(c1, c2)]), 0)) AS a,
           least(length(text), coalesce(list_sum(sizes[1 : greatest(c1, c2)]), 0)) AS b
    FROM cut
), parts AS (
    SELECT *, substr(text, 1, a::BIGINT) AS p, substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS m, substr(text, (b + 1)::BIGINT) AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
