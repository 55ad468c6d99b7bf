"""Upload file ingestion (A3–A7, A9): dual-delimiter, quote-aware CSV.

A line splits on ',' or ';' outside double quotes; a quote opens a quoted run
anywhere in a field, "" inside a run is a literal quote, an unclosed run goes to
the line's end; every field is trimmed; blank lines are skipped.  The header
must contain every contract column (case-insensitive); any data row whose
field count differs from the header rejects the whole file, reporting its
line number; contract columns are mapped by name (extras ignored) and empty
strings become NULL.

Everything is a Spark job over the file; only the header line (one row) and
the validation verdict (one row) reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align
from .batches import BatchTable, Loaded

# a quoted run: a doubled quote inside is one quote; an unclosed run goes to the line's end
_RUN = r'"(?:[^"]++|"")*+(?:"|\z)'
# with a delimiter put before the line, every field follows one
_FIELD = rf'[,;]((?:{_RUN}|[^",;]++)*+)'
_PART = rf'{_RUN}|[^"]++'
_INNER = r'^"((?:[^"]++|"")*+)'


def _unquote(f: Column) -> Column:
    """Quoted runs without their quotes, doubled ones as one; then trimmed."""
    parts = F.regexp_extract_all(f, F.lit(f"({_PART})"), F.lit(1))
    plain = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.regexp_extract(p, _INNER, 1), F.lit('""'), F.lit('"')))
                        .otherwise(p))
    return F.regexp_replace(F.concat_ws("", plain), r"^\s+|\s+$", "")


def split_fields(line: Column) -> Column:
    """array<string> of the parsed fields of one line (one pass over the line)."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), _unquote)


def parse_line_py(line: str) -> list[str]:
    """Plan-time twin used for the single header line."""
    run = _RUN.replace(r"\z", r"\Z")
    out = []
    for raw in re.findall(_FIELD.replace(r"\z", r"\Z"), "," + line):
        parts = re.findall(f"{run}|[^\"]++", raw)
        out.append("".join(re.match(_INNER, p)[1].replace('""', '"') if p.startswith('"') else p for p in parts).strip())
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) with contiguous 1-based line numbers over the files of
    ``path`` in the order of their names: a line's place in its split plus the
    lines of the splits before (a table of one row a split), no global sort."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                                     F.monotonically_increasing_id().alias("_id"))
    split = t.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    off = split.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return t.join(F.broadcast(off), ["_file", "_at"]).select((F.col("_off") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


@dataclass
class UploadResult:
    ok: bool
    error: str | None = None
    data: DataFrame | None = None
    missing: list[str] = field(default_factory=list)


def parse_upload(spark: SparkSession, path: str, expected: list[str]) -> UploadResult:
    lines = numbered_lines(spark, path)
    head = lines.where(F.col("line_no") == 1).select("value").first()
    if head is None or not head[0].strip():
        return UploadResult(False, "CSV file is empty or has no header row.")
    headers = parse_line_py(head[0])
    missing = align.header_check(headers, expected)
    if missing:
        return UploadResult(False, f"CSV is missing required columns: {', '.join(missing)}", missing=missing)
    data = lines.where((F.col("line_no") > 1) & (F.regexp_replace("value", r"\s", "") != "")) \
                .withColumn("_f", split_fields(F.col("value")))
    verdict = data.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(F.struct("line_no", F.size("_f").alias("n")),
                 F.when(F.size("_f") != len(headers), F.col("line_no"))).alias("bad")).first()
    if verdict["bad"] is not None and verdict["bad"]["line_no"] is not None:
        b = verdict["bad"]
        return UploadResult(False, f"Row {b['line_no']} has {b['n']} columns but header has {len(headers)}.")
    if verdict["rows"] == 0:
        return UploadResult(False, "CSV file has no data rows.")
    lower = [h.lower() for h in headers]
    cols = []
    for e in expected:
        if e.lower() in lower:
            v = F.col("_f")[lower.index(e.lower())]
            cols.append(F.when(v != "", v).alias(e))       # A7: empty -> NULL
    return UploadResult(True, data=data.select("line_no", *cols))


def load_upload(spark: SparkSession, path: str, expected: list[str], table: BatchTable) -> Loaded:
    """A file goes into ``table`` whole or, with the reason, not at all."""
    res = parse_upload(spark, path, expected)
    if not res.ok:
        return Loaded("rejected", reason=res.error)
    return table.load(res.data.drop("line_no"))


def render_upload_lines(df: DataFrame, headers: list[str]) -> DataFrame:
    """Writer side used by tests and the round-trip query: one text line per
    row, fields quoted when they hold a delimiter or quote, alternating ','
    and ';' separators (both are accepted by the parser)."""
    def q(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[,;"]'), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)
    parts = []
    for i, h in enumerate(headers):
        parts.append(q(F.col(f"`{h}`")))
        if i < len(headers) - 1:
            parts.append(F.lit("," if i % 2 == 0 else ";"))
    head_line = "".join(f"{h}{',' if i % 2 == 0 else ';'}" for i, h in enumerate(headers))[:-1]
    body = df.select(F.concat(*parts).alias("value"))
    return df.sparkSession.createDataFrame([(head_line,)], "value string").unionByName(body)
