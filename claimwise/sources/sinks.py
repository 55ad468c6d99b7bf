"""Sinks and table-level checks (A8–A21 except upload parsing, H17, G14, G15).

Writes are single Spark jobs (task outputs become visible together at job
commit); validation runs as an aggregate *before* the write so a rejected
batch writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DateType, DoubleType, FloatType, IntegralType, MapType,
                               StringType, StructType, TimestampNTZType, TimestampType)

from ..functions.numeric import finite_or_null


def _fs_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def pk_violations(df: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that are null or not unique (0 rows = valid)."""
    g = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    null_key = F.lit(False)
    for k in pk:
        null_key = null_key | F.col(k).isNull()
    return g.where((F.col("n") > 1) | null_key)


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """NaN / ±Inf -> NULL in every float column."""
    fix = {f.name: finite_or_null(F.col(f.name)).cast(f.dataType)
           for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(fix) if fix else df


def load_table(df: DataFrame, path: str, mode: str = "replace", pk: list[str] | None = None) -> dict:
    """A11 (+A8, A13–A15): replace (overwrite) or append a Parquet table.
    Empty input is skipped; a primary key is validated first; on append with
    a different column set the table is recreated from this batch."""
    spark = df.sparkSession
    if df.isEmpty():
        return {"written": False, "reason": "empty"}
    if pk:
        bad = pk_violations(df, pk).limit(1).count()
        if bad:
            raise ValueError(f"primary key {pk} violated")
    out = non_finite_to_null(df)
    write_mode = "overwrite"
    if mode == "append" and _fs_exists(spark, path):
        existing = spark.read.parquet(path).columns
        if {c.lower() for c in existing} == {c.lower() for c in out.columns}:   # same columns in any order
            write_mode = "append"
            by_lower = {c.lower(): c for c in out.columns}
            out = out.select(*[F.col(f"`{by_lower[c.lower()]}`").alias(c) for c in existing])
    out.write.mode(write_mode).parquet(path)
    return {"written": True, "mode": write_mode}


def split_rejects(df: DataFrame, rules: dict[str, "F.Column"]) -> tuple[DataFrame, DataFrame]:
    """A10: rows failing any rule go to quarantine with the first failing
    rule's name as ``reject_reason``; the rest load."""
    reason = None
    for name, bad in rules.items():
        reason = F.when(bad, F.lit(name)) if reason is None else reason.when(bad, F.lit(name))
    tagged = df.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), \
        tagged.where(F.col("reject_reason").isNotNull())


def _dtype_class(dt) -> str:
    if isinstance(dt, BooleanType):
        return "boolean"
    if isinstance(dt, IntegralType):
        return "integer"
    if isinstance(dt, (DoubleType, FloatType)) or dt.typeName() == "decimal":
        return "float"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    return "text"


SQL_TYPE = {"boolean": "BIT", "integer": "BIGINT", "float": "FLOAT", "datetime": "DATETIME2"}


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: dtype class, max text length, storage type
    (text -> NVARCHAR(50/100/255/MAX) by max length).  One aggregate."""
    fields = df.schema.fields
    texts = [f.name for f in fields if isinstance(f.dataType, StringType)]
    lens = df.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(c) for c in texts]) if texts else None
    rows = []
    for i, f in enumerate(fields):
        rows.append((i, f.name, _dtype_class(f.dataType)))
    base = df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, dtype_class string")
    if lens is not None:
        pairs = ", ".join(f"'{c}', `{c}`" for c in texts)
        long = lens.select(F.expr(f"stack({len(texts)}, {pairs}) as (column_name, max_length)"))
        base = base.join(F.broadcast(long), "column_name", "left")
    else:
        base = base.withColumn("max_length", F.lit(None).cast("int"))
    ml = F.coalesce(F.col("max_length"), F.lit(0))
    text_type = F.when(ml <= 50, "NVARCHAR(50)").when(ml <= 100, "NVARCHAR(100)") \
                 .when(ml <= 255, "NVARCHAR(255)").otherwise("NVARCHAR(MAX)")
    m = F.create_map(*[F.lit(x) for kv in SQL_TYPE.items() for x in kv])
    return base.withColumn("sql_type", F.when(F.col("dtype_class") == "text", text_type)
                           .otherwise(m[F.col("dtype_class")]))


def preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """A16 dry run: total count + the first n rows; nothing is written."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A2: CSV scan with a header and a declared schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def ensure_database(spark: SparkSession, name: str) -> bool:
    """Create the schema (database) if missing; True when it existed."""
    existed = spark.catalog.databaseExists(name)
    if not existed:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    return existed


def table_stats(df: DataFrame, status_col: str, active: list[str]) -> DataFrame:
    """Rows, columns, first 10 column names, counts per status (null
    included as its own group) and the active total."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"),
                   F.count_if(F.col(status_col).isin(*active)).alias("active_total"))
    per = df.groupBy(status_col).agg(F.count(F.lit(1)).alias("status_count"))
    return per.crossJoin(F.broadcast(total)).withColumns({
        "n_columns": F.lit(len(df.columns)),
        "first_columns": F.lit(", ".join(df.columns[:10])),
    })


def delete_by_pattern(df: DataFrame, col: str, like: str) -> DataFrame:
    """Drop a bad batch by id pattern (null ids are kept)."""
    return df.where(~F.col(col).like(like) | F.col(col).isNull())


def _double_text(x: Column) -> Column:
    """A double as its whole part and two further parts of 52 binary digits: the
    same text from every engine, all digits kept above 2^-104 in size."""
    two52 = F.lit(float(1 << 52))
    a = (x - F.floor(x)) * two52
    parts = F.concat_ws(":", F.floor(x).cast("string"), F.floor(a).cast("string"), F.floor((a - F.floor(a)) * two52).cast("string"))
    return F.when(F.abs(x) < F.lit(float(1 << 62)), parts).otherwise(x.cast("string"))      # also NaN and infinities


def value_text(c: Column, dt) -> Column:
    """A value as text that differs where the value differs, free of session settings (null stays null)."""
    if isinstance(dt, (DoubleType, FloatType)):
        return _double_text(c.cast("double"))
    if isinstance(dt, TimestampNTZType):
        day = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")      # parts of it, so no time zone comes in
        seconds = (day * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
        return (seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")).cast("string")
    if isinstance(dt, TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dt, BinaryType):
        return F.hex(c)
    return F.to_json(c) if isinstance(dt, (ArrayType, MapType, StructType)) else c.cast("string")


def row_text(df: DataFrame) -> Column:
    """One text a row: every value with its length before it, a null as a mark of its own."""
    cols = []
    for f in df.schema.fields:
        t = value_text(F.col(f"`{f.name}`"), f.dataType)
        cols.append(F.coalesce(F.concat(F.lit("v"), F.length(t).cast("string"), F.lit(":"), t), F.lit("n")))
    return F.concat(*cols)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """A multiset hash of the table, free of row order: row count and two exact
    sums of 60 bits each of the rows' MD5.  A repeated row counts twice, a value that
    moves next to a null changes its row's text.  One aggregate, partial in each task."""
    md5 = F.md5(row_text(df))
    bits = lambda at: F.sum(F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return df.agg(F.count(F.lit(1)).alias("n"), text(bits(1)).alias("sum_low"), text(bits(17)).alias("sum_high")) \
             .select(F.lit(name).alias("table_name"), "n", "sum_low", "sum_high",
                     F.concat_ws(":", F.col("n").cast("string"), "sum_low", "sum_high").alias("fingerprint"))


def quick_print(df: DataFrame, name: str) -> DataFrame:
    """(table_name, fingerprint) for keys inside one engine: a multiset hash like
    ``fingerprint``'s, as row count and four exact sums of 32 bits from two 64-bit hashes of
    each row.  Every value has a null mark beside it; no texts are made of the values."""
    cols = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *cols)
        sums += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))]
    return df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(s.cast("string"), F.lit("0")) for s in sums]).alias("fingerprint")) \
             .select(F.lit(name).alias("table_name"), "fingerprint")


def snapshot_diff(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Tables whose fingerprint changed, appeared or disappeared."""
    c = current.select("table_name", F.col("fingerprint").alias("current"))
    s = saved.select("table_name", F.col("fingerprint").alias("saved"))
    j = c.join(s, "table_name", "full_outer")
    return j.where(~F.col("current").eqNullSafe(F.col("saved")))


def distinct_runs(df: DataFrame, run_col: str = "prediction_run_id") -> DataFrame:
    """Distinct run ids, nulls removed, newest first."""
    return df.select(run_col).where(F.col(run_col).isNotNull()).distinct().orderBy(F.col(run_col).desc())
