"""Atomic batch loads (A8, A9, A10): stage, validate, then publish by one manifest swap.

A table is a folder of batches, each written once, and a manifest that names those
which belong to it.  A load writes its rows beside the table, checks what it wrote,
and only then puts the batch into a new manifest: a load that fails, at any point,
leaves the table as it was, and readers never see half a batch.  A batch is known
by its id, by default the multiset hash of its rows, so a repeated load adds nothing.

Checks: no null and no repeated primary key inside the batch, none that the table has
already.  Rows that break a row rule either reject the whole batch (``reject="batch"``,
the upload) or go to a quarantine of their own (``reject="rows"``, the ingest).
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import align
from . import manifest, sinks

BATCHES = "batch_id string, path string, rows long, quarantine string, rejected long"


@dataclass(frozen=True)
class Loaded:
    status: str            # loaded, repeated, rejected or empty
    rows: int = 0          # rows the table gained
    rejected: int = 0      # rows that went to quarantine
    reason: str | None = None


class BatchTable:
    """An append-only table under ``root`` with a declared schema."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, pk: list[str] | None = None):
        self.spark, self.root, self.schema, self.pk = spark, root.rstrip("/"), schema, pk or []

    def batches(self) -> list:
        return manifest.latest(self.spark, f"{self.root}/manifest", BATCHES)

    def _read(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of all batches, with the ``batch_id`` that brought them."""
        found = self.batches()
        out = self._read([b["path"] for b in found], self.schema)
        return out.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), r"/batch-([^/]+)/[^/]*$", 1)) if found \
            else out.withColumn("batch_id", F.lit(None).cast("string"))

    def quarantine(self) -> DataFrame:
        """Rows kept out of the table, with the rule that they broke."""
        return self._read([b["quarantine"] for b in self.batches() if b["rejected"]], StructType(self.schema.fields).add("reject_reason", "string"))

    def _broken_keys(self, staged: DataFrame, found: list) -> str | None:
        if not self.pk:
            return None
        if sinks.pk_violations(staged, self.pk).limit(1).count():
            return f"primary key {self.pk} is null or repeated in the batch"
        held = self._read([b["path"] for b in found], self.schema).select(*self.pk)
        if found and staged.select(*self.pk).join(held, self.pk, "left_semi").limit(1).count():
            return f"primary key {self.pk} is in the table already"
        return None

    def load(self, df: DataFrame, batch_id: str | None = None, rules: dict[str, Column] | None = None, reject: str = "batch") -> Loaded:
        missing = [f.name for f in self.schema.fields if f.name not in df.columns]
        if missing:
            return Loaded("rejected", reason=f"missing columns: {', '.join(missing)}")
        rows = sinks.non_finite_to_null(align.validate_and_cast(df.select(*self.schema.names), self.schema))
        found = self.batches()
        if batch_id is None:
            print_ = sinks.fingerprint(rows, "batch").first()["fingerprint"]
            batch_id = hashlib.sha256(print_.encode()).hexdigest()[:16]
        if any(b["batch_id"] == batch_id for b in found):
            return Loaded("repeated")
        place = f"{self.root}/staged-{uuid.uuid4().hex[:12]}"
        path, aside = f"{place}/batch-{batch_id}", f"{place}/rejects-{batch_id}"
        good, bad = sinks.split_rejects(rows, rules) if rules else (rows, None)
        good.write.parquet(path)
        staged = self._read([path], self.schema)
        rejected = 0
        if bad is not None:
            bad.write.parquet(aside)
            rejected = self.spark.read.schema(bad.schema).parquet(aside).count()
        if rejected and reject == "batch":
            return Loaded("rejected", rejected=rejected, reason=f"{rejected} rows break a rule")
        n = staged.count()
        if not n and not rejected:
            return Loaded("empty")
        broken = self._broken_keys(staged, found)
        if broken:
            return Loaded("rejected", reason=broken)
        manifest.publish(self.spark, f"{self.root}/manifest", [tuple(b) for b in found] + [(batch_id, path, n, aside, rejected)], BATCHES)
        return Loaded("loaded", rows=n, rejected=rejected)
