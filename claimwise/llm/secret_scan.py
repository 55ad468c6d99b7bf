"""Operator 2: secret scan with corpus-wide ownership frequency.

1. Every whole text is searched once for the base kinds: assignments of a long
   value to a password-like name, access keys, runs of hex digits.  (A linear
   RE2 scan of the Arrow batch picks the documents that can match; only those
   are searched.)  Each match is a candidate credential, known by the SHA-256
   of its value.
2. The candidates of all documents are aggregated: distinct repositories and
   distinct owners of each value, first per (value, repository, owner), so that
   a value which sits in a third of all documents is reduced before the shuffle.
3. A value with one owner and one repository, of many different signs, is live-looking; one with
   at least ``COPIED`` owners is a widely copied example; the rest is shared.
   Live-looking values add a span ``live``, copied ones a span ``example``.

Base spans are leftmost and not overlapping per kind; short ones are dropped
after matching.  Offsets are code points, ends exclusive.

Defined cases.  Null or empty text has no spans (digest of the empty string).  A
null repository or owner is one of its own.  Null doc_ids and repeated rows are
scanned like others, each row gives a row (a repeated document does not add
owners).  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, read, written

KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")      # a run of hex digits is one match, so short runs need no match
CAN = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}")
COPIED = 3                              # owners from which a value counts as an example
SIGNS = 6                               # different signs that a live credential has at least


def base_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) in order."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "access" in kinds:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


SPAN = "struct<kind:string,start:int,end:int,at:int,value:binary,signs:int>"
FOUND = f"rid long, doc_id long, repo string, owner string, spans array<{SPAN}>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()),
                                    ("value", pa.binary()), ("signs", pa.int32())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            b = batch.slice(i, 512)
            text = b.column("text")
            can = [pc.fill_null(pc.match_substring_regex(text, p), False).to_pylist() for p in CAN]
            spans = []
            for r in range(b.num_rows):
                kinds = tuple(k for k, c in zip(KINDS, can, strict=True) if c[r])
                t = text[r].as_py() if kinds else ""
                row = []
                for s, k, e, at in base_spans(t, kinds):
                    value = t[at:e]
                    row.append({"kind": KINDS[k], "start": s, "end": e, "at": at, "value": hashlib.sha256(value.encode()).digest(),
                                "signs": len(Counter(value))})
                spans.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + b.num_rows), pa.int64()), b.column("doc_id"), b.column("repo"),
                                              b.column("owner"), pa.array(spans, span_type)], names=["rid", "doc_id", "repo", "owner", "spans"])
            rid += b.num_rows


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, copied: int = COPIED, signs: int = SIGNS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and what repo and owner read): the
    base counts and digest, all spans, and how many values of each class."""
    by_value()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    rows = written(d.mapInArrow(_scan, FOUND), "secrets-found")
    each = rows.where("size(spans) > 0").select("rid", "repo", "owner", F.explode("spans").alias("s"))
    held = each.groupBy("s.value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    use = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("n").alias("uses"))
    kind = F.when(F.col("owners") >= copied, "example").when((F.col("owners") == 1) & (F.col("repos") == 1) & (F.col("s.signs") >= signs), "live") \
            .otherwise("shared")
    judged = each.select("rid", "s", F.col("s.value").alias("value")).join(use, "value").select("rid", "s", kind.alias("class"))
    extra = judged.where("class != 'shared'").groupBy("rid").agg(
        F.collect_set(F.struct(F.col("s.at").alias("start"), F.when(F.col("class") == "live", 3).otherwise(4).alias("k"), F.col("s.end").alias("end"),
                               F.col("class").alias("kind"))).alias("added"))
    number = lambda k: F.when(k == "assign", 0).when(k == "access", 1).otherwise(2)
    base = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number(s["kind"]).alias("k"), s["end"].alias("end"),
                                                               s["kind"].alias("kind"))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = rows.select("rid", "doc_id", base.alias("base")).join(extra, "rid", "left")
    added = F.coalesce("added", F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)"))
    every = F.array_sort(F.concat("base", added))
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count("base", k).alias("n_" + k) for k in KINDS],
                      F.sha2(joined("base"), 256).alias("base_sha256"), joined(every).alias("spans"),
                      count(added, "live").alias("n_live"), count(added, "example").alias("n_example"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A source is an owner, a source's documents of one language a repository of it."""
    docs = read(spark, sf_dir, "documents")
    return scan_secrets(docs, F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), F.col("source"))
