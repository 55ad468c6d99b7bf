"""Materialised layers: stg (clean) and dw / ml tables written as Parquet under
the shared checkpoint folder (``spark.checkpoint.dir``).

Why: the clean transforms need global statistics over the whole table
(clip bounds, quantile bands) in up to two passes.  Kept lazy, every pass
re-reads the raw inputs (the raw claims join appears 4x in the plan).  Here
the row-local cleaning is written once; each statistics pass then reads only
the columns it needs from columnar Parquet, and downstream layers read the
written tables instead of re-deriving them.  A written table also cuts the
lineage, so a lost executor recomputes from the last written layer, never
from the raw inputs.

Layers form a graph (``GRAPH``).  The key of a layer is a hash of its inputs' keys
and of this package's code; the key of a raw table is the multiset hash of its
content (H17), for the bound test tables that of the files' columns they are made of.  So a change in one table gives new keys to its dependants and to
nothing else, wherever the files lie, and a file that was merely rewritten rebuilds
nothing.  ``refresh`` (S2) builds the layers whose key has no folder yet (or that are
forced) and then writes one new state table, which readers follow: a failed build
leaves the old state, and the change is seen again.  A query asks for the layers that
it reads; no others are hashed or built for it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources import bindings, manifest, sinks
from ..sources.tables import TEST_TABLES, Tables, table_path
from . import clean
from . import warehouse as W

_PKG_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@functools.lru_cache(maxsize=1)
def _code_hash() -> str:
    h = hashlib.sha256()
    for root, _dirs, files in sorted(os.walk(_PKG_DIR)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(root, f), "rb") as fh:
                    h.update(f.encode())
                    h.update(fh.read())
    return h.hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files, from whatever store holds them."""
    h = hashlib.sha256(sf_dir.rstrip("/").encode())
    for t in TEST_TABLES:
        fs, p = _fs(spark, table_path(sf_dir, t))
        if fs.exists(p):
            files, found = fs.listFiles(p, True), []
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
            h.update("\n".join([t, *sorted(found)]).encode())
    h.update(_code_hash().encode())
    return h.hexdigest()[:16]


class Materializer:
    """Write a DataFrame once as Parquet under ``root`` and read it back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, path: str) -> bool:
        fs, p = _fs(self.spark, path + "/_SUCCESS")
        return bool(fs.exists(p))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        if not self._exists(path):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)


def layers_home(spark: SparkSession) -> str:
    """Session conf ``claimwise.layers.root``, else ``<spark.checkpoint.dir>/claimwise/layers``."""
    home = spark.conf.get("claimwise.layers.root", None) or f"{ensure_checkpoint_dir(spark).rstrip('/')}/claimwise/layers"
    return home.rstrip("/")


def layer_root(spark: SparkSession, sf_dir: str) -> str:
    """Folder of what is derived from these input files as they are now (models, streams, uploads)."""
    return f"{layers_home(spark)}/{input_fingerprint(spark, sf_dir)}"


@dataclass
class Layers:
    clean: W.CleanLayer
    fact_claim: DataFrame
    ml_claim: DataFrame


# --------------------------------------------------------------------------
# the layer graph and its refresh
# --------------------------------------------------------------------------

Tabs = dict[str, DataFrame]


@dataclass(frozen=True)
class Layer:
    inputs: tuple[str, ...]                       # raw tables or layers
    build: Callable[[Tabs, Callable], DataFrame]  # (inputs by name, stage) -> the layer


RAW = {"clients_raw": bindings.clients_raw, "policies_raw": bindings.policies_raw,
       "vehicles_raw": bindings.vehicles_raw, "claims_raw": bindings.claims_raw}
CLEAN = ("stg_clean_clients", "stg_clean_policies", "stg_clean_vehicles", "stg_clean_claims")


def _clean_layer(t: Tabs) -> W.CleanLayer:
    return W.CleanLayer(**{n.removeprefix("stg_clean_"): t.get(n) for n in CLEAN})


GRAPH: dict[str, Layer] = {          # in build order
    "stg_clean_clients": Layer(("clients_raw",), lambda t, stage: clean.clean_clients(t["clients_raw"], bindings.CLIENT_ORDER_COLS, stage=stage)),
    "stg_clean_policies": Layer(("policies_raw",), lambda t, stage: clean.clean_policies(t["policies_raw"], stage=stage)),
    "stg_clean_vehicles": Layer(("vehicles_raw",), lambda t, stage: clean.clean_vehicles(t["vehicles_raw"], stage=stage)),
    "stg_clean_claims": Layer(("claims_raw",), lambda t, stage: clean.clean_claims(t["claims_raw"], bindings.CLAIM_ORDER_COLS, stage=stage, within=bindings.CLAIM_WITHIN)),
    "dw_fact_claim": Layer(CLEAN, lambda t, stage: W.fact_claim(_clean_layer(t), stage)),
    "ml_claim": Layer(CLEAN, lambda t, stage: W.ml_claim(_clean_layer(t), stage=stage)),
}


def table_prints(raw: Tabs) -> DataFrame:
    """(table_name, ..., fingerprint) of the raw tables: one aggregate each."""
    return reduce(DataFrame.unionByName, [sinks.fingerprint(df, name) for name, df in raw.items()])


def source_prints(t: Tables, names: Iterable[str]) -> dict[str, str]:
    """Prints of raw tables from the files that their bindings read: the multiset hash of
    each file's bound columns, so the claims' join is not done for its hash alone."""
    parts = [(name, table, cols) for name in names for table, cols in bindings.SOURCES[name].items()]
    found = reduce(DataFrame.unionByName, [sinks.quick_print(getattr(t, table).select(*cols), f"{name}/{table}") for name, table, cols in parts])
    by_part = {r["table_name"]: r["fingerprint"] for r in found.collect()}      # one row a table
    return {name: "|".join(f"{table}={by_part[f'{name}/{table}']}" for table in bindings.SOURCES[name]) for name in names}


def upstream(names: Iterable[str], graph: dict[str, Layer] = GRAPH) -> set[str]:
    """``names`` and all that they rest on, raw tables included."""
    hit = set(names)
    for name in reversed(graph):
        if name in hit:
            hit |= set(graph[name].inputs)
    return hit


def layer_keys(prints: dict[str, str], graph: dict[str, Layer] = GRAPH) -> dict[str, str]:
    """Keys of the raw tables (their prints) and of every layer over them."""
    keys = dict(prints)
    for name, layer in graph.items():
        text = "|".join([_code_hash(), name, *[f"{i}={keys[i]}" for i in layer.inputs]])
        keys[name] = hashlib.sha256(text.encode()).hexdigest()[:16]
    return keys


def dependants(names: Iterable[str], graph: dict[str, Layer] = GRAPH) -> list[str]:
    """The layers that rest on any of ``names`` (tables or layers, themselves included), in build order."""
    hit = set(names)
    for name, layer in graph.items():
        if hit & set(layer.inputs):
            hit.add(name)
    return [name for name in graph if name in hit]


@dataclass
class Refreshed:
    tables: Tabs                                           # every layer, read from its folder
    changed: list[str] = field(default_factory=list)       # raw tables that differ from the last state
    built: list[str] = field(default_factory=list)


STATE = "name string, key string, path string"


def read_state(spark: SparkSession, root: str) -> dict[str, tuple[str, str]]:
    """name -> (key, path) as of the last refresh that succeeded."""
    return {r["name"]: (r["key"], r["path"]) for r in manifest.latest(spark, f"{root}/state", STATE)}


def refresh(spark: SparkSession, raw: Tabs, root: str, force: bool | Iterable[str] = False,
            graph: dict[str, Layer] = GRAPH, wanted: Iterable[str] | None = None,
            prints: Callable[[list[str]], dict[str, str]] | None = None) -> Refreshed:
    """Bring the layers under ``root`` up to the content of ``raw``.

    Layers whose inputs did not change are read as they are.  ``force`` rebuilds all
    layers (True) or the named tables' and layers' dependants, in new folders.  With
    ``wanted`` only those layers and what they rest on are hashed and built; the others
    keep their state.  ``prints`` gives the raw tables' prints, if not their own hash.
    One writer at a time; readers always see a whole state."""
    if wanted is not None:
        on = upstream(wanted, graph)
        raw, graph = {n: df for n, df in raw.items() if n in on}, {n: layer for n, layer in graph.items() if n in on}
    prints = prints(list(raw)) if prints else {r["table_name"]: r["fingerprint"] for r in table_prints(raw).collect()}      # one row a table
    keys, state = layer_keys(prints, graph), read_state(spark, root)
    forced = set(graph) if force is True else set(dependants(force or (), graph))
    out = Refreshed({}, changed=[t for t in raw if state.get(t, ("",))[0] != prints[t]])
    have, now = dict(raw), ({} if wanted is None else dict(state)) | {t: (prints[t], "") for t in raw}
    for name, layer in graph.items():
        path = f"{root}/layers/{name}-{keys[name]}"
        if name in forced:
            path += f"-{time.time_ns():020d}"
        elif name in state and state[name][0] == keys[name]:
            path = state[name][1]
        m = Materializer(spark, path.rsplit("/", 1)[0])
        folder = path.rsplit("/", 1)[1]
        if not m._exists(path):
            m(layer.build({i: have[i] for i in layer.inputs}, lambda df, f=folder, w=m: w(df, f"pre-{f}")), folder)
            out.built.append(name)
        have[name] = out.tables[name] = spark.read.parquet(path)
        now[name] = (keys[name], path)
    if now != state:
        manifest.publish(spark, f"{root}/state", [(n, k, p) for n, (k, p) in now.items()], STATE)
    return out


_CACHE: dict[tuple, Tabs] = {}


def build_layers(spark: SparkSession, sf_dir: str, root: str | None = None, wanted: Iterable[str] | None = None) -> Layers:
    """The layers of these input files (all, or those ``wanted``, the others None): as
    remembered for the files' names, sizes and times, else through a refresh by content."""
    home = (root or layers_home(spark)).rstrip("/")
    files = input_fingerprint(spark, sf_dir)
    t = _CACHE.setdefault((spark.sparkContext.applicationId, home, files), {})
    names = list(GRAPH if wanted is None else wanted)
    m = Materializer(spark, f"{home}/by-files")
    for n in names:
        if n not in t and m._exists(m.path(f"{files}-{n}")):
            t[n] = spark.read.parquet(spark.read.schema(STATE).parquet(m.path(f"{files}-{n}")).first()["path"])
    if missing := [n for n in names if n not in t]:
        tables = Tables(spark, sf_dir)
        place = f"{home}/tables-{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:16]}"
        raw = {n: f(tables) for n, f in RAW.items()} | {"claims_raw": bindings.claims_raw_keyed(tables)}
        t |= refresh(spark, raw, place, wanted=missing, prints=lambda names: source_prints(tables, names)).tables
        state = read_state(spark, place)
        for n in missing:
            m(spark.createDataFrame([(n, *state[n])], STATE).coalesce(1), f"{files}-{n}")
    return Layers(clean=_clean_layer(t), fact_claim=t.get("dw_fact_claim"), ml_claim=t.get("ml_claim"))
