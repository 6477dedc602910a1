"""Every query of the library's core: name -> (spark, sf_dir) -> DataFrame, with DuckDB SQL beside it."""

from __future__ import annotations

from siltstone.plans import evaluation, experiments, graphs, ingest, reporting, retrieval, streams

PARTS = [ingest.C, retrieval.C, graphs.C, evaluation.C, reporting.C, experiments.C, streams.C]
QUERIES = {name: q for c in PARTS for name, q in c.queries.items()}
ORACLE: dict[str, str] = {name: q for c in PARTS for name, q in c.oracle.items()}
