"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of each."""

from __future__ import annotations

from . import bundles, designs, fitted, motion, screens, shapes, studies

QUERIES: dict = {**motion.QUERIES, **bundles.QUERIES, **studies.QUERIES, **fitted.QUERIES, **screens.QUERIES, **designs.QUERIES, **shapes.QUERIES}
ORACLE_SQL: dict[str, str] = {**motion.ORACLE_SQL, **bundles.ORACLE_SQL, **studies.ORACLE_SQL, **fitted.ORACLE_SQL, **screens.ORACLE_SQL, **designs.ORACLE_SQL, **shapes.ORACLE_SQL}
