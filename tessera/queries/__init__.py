"""Registered queries and the DuckDB SQL that says the same."""

from tessera.queries import files, pipelines, points, volumes

QUERIES = volumes.Q | points.Q | files.Q | pipelines.Q
ORACLE_SQL = volumes.S | points.S | files.S | pipelines.S
