"""Composed pipelines, join sizing, bindings from the test tables, the driver
queries and their DuckDB SQL twins."""
