"""Scripts to classified statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.functions import scanners, text


def statements(scripts: DataFrame) -> DataFrame:
    """scripts(script_id, ddl) to script_id, stmt_seq, stmt, kind, schema, name, temporary; other statements are left out.

    kind: TABLE, VIEW, MATERIALIZED_VIEW, FUNCTION, PROCEDURE or ALTER. One shuffle-free pass.
    """
    return scripts.select("script_id", F.inline(scanners.statements(text.strip_comments(F.col("ddl")))))


def statement_counts(scripts: DataFrame) -> DataFrame:
    """script_id, n_statements: all statements, whatever their kind."""
    return scripts.select("script_id", F.size(scanners.statement_texts(text.strip_comments(F.col("ddl")))).cast("bigint").alias("n_statements"))
