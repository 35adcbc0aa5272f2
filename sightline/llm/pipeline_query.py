"""The pipeline as a registered query."""

import corpus_pipeline


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
