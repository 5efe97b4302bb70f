"""The corpus pipeline by the names that its callers know; the stages are in ``difforge.llm.pipeline``."""

from difforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
