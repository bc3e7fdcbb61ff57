"""The corpus pipeline of :mod:`courtside.llm.pipeline`, at the top of the repository."""

from courtside.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
