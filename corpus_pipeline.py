"""From raw documents to training tokens in five stages; see cairn.llm.pipeline."""

from cairn.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
