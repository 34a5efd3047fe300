"""The corpus pipeline: STAGES, each reading what its predecessor kept, and run() over documents. See permlab/llm/stages.py."""

from permlab.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
