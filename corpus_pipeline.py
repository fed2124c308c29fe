"""The corpus pipeline: quality classifier, line dedup, near-dedup, source mix, byte-level BPE."""

from quern.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
