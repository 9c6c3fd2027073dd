"""The corpus pipeline; its stages are in gaugeworks/llm/stages.py."""

from __future__ import annotations

from gaugeworks.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL can't express the first and the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None
