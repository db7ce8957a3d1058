"""Event-log analytics and predictive process monitoring as Spark DataFrame jobs."""

from tracewell.spec import LogSpec, OutcomeSpec

__all__ = ["LogSpec", "OutcomeSpec"]
