"""A flow-query engine on PySpark: queries are chains of operators, run as DataFrames."""

from sluice.engine import Engine, Result
from sluice.errors import FlowError, FlowNameError, FlowSyntaxError, FlowTestFailure

__all__ = ["Engine", "FlowError", "FlowNameError", "FlowSyntaxError", "FlowTestFailure", "Result"]
