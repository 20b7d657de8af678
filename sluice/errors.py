"""Errors that a query can raise."""


class FlowError(Exception):
    """Any error in a query."""


class FlowSyntaxError(FlowError):
    """The text is no query."""


class FlowNameError(FlowError):
    """A table, column, model, method or type has no such name."""


class FlowTestFailure(FlowError):
    """A ``test`` did not hold."""
