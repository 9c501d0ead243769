"""Errors of the engine; all of them are found before or instead of a wrong result."""


class GraphError(Exception):
    """Any error of this engine."""


class ParseError(GraphError):
    """The text is no statement."""


class AnalysisError(GraphError):
    """A statement that has no meaning: unbound variables, types that do not fit, forms that are not supported."""


class ConflictError(GraphError):
    """Another transaction committed a write to the same node or edge first."""


class ReadOnlyError(GraphError):
    """A statement that writes, in a session that only reads."""


class CorruptLogError(GraphError):
    """A change log whose records fail their checks."""
