"""propgraph: a property-graph analytics engine on PySpark DataFrames."""

from .errors import AnalysisError, ConflictError, CorruptLogError, GraphError, ParseError, ReadOnlyError
from .session import GraphSession, GraphStore, Transaction
from .sources.catalog import PropertyGraph

__all__ = ["AnalysisError", "ConflictError", "CorruptLogError", "GraphError", "GraphSession", "GraphStore", "ParseError", "PropertyGraph", "ReadOnlyError", "Transaction"]
