"""Errors of graphs and running applications."""


class GraphError(Exception):
    """Base of all errors here."""


class InvalidAppError(GraphError):
    """The graph cannot be compiled."""


class DuplicateError(GraphError):
    """A node or application of this name exists."""


class AppNotFoundError(GraphError):
    """No application of this name."""


class NodeNotFoundError(GraphError):
    """No node of this name in the graph."""


class AlternateNotFoundError(GraphError):
    """The node has no alternate of this name."""


class InsufficientResourcesError(GraphError):
    """More instances were asked for than there are cores."""
