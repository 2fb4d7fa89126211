"""Errors of the public interface."""


class InvalidArgument(ValueError):
    """A request that can't be valid: bad filter, wrong dimension, unknown metric, bad payload."""


class NotFound(KeyError):
    """An id that isn't alive, or an index that isn't there."""
