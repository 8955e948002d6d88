"""Errors of the library."""


class TesseraError(Exception):
    """Base of all errors raised on purpose."""


class RepositoryError(TesseraError):
    """A source tree that cannot be opened."""


class StoreError(TesseraError):
    """A stored index that is missing, of another version, or not valid for its tree."""


class QueryError(TesseraError):
    """A request with missing or wrong parameters."""
