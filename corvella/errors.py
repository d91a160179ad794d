"""Errors of the engine; wrong arguments of a caller raise ValueError."""


class CorvellaError(Exception):
    """Base of all errors below."""


class OpenError(CorvellaError):
    """A database can't be opened."""


class ClosedError(CorvellaError):
    """The database is closed."""


class TransactionError(CorvellaError):
    """Nested transactions, writes in a read transaction, or a lost race for a revision."""


class SchemaError(CorvellaError):
    """An invalid or incompatible schema, or an unknown field or collection."""


class QueryError(CorvellaError):
    """A query that its field types don't allow."""


class UniqueIndexError(CorvellaError):
    """Two documents with the same key in a unique index."""


class EngineError(CorvellaError):
    """Anything else that fails below the engine."""
