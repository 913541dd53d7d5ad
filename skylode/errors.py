"""Errors that callers see."""


class EngineError(Exception):
    """Base of all errors of this package."""


class TenantError(EngineError):
    """An invalid namespace, collection or tenant name."""


class ValidationError(EngineError):
    """A request that can't be carried out as it stands."""


class UnsupportedError(EngineError):
    """A request that this table can't serve."""


class StorageError(EngineError):
    """The store or a job failed; the message holds no internals."""
