"""Exceptions raised by the engine, one class for each failure family."""


class EngineError(Exception):
    """Base class."""


class AbortError(EngineError):
    """A transaction has to abort."""


class ConfigError(EngineError):
    """A setting or an operator parameter is out of range."""


class InternalError(EngineError):
    """An invariant of the engine does not hold."""


class ParseError(EngineError):
    """A specification can't be read."""


class ReadOnlyError(EngineError):
    """A write was asked of a read-only object."""


class SerializationError(EngineError):
    """Concurrent transactions conflict."""


class ValueError_(EngineError, ValueError):
    """A value, name or type is not acceptable."""
