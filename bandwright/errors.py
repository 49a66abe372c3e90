"""One exception class for each kind of failure."""


class EngineError(Exception):
    """Any failure that this library reports."""


class FileMissing(EngineError):
    """A file that is needed does not exist."""


class IoFailure(EngineError):
    """Reading or writing failed, or a file's size does not fit its header."""


class InvalidHeader(EngineError):
    """A header is no JSON, or lacks a field, or has a value out of range."""


class InvalidArgs(EngineError):
    """Arguments that contradict each other or the image."""
