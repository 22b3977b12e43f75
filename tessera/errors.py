"""Errors of the engine."""


class TesseraError(Exception):
    """Any of them."""


class SourceError(TesseraError):
    """A source cannot be read."""


class ModelError(TesseraError):
    """A pluggable model is missing or gave no usable answer."""
