"""Errors by kind."""


class TracewellError(Exception):
    """Base of all errors raised here."""


class UsageError(TracewellError):
    """An argument cannot be used."""


class InvalidInput(TracewellError):
    """Input is not what it should be."""


class LimitExceeded(TracewellError):
    """A documented bound was passed."""


class InputChanged(TracewellError):
    """A file changed while it was read."""


class Unsupported(TracewellError):
    """The operation is not offered for this input."""
