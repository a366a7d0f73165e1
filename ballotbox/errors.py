"""Errors: one base, three kinds that also are the usual Python ones."""


class ScanError(Exception):
    pass


class EngineMissing(ScanError, ImportError):
    """An engine or its dependency is not there."""


class EngineFailed(ScanError, RuntimeError):
    """An engine broke while it ran."""


class InvalidImage(ScanError, ValueError):
    """An input that can't be read as an image."""
