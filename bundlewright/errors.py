"""Errors of the engine."""


class BundlewrightError(Exception):
    """Any of them."""


class SourceError(BundlewrightError):
    """A source can't be read."""


class IndexFormatError(BundlewrightError):
    """A saved index is missing, broken or of another format."""


class RequestError(BundlewrightError):
    """A request that can't be understood."""
