"""What can go wrong, by kind."""


class SondeError(Exception):
    """Any error of this library."""


class NotFound(SondeError):
    """A file, table or document does not exist."""


class FileTooLarge(SondeError):
    """A file exceeds the size that is read."""


class SourceError(SondeError):
    """A source cannot be listed or read."""


class ParseError(SondeError):
    """A document cannot be parsed."""


class StoreError(SondeError):
    """A table cannot be read or written."""


class EmbedderMissing(SondeError):
    """A dense or hybrid search was asked for, but there is no embedder."""


class DimensionMismatch(SondeError):
    """Vectors of another length than the store's."""


class BadRecord(SondeError):
    """A pushed record lacks a required field."""
