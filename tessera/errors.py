"""Exceptions that the store raises; all derive from StoreError."""


class StoreError(Exception):
    """Any failure of the array store."""


class StoreFormatError(StoreError):
    """A manifest is damaged or of another version, or a request does not fit an array's shape."""


class ArrayNotFound(StoreError):
    def __init__(self, name: str):
        super().__init__(f"no array named {name!r}")


class ArrayAlreadyExists(StoreError):
    def __init__(self, name: str):
        super().__init__(f"an array named {name!r} exists")


class DTypeMismatch(StoreError):
    def __init__(self, name: str, stored: str, asked: str):
        super().__init__(f"array {name!r} holds {stored}, not {asked}")


class CodecError(StoreError):
    """The compression codec is unknown."""


class CommitConflict(StoreError):
    """Another writer committed the same manifest number first."""
