"""tessera: a Spark-native store for many named n-dimensional arrays."""

from tessera.errors import (
    ArrayAlreadyExists,
    ArrayNotFound,
    CodecError,
    DTypeMismatch,
    StoreError,
    StoreFormatError,
)
from tessera.functions.dtypes import DTYPES, Attr, Fill
from tessera.store import ArrayStore

__all__ = ["DTYPES", "ArrayAlreadyExists", "ArrayNotFound", "ArrayStore", "Attr", "CodecError", "DTypeMismatch", "Fill", "StoreError", "StoreFormatError"]
