"""Element types, fill values and attribute values.

Spark has no unsigned or nanosecond types, so every element type names the
Spark column type that holds it and the integer range it wraps to.  Fill
values are coerced on the driver: ANSI casts would raise where the store's
contract is to wrap (integers) or saturate (floats to integers).
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np


@dataclass(frozen=True)
class DType:
    """One element type: Spark SQL type, numpy type, width in bytes (None: variable) and statistics kind."""

    name: str
    spark: str
    numpy: str
    size: int | None
    stat: str  # Int, UInt, Float, Bytes, TimestampNs
    defined: bool = True  # arrays of this type can be defined

    @property
    def variable(self) -> bool:
        return self.size is None

    @property
    def bits(self) -> tuple[int, bool] | None:
        """(width in bits, signed) of integer types."""
        if self.stat in ("Int", "TimestampNs"):
            return self.size * 8, True
        return (self.size * 8, False) if self.stat == "UInt" and self.name != "bool" else None


DTYPES: dict[str, DType] = {
    t.name: t
    for t in (
        DType("bool", "boolean", "bool", 1, "UInt", defined=False),
        DType("int8", "tinyint", "int8", 1, "Int"),
        DType("int16", "smallint", "int16", 2, "Int"),
        DType("int32", "int", "int32", 4, "Int"),
        DType("int64", "bigint", "int64", 8, "Int"),
        DType("uint8", "smallint", "uint8", 1, "UInt"),
        DType("uint16", "int", "uint16", 2, "UInt"),
        DType("uint32", "bigint", "uint32", 4, "UInt"),
        DType("uint64", "decimal(20,0)", "uint64", 8, "UInt"),
        DType("float32", "float", "float32", 4, "Float"),
        DType("float64", "double", "float64", 8, "Float"),
        DType("string", "string", "object", None, "Bytes"),
        DType("binary", "binary", "object", None, "Bytes"),
        DType("timestamp_ns", "bigint", "int64", 8, "TimestampNs"),
    )
}


def fixed_size_list_size(child: int | None, length: int) -> int | None:
    """Width of a fixed-size list: the child's width times its length; lists of variable children are variable."""
    return None if child is None else child * length


@dataclass(frozen=True)
class Fill:
    """A fill value with its kind: Bool, Int, UInt, Float, String or TimestampNs.  Floats compare by bits."""

    kind: str
    value: Any

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Fill) or self.kind != other.kind:
            return False
        return float_bits(self.value) == float_bits(other.value) if self.kind == "Float" else self.value == other.value

    __hash__ = None


def float_bits(x: float) -> bytes:
    return struct.pack("<d", x)


def _wrap(x: int, bits: tuple[int, bool]) -> int:
    width, signed = bits
    x &= (1 << width) - 1
    return x - (1 << width) if signed and x >> (width - 1) else x


def _saturate(x: float, bits: tuple[int, bool]) -> int:
    width, signed = bits
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    if math.isnan(x):
        return 0
    if math.isinf(x):
        return high if x > 0 else low
    return max(low, min(high, int(x)))


#: Which fill kinds an array type takes when unwritten cells are read; others give the type's zero.
READ_KINDS = {
    "UInt": ("UInt", "Int", "Float", "Bool"),
    "Int": ("Int", "UInt", "Float"),
    "Float": ("Float", "Int", "UInt"),
    "TimestampNs": ("TimestampNs", "Int"),
    "Bytes": (),
}

#: Which fill kinds mark a written cell as null in the statistics; narrower than READ_KINDS.
STAT_KINDS = {
    "Int": ("Int", "UInt"),
    "UInt": ("Int", "UInt"),
    "Float": ("Float",),
    "TimestampNs": ("TimestampNs", "Int"),
    "Bytes": ("String",),
}


def read_fill(t: DType, fill: Fill | None, honour_string: bool = False) -> Any:
    """The value of a cell that nobody wrote."""
    if t.stat == "Bytes":
        text = fill.value if honour_string and fill and fill.kind == "String" else ""
        return text if t.name == "string" else bytearray(text.encode())
    zero = 0.0 if t.stat == "Float" else 0
    if fill is None or fill.kind not in READ_KINDS[t.stat]:
        return zero
    if t.stat == "Float":
        return float(np.float32(fill.value)) if t.name == "float32" else float(fill.value)
    return _saturate(fill.value, t.bits) if fill.kind == "Float" else _wrap(int(fill.value), t.bits)


def stat_fill(t: DType, fill: Fill | None) -> Any | None:
    """The value counted as null in statistics, or None if no written cell counts as null."""
    kinds = ("Bool",) if t.name == "bool" else STAT_KINDS[t.stat]
    if fill is None or fill.kind not in kinds:
        return None
    if t.name == "bool":
        return bool(fill.value)
    if t.stat == "Bytes":
        return fill.value if t.name == "string" else bytearray(fill.value.encode())
    if t.stat == "Float":
        return float(np.float32(fill.value)) if t.name == "float32" else float(fill.value)
    return _wrap(int(fill.value), t.bits)


#: The scalar attribute kinds, and the field of the attribute struct that holds each; a list kind ends in "List".
ATTR_FIELDS = {"Bool": "bool", "Int8": "i", "Int16": "i", "Int32": "i", "Int64": "i", "UInt8": "u", "UInt16": "u", "UInt32": "u", "UInt64": "u", "Float32": "f", "Float64": "f", "String": "s", "Binary": "b"}
ATTR_KINDS = (*ATTR_FIELDS, *(f"{k}List" for k in ATTR_FIELDS))
ATTR_SCHEMA = (
    "struct<kind:string,i:bigint,u:decimal(20,0),f:double,s:string,b:binary,bool:boolean,"
    "il:array<bigint>,ul:array<decimal(20,0)>,fl:array<double>,sl:array<string>,bl:array<binary>,booll:array<boolean>>"
)


@dataclass(frozen=True)
class Attr:
    """A typed attribute value; equal only to the same kind, floats by bits."""

    kind: str
    value: Any

    def __post_init__(self) -> None:
        if self.kind not in ATTR_KINDS:
            raise ValueError(f"unknown attribute kind {self.kind!r}")

    @property
    def field(self) -> str:
        base = ATTR_FIELDS[self.kind.removesuffix("List")]
        return f"{base}l" if self.kind.endswith("List") else base

    def _key(self) -> Any:
        if self.kind.startswith("Float"):
            return [float_bits(x) for x in self.value] if self.kind.endswith("List") else float_bits(self.value)
        return list(self.value) if self.kind.endswith("List") else self.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Attr) and self.kind == other.kind and self._key() == other._key()

    __hash__ = None

    @staticmethod
    def of(value: Any) -> "Attr":
        """The kind that a plain Python value most naturally has."""
        if isinstance(value, Attr):
            return value
        if isinstance(value, (list, tuple)):
            return Attr(Attr.of(value[0]).kind + "List" if value else "StringList", list(value))
        for kind, types in (("Bool", bool), ("Int64", int), ("Float64", float), ("String", str), ("Binary", (bytes, bytearray))):
            if isinstance(value, types):
                return Attr(kind, value)
        raise TypeError(f"no attribute kind for {type(value).__name__}")

    def to_json(self) -> dict:
        one = {"b": lambda x: bytes(x).hex(), "f": lambda x: float_bits(x).hex()}.get(self.field[0] if self.field in ("b", "bl", "f", "fl") else "", lambda x: x)
        return {"kind": self.kind, "value": [one(x) for x in self.value] if self.kind.endswith("List") else one(self.value)}

    @staticmethod
    def from_json(x: dict) -> "Attr":
        base = x["kind"].removesuffix("List")
        one = bytes.fromhex if base == "Binary" else (lambda h: struct.unpack("<d", bytes.fromhex(h))[0]) if base.startswith("Float") else (lambda v: v)
        return Attr(x["kind"], [one(v) for v in x["value"]] if x["kind"].endswith("List") else one(x["value"]))

    def to_row(self) -> dict:
        """The struct of ATTR_SCHEMA, in which only the fields of this kind are set."""
        names = ("i", "u", "f", "s", "b", "bool", "il", "ul", "fl", "sl", "bl", "booll")
        one = (lambda x: Decimal(x)) if self.field in ("u", "ul") else (lambda x: bytearray(x)) if self.field in ("b", "bl") else (lambda x: x)
        value = [one(x) for x in self.value] if self.kind.endswith("List") else one(self.value)
        return {"kind": self.kind} | dict.fromkeys(names) | {self.field: value}
