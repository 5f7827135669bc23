"""The commit log: numbered manifests of which the highest is the state of the store.

A manifest lists arrays, attributes, statistics and the Parquet parts of every
layer.  Arrays that were defined in bulk are rows of a table that it names.  Data are written first and a manifest last, under a number that must
be new, so a crash leaves unreferenced parts and two writers cannot both win.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from tessera.errors import CommitConflict, StoreFormatError
from tessera.sources.fs import HadoopFs

FORMAT = "tessera-manifest"
#: Version 2 has bulks; manifests of version 1 are read as they are.
VERSION = 2


@dataclass
class Part:
    """One write: chunk rows of one element type, with their index rows."""

    dtype: str
    data: str
    index: str


@dataclass
class Layer:
    number: int
    parts: list[Part] = field(default_factory=list)


@dataclass
class ArrayMeta:
    array_id: int
    name: str
    dtype: str
    shape: list[int]
    chunk: list[int]
    dims: list[str]
    fill: list | None
    seq: int
    attrs: dict[str, dict] = field(default_factory=dict)
    written: bool = False
    stats: dict | None = None


@dataclass
class Bulk:
    """Many one-dimensional arrays of one type: a Parquet table (array_id, name, length, chunk) whose ids lie from first to last."""

    dtype: str
    path: str
    first: int
    last: int
    fill: list | None
    written: bool = False
    entries: bool = False  # statistics hold all of them, not only the written ones


@dataclass
class State:
    number: int = 0
    generation: int = 0
    next_seq: int = 0
    layers: list[Layer] = field(default_factory=lambda: [Layer(0)])
    arrays: dict[str, ArrayMeta] = field(default_factory=dict)
    bulks: list[Bulk] = field(default_factory=list)
    #: Ids of bulk arrays that were deleted or have an entry of their own in `arrays`.
    taken: list[int] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT, "version": VERSION} | asdict(self))

    @staticmethod
    def from_json(text: str) -> "State":
        try:
            x = json.loads(text)
            if x.pop("format") != FORMAT:
                raise StoreFormatError("not a manifest of this store")
            if (v := x.pop("version")) not in (1, VERSION):
                raise StoreFormatError(f"manifest version {v} is not {VERSION}")
            layers = [Layer(y["number"], [Part(**p) for p in y["parts"]]) for y in x.pop("layers")]
            arrays = {k: ArrayMeta(**v) for k, v in x.pop("arrays").items()}
            bulks = [Bulk(**y) for y in x.pop("bulks", [])]
            return State(layers=layers, arrays=arrays, bulks=bulks, **x)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise StoreFormatError(f"damaged manifest: {e}") from e


def manifest_path(root: str, number: int) -> str:
    return f"{root}/manifests/{number:012d}.json"


def latest(fs: HadoopFs, root: str) -> int | None:
    found = [int(n[:-5]) for n in fs.names(f"{root}/manifests") if n.endswith(".json")]
    return max(found) if found else None


def load(spark: SparkSession, root: str) -> State:
    fs = HadoopFs(spark, root)
    number = latest(fs, root)
    if number is None:
        raise StoreFormatError(f"no store at {root}")
    return State.from_json(fs.read(manifest_path(root, number)))


def commit(fs: HadoopFs, root: str, state: State) -> None:
    if not fs.create(manifest_path(root, state.number), state.to_json()):
        raise CommitConflict(f"manifest {state.number} exists")
