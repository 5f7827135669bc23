"""Coordinate arithmetic between cells, chunks and row-major linear indexes.

Plans address a chunk by its row-major ordinal, a scalar that Parquet can
prune on, and a cell by its position in the clipped chunk.  The functions
return SQL text with shapes as literals, so that Catalyst folds constants and
whole-stage codegen compiles the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import prod


def grid_of(shape: Sequence[int], chunk: Sequence[int]) -> list[int]:
    """Chunks along each axis; the last may be clipped."""
    return [-(-s // c) if c else 0 for s, c in zip(shape, chunk, strict=True)]


def strides(extents: Sequence[int]) -> list[int]:
    return [prod(extents[k + 1 :]) for k in range(len(extents))]


def chunk_coord_sql(shape: Sequence[int], chunk: Sequence[int], ord_col: str = "chunk_ord") -> list[str]:
    grid = grid_of(shape, chunk)
    return [f"(({ord_col} div {max(1, st)}L) % {max(1, g)}L)" for g, st in zip(grid, strides(grid), strict=True)]


def extent_sql(shape: Sequence[int], chunk: Sequence[int], ord_col: str = "chunk_ord") -> list[str]:
    """Clipped extent of a chunk along each axis."""
    return [f"least({c}L, {s}L - {cc} * {c}L)" for s, c, cc in zip(shape, chunk, chunk_coord_sql(shape, chunk, ord_col), strict=True)]


def chunk_len_sql(shape: Sequence[int], chunk: Sequence[int], ord_col: str = "chunk_ord") -> str:
    return " * ".join(extent_sql(shape, chunk, ord_col)) or "1L"


def cell_coords_sql(shape: Sequence[int], chunk: Sequence[int], ord_col: str = "chunk_ord", pos_col: str = "pos") -> list[str]:
    """d_k of the cell at a position of a chunk."""
    coords, extents = chunk_coord_sql(shape, chunk, ord_col), extent_sql(shape, chunk, ord_col)
    out = []
    for k, (c, cc) in enumerate(zip(chunk, coords, strict=True)):
        below = " * ".join(extents[k + 1 :]) or "1L"
        out.append(f"({cc} * {c}L + ({pos_col} div ({below})) % {extents[k]})")
    return out


def cell_to_chunk_sql(shape: Sequence[int], chunk: Sequence[int], dims: Sequence[str]) -> tuple[str, str]:
    """(chunk ordinal, position in the clipped chunk) of a cell."""
    grid = grid_of(shape, chunk)
    ord_sql = " + ".join(f"({d} div {max(1, c)}L) * {st}L" for d, c, st in zip(dims, chunk, strides(grid), strict=True)) or "0L"
    extents = [f"least({c}L, {s}L - ({d} div {max(1, c)}L) * {c}L)" for s, c, d in zip(shape, chunk, dims, strict=True)]
    pos = " + ".join(f"({d} % {max(1, c)}L) * {' * '.join(extents[k + 1 :]) or '1L'}" for k, (d, c) in enumerate(zip(dims, chunk, strict=True))) or "0L"
    return ord_sql, pos


def overlapping(shape: Sequence[int], chunk: Sequence[int], start: Sequence[int], stop: Sequence[int]) -> tuple[list[range], int]:
    """Chunk index ranges along each axis that a region meets, and how many chunks that is."""
    axes = [range(a // c, -(-b // c)) if b > a and c else range(0) for c, a, b in zip(chunk, start, stop, strict=True)]
    return axes, prod(len(r) for r in axes)


def ordinals(shape: Sequence[int], chunk: Sequence[int], axes: Sequence[range]) -> list[int]:
    st = strides(grid_of(shape, chunk))
    return [sum(c * s for c, s in zip(cs, st, strict=True)) for cs in product(*axes)]


def ordinal_filter(shape: Sequence[int], chunk: Sequence[int], axes: Sequence[range], most: int = 256) -> str:
    """A predicate on chunk_ord for those chunks: a list where it is short, else bounds that Parquet prunes on plus axis tests."""
    count = prod(len(r) for r in axes)
    if not axes:
        return "chunk_ord = 0"
    if count == 0:
        return "false"
    if count <= most:
        return f"chunk_ord in ({', '.join(f'{o}L' for o in ordinals(shape, chunk, axes))})"
    st = strides(grid_of(shape, chunk))
    low, high = (sum(r[i] * s for r, s in zip(axes, st, strict=True)) for i in (0, -1))
    tests = [f"{cc} between {r[0]}L and {r[-1]}L" for cc, r, g in zip(chunk_coord_sql(shape, chunk), axes, grid_of(shape, chunk), strict=True) if len(r) < g]
    return " and ".join([f"chunk_ord between {low}L and {high}L", *tests])


def ordinal_of_rank_sql(shape: Sequence[int], chunk: Sequence[int], axes: Sequence[range], rank: str = "id") -> str:
    """Ordinal of the i-th overlapping chunk in row-major order, for building the chunk grid with spark.range."""
    st, below = strides(grid_of(shape, chunk)), strides([len(r) for r in axes])
    return " + ".join(f"({r[0] if len(r) else 0}L + ({rank} div {max(1, b)}L) % {max(1, len(r))}L) * {s}L" for r, b, s in zip(axes, below, st, strict=True)) or "0L"
