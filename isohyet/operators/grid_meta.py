"""What a regular grid is, apart from its values: a few numbers on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from isohyet.functions.missing import is_close


@dataclass(frozen=True)
class GridMeta:
    """Cell (y_idx, x_idx) has its centre at (y0 + y_idx * dy, x0 + x_idx * dx); dy is often negative. first: the least indices that exist."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int
    crs: int | None = None
    x_dim: str = "x"
    y_dim: str = "y"
    first: tuple[int, int] = (0, 0)

    @property
    def res(self) -> tuple[float, float]:
        return abs(self.dx), abs(self.dy)

    @property
    def shape(self) -> tuple[int, int]:
        return self.ny, self.nx

    def xs(self) -> list[float]:
        return [self.x0 + (self.first[1] + i) * self.dx for i in range(self.nx)]

    def ys(self) -> list[float]:
        return [self.y0 + (self.first[0] + i) * self.dy for i in range(self.ny)]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Outer edges of the cells."""
        xs, ys = self.xs(), self.ys()
        rx, ry = self.res
        return min(xs[0], xs[-1]) - rx / 2, min(ys[0], ys[-1]) - ry / 2, max(xs[0], xs[-1]) + rx / 2, max(ys[0], ys[-1]) + ry / 2

    def inside(self, minx: float, miny: float, maxx: float, maxy: float) -> GridMeta:
        """The part whose cell centres are in a closed box."""
        cols = [i for i, x in enumerate(self.xs()) if minx <= x <= maxx]
        rows = [i for i, y in enumerate(self.ys()) if miny <= y <= maxy]
        if not cols or not rows:
            return replace(self, nx=0, ny=0)
        return replace(self, nx=len(cols), ny=len(rows), first=(self.first[0] + rows[0], self.first[1] + cols[0]))

    def differences(self, other: GridMeta, tolerance: float = 1e-9) -> list[str]:
        """What is not equal, in words; empty if the grids agree."""
        found = []
        if self.crs != other.crs:
            found.append(f"CRS differs: {self.crs} and {other.crs}")
        if {self.x_dim, self.y_dim} != {other.x_dim, other.y_dim}:
            found.append(f"dimensions differ: {(self.y_dim, self.x_dim)} and {(other.y_dim, other.x_dim)}")
        if not all(is_close(a, b, 0.0, tolerance) for a, b in zip(self.res, other.res)):
            found.append(f"resolution differs: {self.res} and {other.res}")
        if self.shape != other.shape:
            found.append(f"coordinate shape differs: {self.shape} and {other.shape}")
        elif not all(is_close(a, b, 0.0, tolerance) for a, b in zip([*self.xs(), *self.ys()], [*other.xs(), *other.ys()])):
            found.append("coordinate values differ")
        return found

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> GridMeta:
        own = json.loads(text)
        return cls(**{**own, "first": tuple(own["first"])})

    def __str__(self) -> str:
        return f"grid {self.ny} x {self.nx}, resolution {self.res}, EPSG:{self.crs}"


class GridValidator:
    """Holds a grid against an expected one."""

    def __init__(self, expected: GridMeta, tolerance: float = 1e-9):
        self.expected, self.tolerance = expected, tolerance

    @classmethod
    def from_grid(cls, grid: GridMeta, tolerance: float = 1e-9) -> GridValidator:
        return cls(grid, tolerance)

    def validate(self, grid: GridMeta) -> GridMeta:
        if found := self.expected.differences(grid, self.tolerance):
            raise ValueError("; ".join(found))
        return grid
