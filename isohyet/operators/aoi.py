"""Area of interest: a box in a coordinate system, as a range predicate that reaches the Parquet scan."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions import proj
from isohyet.operators.grid_meta import GridMeta


@dataclass(frozen=True)
class AOI:
    minx: float
    miny: float
    maxx: float
    maxy: float
    crs: int = 4326

    def __post_init__(self) -> None:
        if self.minx > self.maxx or self.miny > self.maxy:
            raise ValueError("the box's minimum is above its maximum")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.minx, self.miny, self.maxx, self.maxy

    def to_crs(self, epsg: int, densify: int = 0) -> AOI:
        """The box around the transformed corners: lower left and upper right, or with densify > 0 so many points on each side too."""
        if epsg == self.crs:
            return self
        points = [(self.minx, self.miny), (self.maxx, self.maxy)]
        for i in range(densify + 1 if densify else 0):
            x, y = self.minx + (self.maxx - self.minx) * i / densify, self.miny + (self.maxy - self.miny) * i / densify
            points += [(x, self.miny), (x, self.maxy), (self.minx, y), (self.maxx, y)]
        xs, ys = zip(*(proj.transform(x, y, self.crs, epsg) for x, y in points))
        return AOI(min(xs), min(ys), max(xs), max(ys), epsg)

    def buffer(self, metres: float) -> AOI:
        """The box with each side moved out. Degrees are converted at the box's centre, on distances and azimuths from it."""
        if not proj.is_geographic(self.crs):
            return AOI(self.minx - metres, self.miny - metres, self.maxx + metres, self.maxy + metres, self.crs)
        lon, lat = (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2

        def moved(x: float, y: float, by: float) -> tuple[float, float]:
            distance, azimuth = proj.geodesic(lon, lat, x, y)
            east, north = distance * math.sin(azimuth) + by, distance * math.cos(azimuth) + by
            return proj.travel(lon, lat, math.hypot(east, north), math.atan2(east, north))

        (x0, y0), (x1, y1) = moved(self.minx, self.miny, -metres), moved(self.maxx, self.maxy, metres)
        return AOI(x0, y0, x1, y1, self.crs)

    def _in(self, crs: int | None) -> AOI:
        if crs is None:
            raise ValueError("the data has no CRS")
        return self.to_crs(crs)

    def filter_points(self, points: DataFrame, crs: int | None, x: str = "x", y: str = "y") -> DataFrame:
        """Points in the closed box."""
        box = self._in(crs)
        return points.filter(F.col(x).between(box.minx, box.maxx) & F.col(y).between(box.miny, box.maxy))

    def filter_grid(self, cells: DataFrame, meta: GridMeta, buffer_m: float = 0.0, touched: bool = True) -> tuple[DataFrame, GridMeta]:
        """Cells whose centre is in the box; with touched, those too that the box only touches (half a cell more)."""
        box = self._in(meta.crs)
        box = box.buffer(buffer_m) if buffer_m else box
        more_x, more_y = (meta.res[0] / 2, meta.res[1] / 2) if touched else (0.0, 0.0)
        kept = cells.filter(F.col("x").between(box.minx - more_x, box.maxx + more_x) & F.col("y").between(box.miny - more_y, box.maxy + more_y))
        return kept, meta.inside(box.minx - more_x, box.miny - more_y, box.maxx + more_x, box.maxy + more_y)

    def filter(self, data, meta_or_crs, **options):
        """Grids (with GridMeta) and points (with an EPSG code)."""
        if isinstance(meta_or_crs, GridMeta):
            return self.filter_grid(data, meta_or_crs, **options)
        if meta_or_crs is None or isinstance(meta_or_crs, int):
            return self.filter_points(data, meta_or_crs, **options)
        raise ValueError(f"can't filter by a {type(meta_or_crs).__name__}")
