import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks.zarr import chunk_length, export_zarr
from isohyet.sources.raster import open_raster
from isohyet.sources.zarr import open_group, read_axis, read_cells, read_cube
from tests.test_cube import DAYS, META, dataset, values, writer


def test_store_as_the_format_says(spark, tmp_path):
    """The files, decoded here by the public format's rules alone."""
    cube, data = writer(tmp_path / "c"), dataset(spark)
    cube.write(data, META)
    store = tmp_path / "out.zarr"
    export_zarr(spark, cube, str(store))
    every = json.loads((store / ".zmetadata").read_text())["metadata"]
    for name, own in every.items():
        assert json.loads((store / name).read_text()) == own
    assert every[".zattrs"]["crs"] == 4326
    own = every["tas/.zarray"]
    assert (own["shape"], own["chunks"], own["dtype"], own["fill_value"], own["compressor"]["id"]) == ([10, 4, 5], [1, 2, 2], "<f8", "NaN", "zstd")
    whole = np.full((10, 4, 6), np.nan)
    for t in range(10):
        for y in range(2):
            for x in range(3):
                if (f := store / "tas" / f"{t}.{y}.{x}").exists():
                    blob = pa.Codec("zstd").decompress(f.read_bytes(), 32, asbytes=True)
                    whole[t, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = np.array(struct.unpack("<4d", blob)).reshape(2, 2)
    want = np.full((10, 4, 6), np.nan)
    for r in data.filter("var = 'tas'").collect():
        want[DAYS.index(r.time), r.y_idx, r.x_idx] = r.value
    np.testing.assert_array_equal(whole, want)
    seconds = struct.unpack("<10q", pa.Codec("zstd").decompress((store / "time" / "0").read_bytes(), 80, asbytes=True))
    assert seconds[0] == 1735689600 and {b - a for a, b in zip(seconds, seconds[1:])} == {86400}
    assert not [p for p in (store / "tas").glob(".*") if p.name not in (".zarray", ".zattrs") and p.suffix != ".crc"]  # nothing unfinished


def test_round_trip(spark, tmp_path):
    cube, data = writer(tmp_path / "c", dtype="int16", scale_factor=0.1, fill_value=-9999), dataset(spark).filter("(y_idx + x_idx) % 3 > 0")
    cube.write(data, META)
    export_zarr(spark, cube, str(tmp_path / "out.zarr"))
    with pytest.raises(ValueError, match="exists"):
        export_zarr(spark, cube, str(tmp_path / "out.zarr"))
    export_zarr(spark, cube, str(tmp_path / "out.zarr"), overwrite=True)
    got, want = values(read_cube(spark, str(tmp_path / "out.zarr"))), {k: v for k, v in values(cube.read(spark)).items() if v is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cube_without_cells(spark, tmp_path):
    cube = writer(tmp_path / "c", chunks=None)
    cube.create(spark, META)
    export_zarr(spark, cube, str(tmp_path / "out.zarr"))
    assert read_cube(spark, str(tmp_path / "out.zarr")).count() == 0


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="no cube"):
        export_zarr(spark, writer(tmp_path / "none"), str(tmp_path / "out.zarr"))
    whole = writer(tmp_path / "whole", dtype="int16")
    whole.create(spark, META)
    with pytest.raises(ValueError, match="fill value"):
        export_zarr(spark, whole, str(tmp_path / "out.zarr"))
    with pytest.raises(ValueError, match="chunks"):
        chunk_length(5, (1, 2, 2))
    assert chunk_length(5, (2, 2, 1)) == 2 and chunk_length(900, None) == 512
    with pytest.raises(ValueError, match="no Zarr group"):
        open_group(spark, str(tmp_path))


def store_3(path, values, codecs, pack, consolidated):
    """A store of version 3 with one array in chunks of 2 x 3, one chunk of which has no file."""
    ny, nx = values.shape

    def array(name, own, chunks, dims, codecs, attributes=None):
        return {"zarr_format": 3, "node_type": "array", "shape": list(own.shape), "data_type": own.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": codecs, "attributes": attributes or {}, "dimension_names": dims}

    plain = [{"name": "bytes", "configuration": {"endian": "little"}}]
    lat, lon = 47.0 - 0.5 * np.arange(ny), 10.0 + 0.25 * np.arange(nx)
    own = {"height": array("height", values, [2, 3], ["lat", "lon"], codecs), "lat": array("lat", lat, [ny], ["lat"], plain), "lon": array("lon", lon, [nx], ["lon"], plain)}
    group = {"zarr_format": 3, "node_type": "group", "attributes": {"crs": 4326}}
    if consolidated:
        group["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": own}
    path.mkdir()
    (path / "zarr.json").write_text(json.dumps(group))
    for name, content in own.items():
        (path / name / "c").mkdir(parents=True)
        (path / name / "zarr.json").write_text(json.dumps(content))
    (path / "lat/c/0").write_bytes(lat.tobytes()), (path / "lon/c/0").write_bytes(lon.tobytes())
    for y in range(-(-ny // 2)):
        (path / f"height/c/{y}").mkdir()
        for x in range(-(-nx // 3)):
            if (y, x) != (0, 1):
                block = np.full((2, 3), np.nan)
                part = values[2 * y : 2 * y + 2, 3 * x : 3 * x + 3]
                block[: part.shape[0], : part.shape[1]] = part
                (path / f"height/c/{y}/{x}").write_bytes(pack(block.astype(values.dtype).tobytes()))


@pytest.mark.parametrize("codec", ["plain", "zstd", "gzip", "big"])
def test_version_3(spark, tmp_path, codec):
    own = np.arange(35, dtype="float32").reshape(5, 7)
    endian = [{"name": "bytes", "configuration": {"endian": "big" if codec == "big" else "little"}}]
    gzip = zlib.compressobj(wbits=31)
    packs = {
        "plain": (endian, lambda b: b), "zstd": (endian + [{"name": "zstd", "configuration": {"level": 0, "checksum": False}}], lambda b: pa.Codec("zstd").compress(b, asbytes=True)),
        "gzip": (endian + [{"name": "gzip", "configuration": {"level": 5}}], lambda b: (c := gzip.copy()).compress(b) + c.flush()), "big": (endian, lambda b: np.frombuffer(b, "<f4").astype(">f4").tobytes()),
    }
    store_3(tmp_path / "dem.zarr", own, *packs[codec], consolidated=codec == "zstd")
    cells, meta = open_raster(spark, str(tmp_path / "dem.zarr"))
    assert meta == GridMeta(10.0, 47.0, 0.25, -0.5, 7, 5, 4326, "lon", "lat")
    got = {(r.y_idx, r.x_idx): r.value for r in cells.collect()}
    assert got == {(y, x): None if y < 2 and 3 <= x < 6 else float(own[y, x]) for y in range(5) for x in range(7)}
    assert cells.filter("y <> 47.0 - 0.5 * y_idx OR x <> 10.0 + 0.25 * x_idx").count() == 0


def test_unreadable_codecs(spark, tmp_path):
    store_3(tmp_path / "dem.zarr", np.zeros((2, 3)), [{"name": "sharding_indexed"}], bytes, consolidated=False)
    with pytest.raises(ValueError, match="codecs"):
        open_raster(spark, str(tmp_path / "dem.zarr"))


def test_raster_of_an_exported_day(spark, tmp_path):
    cube = writer(tmp_path / "c", end="2025-01-01", variables=["tas"])
    data = dataset(spark, DAYS[:1]).filter("var = 'tas'")
    cube.write(data, META)
    export_zarr(spark, cube, str(tmp_path / "day.zarr"))
    cells, meta = open_raster(spark, str(tmp_path / "day.zarr"), "tas")
    assert meta.shape == META.shape and meta.crs == 4326
    want = {(r.y_idx, r.x_idx): r.value for r in data.collect()}
    assert {(r.y_idx, r.x_idx): r.value for r in cells.collect()} == want
    arrays, _ = open_group(spark, str(tmp_path / "day.zarr"))
    assert read_axis(spark, arrays["x"]) == META.xs()
    assert read_cells(spark, arrays["tas"]).agg(F.count("*")).first()[0] == 20
