import gzip
import struct

import numpy as np

from voxloom.sources import files, vendor


def test_gzipped_slices(spark):
    head = b"<ScanID> s1 </ScanID><VolSizeX>3</VolSizeX><VolSizeY>2</VolSizeY><VoxelSize>0,25</VoxelSize>"
    part = lambda v: gzip.compress(np.array(v, dtype="<u2").tobytes())
    rows = [("a/x_vol_0", gzip.compress(head)), ("a/x_vol_0_002", part([7] * 6)), ("a/x_vol_0_001", part([1, 2, 3, 65535])), ("b/y_vol_0", head), ("b/y_vol_0_001", part([1])), ("b/y_vol_0_003", part([1])), ("c/z_vol_0_001", part([1]))]
    e = spark.createDataFrame(rows, "path string, content binary")
    h = {r["folder"]: r for r in vendor.slice_folders(e).collect()}
    assert (h["a"]["scan_id"], h["a"]["width"], h["a"]["height"], h["a"]["depth"], h["a"]["sx"], h["a"]["error"]) == ("s1", 3, 2, 2, 0.25, None)
    assert (h["b"]["error"], h["c"]["error"]) == ("E_SLICE_GAP", "E_HEADER")
    got = sorted((r["z"], np.frombuffer(r["pixels"], "<i2").tolist()) for r in vendor.slice_folder_slices(e, vendor.slice_folders(e)).collect())
    assert got == [(0, [1, 2, 3, -1, 0, 0]), (1, [7] * 6)]
    assert {r["folder"]: r["format"] for r in files.folder_formats(e).collect()} == {"a": "galileos", "b": "galileos"}


def test_single_file(spark):
    xml = b'<a><tfXGridSize value="0,5"/><tfYGridSize>0.5</tfYGridSize><tfZGridSize>0.5</tfZGridSize><tfSystemV2HuSlope>50</tfSystemV2HuSlope><tfSystemV2HuIntercept>-1</tfSystemV2HuIntercept></a>'
    raw = np.arange(4 * 3 * 2, dtype="<i2")
    raw[5] = -32768
    data = b"\0" * 4 + vendor.MARKER + struct.pack("<I", len(xml)) + xml + struct.pack("<I", 8) + vendor.ARRAY_NAME + struct.pack("<6i", -2, 1, 0, 2, 0, 1) + raw.tobytes()
    f = spark.createDataFrame([("d/CT_0.vol", data)], "path string, content binary")
    v = np.stack([np.frombuffer(r["pixels"], "<i2").reshape(r["height"], r["width"]) for r in vendor.single_file_slices(f).orderBy("z").collect()])
    assert v.shape == (2, 3, 4) and v[1, 2, 0] == -32768 and v[0, 1, 3] == raw[0 + 2 * 1 + 6 * 3] * 2 - 100
    c = spark.createDataFrame([("d", "<dXX>1.0</dXX><dYY>1,5</dYY><dZZ>1</dZZ>")], "folder string, xml string")
    r = vendor.single_file_slices(f, c).orderBy("z").collect()
    assert (len(r), r[0]["width"], r[0]["height"]) == (2, 2, 3)
    assert np.frombuffer(r[0]["pixels"], "<i2")[0] == raw[6] * 2 - 100  # the corner moves by the asymmetry
