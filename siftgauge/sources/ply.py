"""Point-cloud files as a Python data source: format "ply".

Read: one element `vertex` of floats, little-endian or as text; a binary file is split into ranges of rows.  Options: path, rows_per_split.
Write: one file per partition under the path, with normals of 0, in the order of the rows; mode overwrite replaces the folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

REST = 45
COLUMNS = ["x", "y", "z", "opacity", *(f"f_dc_{k}" for k in range(3)), *(f"scale_{k}" for k in range(3)), *(f"rot_{k}" for k in range(4))]
SCHEMA = "gaussian_id long, " + ", ".join(f"{c} float" for c in COLUMNS) + ", f_rest array<float>"
#: Vertex order of the file format.
ORDER = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{k}" for k in range(REST)), "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, place


def header(path: str) -> tuple[int, list[str], int, bool]:
    """(rows, property names, first byte of the body, whether it is text)."""
    store, place = _open(path)
    with store.open_input_file(place) as f:
        head = f.read(65_536)
    end = head.find(b"end_header\n")
    lines = head[: max(end, 0)].decode("ascii", "replace").split("\n")
    if end < 0 or lines[0] != "ply" or not {"format binary_little_endian 1.0", "format ascii 1.0"} & set(lines):
        raise ValueError(f"{path} is no text or little-endian PLY file")
    rows = next(int(x.split()[2]) for x in lines if x.startswith("element vertex "))
    names = [x.split()[2] for x in lines if x.startswith("property float ")]
    missing = [c for c in COLUMNS if c not in names]
    if missing or sum(n.startswith("scale_") for n in names) != 3 or sum(n.startswith("rot_") for n in names) != 4:
        raise ValueError(f"{path} lacks {missing} or has other than 3 scales and 4 rotations")
    return rows, names, end + len(b"end_header\n"), "format ascii 1.0" in lines


class Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class PlyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("rows_per_split", 1_000_000))
        self.rows, self.names, self.body, self.text = header(self.path)

    def partitions(self):
        if self.text:  # lines have no fixed length
            return [Range(0, self.rows)]
        return [Range(a, min(a + self.step, self.rows)) for a in range(0, max(self.rows, 1), self.step)]

    def read(self, part):
        store, place = _open(self.path)
        width = 4 * len(self.names)
        with store.open_input_file(place) as f:
            if self.text:
                rows = np.array(f.read()[self.body :].split(), np.float32).reshape(-1, len(self.names))[: part.hi]
            else:
                data = f.read_at((part.hi - part.lo) * width, self.body + part.lo * width)
                rows = np.frombuffer(data, "<f4").reshape(-1, len(self.names))
        column = {n: rows[:, k].copy() for k, n in enumerate(self.names)}
        norm = np.maximum(np.sqrt(sum(column[f"rot_{k}"].astype(np.float64) ** 2 for k in range(4))), 1e-8)
        for k in range(4):
            column[f"rot_{k}"] = (column[f"rot_{k}"] / norm).astype(np.float32)
        rest = sorted((n for n in self.names if n.startswith("f_rest_")), key=lambda n: int(n.rsplit("_", 1)[1]))
        each = len(rest) // 3
        wide = np.zeros((len(rows), REST), np.float32)
        for k, n in enumerate(rest):  # channel-major, padded to degree 3
            wide[:, (k // each) * (REST // 3) + k % each] = column[n]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * REST, pa.int32()), pa.array(wide.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.lo, part.hi)), *(pa.array(column[c]) for c in COLUMNS), listed], ["gaussian_id", *COLUMNS, "f_rest"])


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        store, place = _open(self.path)
        from pyarrow import fs

        if store.get_file_info(place).type != fs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{self.path} exists; write with mode overwrite")
            store.delete_dir(place)

    def write(self, iterator):
        """Rows in the order in which they come; `f_rest` channel after channel, or coefficient after coefficient if nested so."""
        from pyspark import TaskContext

        parts = []
        for batch in iterator:
            out = np.zeros((batch.num_rows, len(ORDER)), "<f4")
            for c in COLUMNS:
                out[:, ORDER.index(c)] = batch.column(c).to_numpy(zero_copy_only=False)
            rest = [np.asarray(r, np.float32) for r in batch.column("f_rest").to_pylist()]
            for k, r in enumerate(rest):
                flat = (r.T if r.ndim == 2 and r.shape[1] == 3 else r).ravel()
                out[k, ORDER.index("f_rest_0") : ORDER.index("f_rest_0") + len(flat)] = flat
            at = ORDER.index("rot_0")
            out[:, at : at + 4] /= np.maximum(np.linalg.norm(out[:, at : at + 4], axis=1, keepdims=True), 1e-8)
            parts.append(out.tobytes())
        rows = sum(map(len, parts)) // (4 * len(ORDER))
        head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {rows}\n" + "".join(f"property float {c}\n" for c in ORDER) + "end_header\n"
        store, place = _open(self.path)
        store.create_dir(place, recursive=True)
        name = f"{place}/part-{TaskContext.get().partitionId():05d}.ply"
        with store.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}") as f:
            f.write(head.encode())
            for part in parts:
                f.write(part)
        store.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        return WriterCommitMessage()


class PlyDataSource(DataSource):
    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PlyReader(dict(self.options))

    def writer(self, schema, overwrite):
        return PlyWriter(dict(self.options), overwrite)
