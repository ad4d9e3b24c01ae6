"""Nested records as HDF5 files on the driver, for exchange with other tools; tables belong in Parquet (records). h5py is imported when a file is touched, and only then."""

from __future__ import annotations

from types import ModuleType

import numpy as np


def _h5py() -> ModuleType:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 files need h5py; records.save_record writes the same record as Parquet") from e
    return h5py


def _plain(value: object, h5py: ModuleType) -> object:
    """What a dataset holds: strings and lists of them as UTF-8, numbers and arrays as they are; a TypeError for others."""
    if isinstance(value, str | bytes):
        return np.array([value], dtype=h5py.string_dtype(encoding="utf-8"))
    if isinstance(value, bool | int | float | np.generic):
        return value
    if isinstance(value, list | tuple | np.ndarray):
        array = np.array(value)
        if array.dtype.kind in "US":
            return array.astype(h5py.string_dtype(encoding="utf-8"))
        if array.dtype.kind in "iufb":
            return array
    raise TypeError(f"values of type {type(value).__name__} can't be stored")


def save(record: dict, path: str) -> None:
    """A mapping of numbers, strings, arrays, lists and such mappings; a mapping becomes a group."""
    h5py = _h5py()

    def fill(group: object, part: dict) -> None:
        for name, value in part.items():
            if isinstance(value, dict):
                fill(group.create_group(name), value)
            else:
                group.create_dataset(name, data=_plain(value, h5py))

    with h5py.File(path, "w") as f:
        fill(f, record)


def load(path: str) -> dict:
    """The mapping of a file: groups as mappings, scalars as numbers, texts as strings, attributes beside what they describe."""
    h5py = _h5py()

    def read(group: object) -> dict:
        out = {}
        for name, value in group.items():
            if hasattr(value, "items"):
                out[name] = read(value)
            else:
                out[name] = value.asstr()[...] if h5py.check_string_dtype(value.dtype) else value[()]
        return out | dict(group.attrs.items())

    with h5py.File(path, "r") as f:
        return read(f)
