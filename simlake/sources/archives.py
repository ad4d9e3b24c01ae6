"""Fetching and unpacking corpora on the driver, before anything is distributed; and the driver's log."""

from __future__ import annotations

import logging.config
import shutil
import tarfile
import urllib.request
import zipfile
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

CHUNK = 8 << 10


def fetch(url: str, to: str | Path, chunk: int = CHUNK) -> Path:
    """Downloads in chunks to a file that gets its name only when complete; a failed answer is an error. Needs a network."""
    to = Path(to)
    part = to.with_name(to.name + ".part")
    with urllib.request.urlopen(url) as answer, part.open("wb") as out:  # noqa: S310  an HTTP error raises
        shutil.copyfileobj(answer, out, chunk)
    return part.rename(to)


def fetch_all(urls: Iterable[str], folder: str | Path) -> list[Path]:
    """Several downloads at a time, each unpacked if it is an archive."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    with ThreadPoolExecutor(3) as pool:
        files = list(pool.map(lambda u: fetch(u, folder / u.rsplit("/", 1)[-1]), urls))
    for f in files:
        unpack(f, folder)
    return files


def unpack(archive: str | Path, folder: str | Path) -> bool:
    """Unpacks a zip or tar file; members that would leave the folder are an error. False for other files."""
    archive, folder = Path(archive), Path(folder).resolve()
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if not (folder / name).resolve().is_relative_to(folder):
                    raise ValueError(f"{name} would leave the folder")
            z.extractall(folder)
        return True
    if tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
        return True
    return False


def set_up_logging(folder: str | Path, level: str = "INFO", size: int = 1 << 20, keep: int = 3) -> None:
    """Messages of this package to the console and to a rotating file; the folder is made here, not on import."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    handlers = {
        "console": {"class": "logging.StreamHandler", "formatter": "plain"},
        "file": {"class": "logging.handlers.RotatingFileHandler", "filename": str(Path(folder) / "simlake.log"), "maxBytes": size, "backupCount": keep, "formatter": "plain"},
    }
    logging.config.dictConfig({"version": 1, "disable_existing_loggers": False, "formatters": {"plain": {"format": "%(asctime)s %(name)s %(levelname)s %(message)s"}}, "handlers": handlers, "loggers": {"simlake": {"handlers": list(handlers), "level": level}}})
