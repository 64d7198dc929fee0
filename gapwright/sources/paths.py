"""Where a sample's image lies, and where a corpus lies."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: folder of images by convention
IMAGE_FOLDER = "images_plain_768x384"


def image_path(given: Column, root: Column, split: Column, stem: Column) -> Column:
    """An absolute path as given; a relative one under ``root``; none or an empty one by convention. Null where a root is needed and missing."""
    own = F.nullif(given, F.lit(""))
    return F.when(own.startswith("/"), own).when(own.isNotNull(), F.concat(root, F.lit("/"), own)).otherwise(F.concat(root, F.lit(f"/{IMAGE_FOLDER}/"), split, F.lit("/"), stem, F.lit(".png")))


def corpus_root(start: str, name: str | None = None) -> str:
    """The folder with split files: ``start/name``, ``start`` itself, or its only child that has them; else an error."""
    has = lambda p: any((p / f"{s}.json").exists() for s in ("train", "val", "test"))
    base = Path(start)
    if name:
        if has(base / name):
            return str(base / name)
        raise FileNotFoundError(f"{base / name} has no split files")
    if has(base):
        return str(base)
    found = [p for p in sorted(base.iterdir()) if p.is_dir() and has(p)] if base.is_dir() else []
    if len(found) != 1:
        raise FileNotFoundError(f"{base}: {len(found)} folders have split files")
    return str(found[0])
