"""Writers of documents: checked, atomic, with a manifest last (K2-K8, V1, V4, V5)."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path


def canonical(value: object) -> str:
    """Compact JSON with sorted keys; not-a-number and infinity are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def check_shape(value: object, shape: object, where: str = "$") -> None:
    """Raise unless value has the shape: a dict of all keys and no other, a list of one shape, a type, or a tuple of types."""
    if isinstance(shape, dict):
        if not isinstance(value, dict) or set(value) != set(shape):
            raise ValueError(f"{where}: keys differ")
        for k, s in shape.items():
            check_shape(value[k], s, f"{where}.{k}")
    elif isinstance(shape, list):
        if not isinstance(value, list):
            raise ValueError(f"{where}: no list")
        for i, v in enumerate(value):
            check_shape(v, shape[0], f"{where}[{i}]")
    elif not isinstance(value, shape) or (isinstance(value, bool) and shape in (int, float)):
        raise ValueError(f"{where}: {type(value).__name__}")
    elif isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{where}: not finite")


def forbidden_fields(value: object, names: set[str]) -> list[str]:
    """The paths of keys at any depth that must not be published."""
    def walk(v: object, at: str) -> Iterable[str]:
        if isinstance(v, dict):
            for k, x in v.items():
                if k in names:
                    yield f"{at}.{k}"
                yield from walk(x, f"{at}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{at}[{i}]")

    return list(walk(value, "$"))


def write_atomic(path: Path, text: str, mode: int = 0o644) -> None:
    """A file is either its old or its new content, never a part."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(name, mode)
    os.replace(name, path)


def publish(folder: str | Path, documents: dict[str, object], shapes: dict[str, object], private: set[str] = frozenset()) -> None:
    """Check all documents, write all beside the old ones, then put each in place, then remove what isn't listed, the manifest last.

    Whatever fails before the first replacement leaves the folder as it was; a reader takes a folder only as its manifest has it.
    """
    folder = Path(folder)
    texts = {}
    for name, value in documents.items():
        check_shape(value, shapes[name])
        if bad := forbidden_fields(value, private):
            raise ValueError(f"{name}: {bad[0]}")
        texts[name] = canonical(value)
    folder.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=folder.parent) as stage:
        for name, text in texts.items():
            (Path(stage) / name).write_text(text, encoding="utf-8")
        for name in texts:
            os.replace(Path(stage) / name, folder / name)
    for old in folder.iterdir():
        if old.name not in texts and old.name != "manifest.json":
            old.unlink()
    files = [{"name": n, "sha256": hashlib.sha256(t.encode()).hexdigest()} for n, t in sorted(texts.items())]
    write_atomic(folder / "manifest.json", canonical({"status": "complete", "files": files}))


def append_line(path: str | Path, record: dict) -> None:
    """A line added to a ledger and on disk when this returns."""
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(canonical(record) + "\n")
        f.flush()
        os.fsync(f.fileno())


def create_csv(path: str | Path, header: list[str], rows: Iterable[Iterable[object]]) -> None:
    """A CSV file that must not be there yet."""
    with Path(path).open("x", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def private_folder(path: str | Path) -> Path:
    """A new folder that only its owner can read."""
    path = Path(path)
    path.mkdir(mode=0o700)
    return path
