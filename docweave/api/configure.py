"""Which storage engine and language version a repository has."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Iterator

from docweave.compat import CompatProfile
from docweave.errors import ConfigurationError
from docweave.sources.store import ENGINES, Store

_FILE = "docweave.json"
_pinned: str | None = None


def provide_storage(name: str, engine: type[Store]) -> None:
    """Register a storage engine of one's own under a name."""
    if not issubclass(engine, Store):
        raise TypeError("an engine is a subclass of Store")
    ENGINES[name] = engine


def find_storage(name: str) -> type[Store]:
    if name not in ENGINES:
        raise ConfigurationError(f"unknown storage engine {name!r}; known are {sorted(ENGINES)}")
    return ENGINES[name]


def set_storage(repository: str | None = None, storage: str | None = None, version: str | None = None, **settings) -> None:
    """Write the settings of a repository; they hold for clients opened later."""
    repository = repository or current_repository()
    if repository == ":memory:":
        return
    found = read_settings(repository)
    if storage is not None:
        find_storage(storage)
        if found.get("storage", storage) != storage and any(n != _FILE for n in os.listdir(repository)):
            raise ConfigurationError(f"the repository holds data of engine {found['storage']!r}")
        found["storage"] = storage
    if version is not None:
        CompatProfile.of(version)
        found["version"] = version
    found.update(settings)
    os.makedirs(repository, exist_ok=True)
    with open(os.path.join(repository, _FILE), "w") as out:
        json.dump(found, out, indent=1)


def read_settings(repository: str) -> dict:
    path = os.path.join(repository.removeprefix("file://"), _FILE)
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def pin_repo(repository: str) -> None:
    """The repository of clients that name none."""
    global _pinned
    _pinned = repository


def current_repository() -> str:
    return _pinned or os.getcwd()


@contextlib.contextmanager
def open_repo(repository: str) -> Iterator[str]:
    """Within the block, clients that name no repository use this one."""
    global _pinned
    before, _pinned = _pinned, repository
    try:
        yield repository
    finally:
        _pinned = before
