"""Fetching and caching catalogs, on the driver.

A cached payload is fresh while its age is at most the ttl.  Offline, or when
a fetch fails or yields no usable price, a cached payload of any age serves.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from .catalogs import PARSERS, Catalog

TTL_MS, FETCH_SECONDS = 3_600_000, 10.0
#: The public catalogs, by format: name and address
PUBLIC = {
    "openrouter": ("openrouter", "https://openrouter.ai/api/v1/models"),
    "litellm": ("litellm", "https://raw.githubusercontent.com/BerriAI/litellm/main/model_prices_and_context_window.json"),
    "models.dev": ("models-dev", "https://models.dev/api.json"),
}


def default_cache_dir(env: dict[str, str] | None = None, home: str | None = None, platform: str = sys.platform) -> Path:
    """Where this operating system keeps caches; empty variables are unset."""
    env, base = dict(os.environ) if env is None else env, Path(home or Path.home())
    if platform == "win32":
        return (Path(env["LOCALAPPDATA"]) if env.get("LOCALAPPDATA") else base / "AppData" / "Local") / "quillmeter" / "cache"
    if env.get("XDG_CACHE_HOME"):
        return Path(env["XDG_CACHE_HOME"]) / "quillmeter"
    return base / ("Library/Caches" if platform == "darwin" else ".cache") / "quillmeter"


def usable(kind: str, payload: object) -> bool:
    """A payload with at least one price."""
    return bool(PARSERS[kind](payload))


def fetch_json(url: str) -> object:
    """A catalog from its address; an endpoint that stalls must not hang a run."""
    with urllib.request.urlopen(url, timeout=FETCH_SECONDS) as answer:  # noqa: S310  fixed https addresses
        return json.load(answer)


@dataclass
class Source:
    kind: str
    fetch: Callable[[], object]
    name: str = ""

    def __post_init__(self) -> None:
        self.name = self.name or (PUBLIC[self.kind][0] if self.kind in PUBLIC else self.kind)


def public_sources(fetch: Callable[[str], object] = fetch_json) -> list[Source]:
    return [Source(kind, lambda url=url: fetch(url), name) for kind, (name, url) in PUBLIC.items()]


@dataclass
class Loader:
    """Loads sources in order and keeps the result until ttl; the clock counts epoch milliseconds.

    ``refresh`` holds for the first load alone: it passes over fresh caches.  A
    load that fails is not kept, and the next one still refreshes the sources
    that have not completed their refresh.
    """

    sources: list[Source]
    cache_dir: Path
    ttl_ms: int = TTL_MS
    offline: bool = False
    first: list[Catalog] = field(default_factory=list)
    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    refresh: bool = False
    _held: list[Catalog] | None = None
    _at: int = 0
    _refreshed: set[int] = field(default_factory=set)

    def _file(self, source: Source) -> Path:
        return self.cache_dir / f"pricing-{source.name}.json"

    def _cached(self, source: Source) -> tuple[object, int, str] | None:
        try:
            data = json.loads(self._file(source).read_text())
            stamp = data["fetchedAt"]
            at = int(datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp() * 1000)
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return None
        return (data.get("payload"), at, stamp) if usable(source.kind, data.get("payload")) else None

    def _store(self, source: Source, payload: object, stamp: str) -> None:
        try:
            self.cache_dir.mkdir(parents=True, exist_ok=True)
            fd, name = tempfile.mkstemp(dir=self.cache_dir)
            with os.fdopen(fd, "w") as f:
                json.dump({"fetchedAt": stamp, "payload": payload}, f)
            os.replace(name, self._file(source))
        except OSError:
            return  # an unwritable cache only costs the next fetch

    def load_one(self, source: Source, refresh: bool = False) -> Catalog | None:
        def catalog(payload: object, stamp: str) -> Catalog:
            return Catalog(source.name, PARSERS[source.kind](payload), stamp)

        cached, now = self._cached(source), self.clock()
        if cached and (self.offline or (not refresh and now - cached[1] <= self.ttl_ms)):
            return catalog(cached[0], cached[2])
        if self.offline:
            return None
        try:
            payload = source.fetch()
        except Exception:  # noqa: BLE001  any failed fetch falls back to the cache
            payload = None
        if payload is not None and usable(source.kind, payload):
            stamp = datetime.fromtimestamp(now / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            self._store(source, payload, stamp)
            return catalog(payload, stamp)
        return catalog(cached[0], cached[2]) if cached else None

    def catalogs(self) -> list[Catalog]:
        if self._held is None or self.clock() - self._at >= self.ttl_ms:
            self._held, found = None, list(self.first)
            for k, source in enumerate(self.sources):
                again = self.refresh and k not in self._refreshed
                one = self.load_one(source, again)
                if again:
                    self._refreshed.add(k)
                if one is not None:
                    found.append(one)
            self._held, self._at, self.refresh = found, self.clock(), False
        return self._held
