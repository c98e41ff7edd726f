"""Bytes from local files and HTTP, with limits."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path, PurePosixPath
from urllib.parse import urlparse
from urllib.request import Request, urlopen

#: What fetches an address: (url, timeout, most bytes) to (bytes, content type). Tests put another in its place.
Transport = Callable[[str, int, int], tuple[bytes, str]]
CHUNK = 256 * 1024


def http_get(url: str, timeout: int = 30, most_bytes: int = 1 << 62) -> tuple[bytes, str]:
    """GET an address; stops as soon as the announced or the received size is above the limit."""
    with urlopen(Request(url, headers={"User-Agent": "lexistrata"}), timeout=timeout) as answer:  # noqa: S310
        announced = int(answer.headers.get("content-length") or 0)
        if announced > most_bytes:
            raise RuntimeError(too_large(most_bytes))
        body = bytearray()
        while chunk := answer.read(CHUNK):
            body += chunk
            if len(body) > most_bytes:
                raise RuntimeError(too_large(most_bytes))
        return bytes(body), answer.headers.get("content-type", "")


def too_large(most_bytes: int) -> str:
    """What is said of a resource above the limit."""
    return f"resource exceeds {most_bytes >> 20} MB"


def local_path(url: str) -> Path | None:
    """The file that an address without a host names, if there is one."""
    parsed = urlparse(url)
    for candidate in [url, *([parsed.path] if parsed.scheme == "file" else [])]:
        try:
            if Path(candidate).is_file():
                return Path(candidate)
        except (OSError, ValueError):
            continue
    return None


def load(url: str, *, timeout: int = 30, most_bytes: int = 1 << 62, get: Transport = http_get) -> tuple[bytes, str]:
    """Bytes of a local file or of an address, and where they are: a path, or the address's file name."""
    path = local_path(url)
    if path is not None:
        if path.stat().st_size > most_bytes:
            raise RuntimeError(too_large(most_bytes))
        return path.read_bytes(), str(path)
    return get(url, timeout, most_bytes)[0], safe_stem(url)


def safe_name(value: str) -> str:
    """A file name of at most 80 plain characters."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", value).strip("_")[:80] or "record"


def safe_stem(url: str) -> str:
    """The plain name of the file that an address ends in, without its ending."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", PurePosixPath(urlparse(url).path).stem or "resource")[:80]
