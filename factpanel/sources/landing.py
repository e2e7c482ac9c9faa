"""Fetching documents into a landing folder: a small driver-side tool, not a Spark source.

Spark reads what has landed.  The opener is a parameter, so tests need no network.  Requests are
polite (a pause after each), failures that may pass are tried again with growing pauses, and what has
landed is not fetched again.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

Opener = Callable[[str], bytes]
#: Answers after which another try may do better.
PASSING = {429, 500, 502, 503, 504}


def open_url(user_agent: str, timeout: float = 30.0) -> Opener:
    def get(url: str) -> bytes:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent, "Accept": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()

    return get


def fetch(url: str, opener: Opener, *, tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The document; after a passing failure up to ``tries`` times with pauses of 1, 2, 4 ... times ``pause``."""
    for n in range(tries):
        try:
            return opener(url)
        except urllib.error.HTTPError as error:
            if error.code not in PASSING or n == tries - 1:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if n == tries - 1:
                raise
        sleep(pause * 2**n)
    raise AssertionError("unreachable")


@dataclass
class Landed:
    """What a run of ``land`` did."""

    fetched: int = 0
    skipped: int = 0
    missing: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def land(keys: Iterable[str], url_of: Callable[[str], str], folder: str | Path, opener: Opener, *, polite: float = 0.1, sleep: Callable[[float], None] = time.sleep, indent: int | None = None) -> Landed:
    """Fetches CIK{key}.json for keys that have none yet; a 404 is counted, other failures noted."""
    folder, done = Path(folder), Landed()
    folder.mkdir(parents=True, exist_ok=True)
    for key in keys:
        path = folder / f"CIK{key}.json"
        if path.exists():
            done.skipped += 1
            continue
        try:
            body = json.loads(fetch(url_of(key), opener, sleep=sleep))
            part = path.with_suffix(".part")
            part.write_text(json.dumps(body, indent=indent, ensure_ascii=False), encoding="utf-8")
            part.replace(path)  # a broken run leaves no half a document
            done.fetched += 1
        except urllib.error.HTTPError as error:
            if error.code == 404:
                done.missing.append(key)
            else:
                done.errors[key] = str(error)
        except (OSError, ValueError) as error:
            done.errors[key] = str(error)
        finally:
            sleep(polite)
    return done


def rename_plain(folder: str | Path) -> int:
    """Names {ten digits}.json as CIK{ten digits}.json where that name is free; how many."""
    renamed = 0
    for path in sorted(Path(folder).glob("*.json")):
        target = path.with_name(f"CIK{path.name}")
        if re.fullmatch(r"\d{10}\.json", path.name) and not target.exists():
            path.rename(target)
            renamed += 1
    return renamed


def landed_keys(folder: str | Path) -> list[str]:
    return sorted(m[1] for p in Path(folder).glob("CIK*.json") if (m := re.fullmatch(r"CIK(\d{10})\.json", p.name)))
