"""Names of collections: from what a user gave, from file names, from addresses. Plain Python; one name at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_COUNT = re.compile(r"\s*\(\d+\)\s*$", re.ASCII)
_BLANK = " \t\n\x0b\f\r"
# Endings of a host's name that don't name it, and path parts that say nothing.
HOST_ENDINGS = ("project", "projects", "site", "online", "web")
PLAIN_PARTS = frozenset("index home default www html page pages wiki".split())
LONGEST = 40


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def display_name(raw: str | None) -> str:
    """Without a count in brackets at its end; blanks as one space."""
    return re.sub(rf"[{_BLANK}]+", " ", _COUNT.sub("", (raw or "").strip(_BLANK)).strip(_BLANK))


def token(raw: str | None) -> str:
    """Folded letters and digits, one '-' for each run of others, at most LONGEST characters."""
    return re.sub("[^a-z0-9]+", "-", _fold(_COUNT.sub("", (raw or "").strip(_BLANK)))).strip("-")[:LONGEST]


def without_ending(name: str) -> str:
    dot = name.rfind(".")
    return name[:dot] if dot > 0 else name


def file_name(path: str | None) -> str:
    """A file's own name as a token, without folders and ending."""
    return token(without_ending((path or "").replace("\\", "/").rpartition("/")[2]))


def host_name(host: str | None) -> str:
    """The first part of a host, without a general ending; "url" if nothing is left."""
    first = _fold((host or "").strip(_BLANK)).removeprefix("www.").removesuffix(".").partition(".")[0]
    for ending in HOST_ENDINGS:
        if len(first) > len(ending) + 2 and first.endswith(ending):
            first = first.removesuffix(ending)
            break
    return token(first) or "url"


def path_name(path: str | None) -> str:
    """The first part of a path that says something, as a token, or ''."""
    found = (token(without_ending(part)) for part in (path or "").split("/"))
    return next((t for t in found if t and t not in PLAIN_PARTS), "")


def address_name(host: str | None, path: str | None) -> str:
    """Host and path part, the latter only if it adds something."""
    own, part = host_name(host), path_name(path)
    return f"{own}-{part}" if part and part != own else own


def upload_name(requested: str | None, files: Iterable[str]) -> str:
    """What was asked for, else the name of the first file or first two different ones, else "upload"."""
    different = list(dict.fromkeys(n for n in map(file_name, files) if n))
    return display_name(requested) or "-".join(different[:2]) or "upload"


def free_name(wanted: str, kind: str, taken: Callable[[str], bool], now: str) -> str:
    """``wanted``, or with the first of -2 to -1000 that isn't taken, or with the time."""
    wanted = wanted if wanted.strip(_BLANK) else "url" if kind == "USER_URLS" else "upload"
    if not taken(wanted):
        return wanted
    return next((f"{wanted}-{n}" for n in range(2, 1001) if not taken(f"{wanted}-{n}")), f"{wanted}-{now}")
