"""Options of the two commands, their defaults and their ranges."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: The defaults and ranges that a caller of the original command line relies on.
EXTENSIONS = "jpg,jpeg"
HASH_SIZES, FREQ_FACTORS, LOG_LEVELS, THRESHOLDS = (5, 11), (1, 8), (1, 4), (0, 64)


def parse_extensions(text: str) -> list[str]:
    """Extensions of a comma-separated list: without white space and dots, lower case, the first of equal ones."""
    cleaned = ("".join(c for c in part if not c.isspace() and c != ".").lower() for part in text.split(","))
    return list(dict.fromkeys(x for x in cleaned if x))


def checked_directory(path: str) -> str:
    if not path:
        raise ValueError("no directory given")
    if not os.path.isdir(path):
        raise ValueError(f"not a directory: {path}")
    return os.path.realpath(path)


def _within(name: str, value: int, bounds: tuple[int, int]) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must be {bounds[0]} to {bounds[1]}, not {value}")


@dataclass(frozen=True)
class HashOptions:
    """How planes are hashed. transform and median: 'reference' or 'forward', 'true' (see functions.numeric)."""

    hash_size: int = 8
    freq_factor: int = 4
    transform: str = "reference"
    median: str = "true"

    def __post_init__(self):
        _within("hash size", self.hash_size, HASH_SIZES)
        _within("frequency factor", self.freq_factor, FREQ_FACTORS)
        if self.transform not in ("reference", "forward") or self.median not in ("true", "reference"):
            raise ValueError("unknown transform or median")

    @property
    def plane(self) -> int:
        return self.hash_size * self.freq_factor

    @property
    def bits(self) -> int:
        return self.hash_size**2


@dataclass(frozen=True)
class CommandOptions:
    directory: str
    command: str = "hash"
    extensions: str = EXTENSIONS
    recursive: bool = False
    batch_size: int = 500
    threads: int = -1
    prefetch_factor: int = 8
    log_level: int = 4
    hash_size: int = 8
    freq_factor: int = 4
    output: str = ""
    threshold: int = 5
    num_tables: int = 32
    bits_per_table: int = 8
    auto_delete: bool = False
    interactive: bool = False
    print_only: bool = False
    dry_run: bool = False
    pairs: str = "exact"

    def __post_init__(self):
        object.__setattr__(self, "directory", checked_directory(self.directory))
        _within("hash size", self.hash_size, HASH_SIZES)
        _within("log level", self.log_level, LOG_LEVELS)
        for name in ("batch_size", "prefetch_factor", "freq_factor", "num_tables", "bits_per_table"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.threads != -1 and self.threads <= 0:
            raise ValueError("threads must be -1 or positive")
        if self.command == "similar":
            _within("threshold", self.threshold, THRESHOLDS)
            if self.auto_delete and self.interactive:
                raise ValueError("auto-delete and interactive exclude each other")

    @property
    def extension_list(self) -> list[str]:
        return parse_extensions(self.extensions)

    def hashing(self) -> HashOptions:
        return HashOptions(self.hash_size, self.freq_factor)
