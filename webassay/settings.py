"""Settings of an audit, from keywords or a command line, kept within sane bounds."""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass, fields

from webassay.functions.urls import normalize_target


@dataclass
class Settings:
    """What to crawl and how. Numbers out of bounds are moved to the nearest bound."""

    target: str = ""
    max_pages: int = 500
    max_depth: int = 5
    delay: float = 0.25
    include_subdomains: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rules: str = ""
    fail_on: str = "critical"

    #: Bounds.
    BOUNDS = {"max_pages": (1, 1_000_000), "max_depth": (0, 100), "delay": (0.0, 60.0)}

    def __post_init__(self) -> None:
        if self.target:
            self.target = normalize_target(self.target)
        for name, (low, high) in self.BOUNDS.items():
            setattr(self, name, min(high, max(low, getattr(self, name))))
        for pattern in (*self.include, *self.exclude):
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"{pattern!r} isn't a pattern: {e}") from e

    @classmethod
    def parser(cls) -> argparse.ArgumentParser:
        p = argparse.ArgumentParser(prog="webassay", description="Audit page records")
        p.add_argument("target", nargs="?", default="")
        p.add_argument("--pages", required=True, help="Parquet of page records: page_id, url, html and what else is known")
        p.add_argument("--out", required=True, help="folder for the reports")
        p.add_argument("--max-pages", type=int, default=cls.max_pages)
        p.add_argument("--max-depth", type=int, default=cls.max_depth)
        p.add_argument("--delay", type=float, default=cls.delay)
        p.add_argument("--include-subdomains", action="store_true")
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--rules", default="", help="JSON of further technology rules")
        p.add_argument("--fail-on", choices=("critical", "warning", "notice"), default=cls.fail_on)
        return p

    @classmethod
    def of(cls, args: argparse.Namespace) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if k in known})
