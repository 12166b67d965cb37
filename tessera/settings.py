"""What a run does: limits of the crawl, filters, and how results are written."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from tessera.functions import patterns as P

#: Lowest and highest values that are allowed.
RANGES = {"max_depth": (1, 20), "max_pages": (1, None)}
FORMATS = ("csv", "json", "excel")
_SECRET = ("salesforce_password", "salesforce_token", "hubspot_api_key")


@dataclass(frozen=True)
class Settings:
    max_depth: int = 5
    max_pages: int = 1000
    user_agent: str = "*"
    output_format: str = "csv"
    output_dir: str = "results"
    output_file: str | None = None
    validate_emails: bool = False
    extract_social: bool = False
    allowed_domains: tuple[str, ...] = ()
    excluded_domains: tuple[str, ...] = ()
    excluded_extensions: tuple[str, ...] = P.EXCLUDED_EXTENSIONS
    ignore_robots_txt: bool = False
    salesforce_username: str | None = None
    salesforce_password: str | None = field(default=None, repr=False)
    salesforce_token: str | None = field(default=None, repr=False)
    hubspot_api_key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        for name, (least, most) in RANGES.items():
            value = getattr(self, name)
            if value < least or most is not None and value > most:
                raise ValueError(f"{name} has to be {least} or more" + (f", {most} at most" if most else ""))
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format has to be one of {', '.join(FORMATS)}")

    @classmethod
    def from_env(cls, prefix: str = "TESSERA_") -> Settings:
        """Settings from variables ``<prefix><NAME>``; lists are split at commas, and the depth is 3 where it isn't given."""
        found: dict = {"max_depth": 3}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper())
            if text is None:
                continue
            kind = str(f.type)
            if kind == "int":
                found[f.name] = int(text)
            elif kind == "bool":
                found[f.name] = text.lower() == "true"
            elif kind.startswith("tuple"):
                found[f.name] = tuple(x.strip() for x in text.split(",") if x.strip())
            else:
                found[f.name] = text
        return cls(**found)

    def __str__(self) -> str:
        shown = {f.name: "***" if f.name in _SECRET and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}
        return f"Settings({shown})"
