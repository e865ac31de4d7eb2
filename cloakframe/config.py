"""Settings of the engine: plain values that become literals of a plan."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and switches; `pii_off` takes entity types and the aliases in `TYPE_ALIASES`."""

    trace_high: float = 0.85
    trace_low: float = 0.60
    guard_threshold: float = 0.70
    fallback_threshold: float = 0.65
    guard_enabled: bool = True
    fuzzy_threshold: float = 85.0
    rag_top_k: int = 3
    chunk_size: int = 512
    pii_off: tuple[str, ...] = ()
    #: Folder of persistent sessions (shared by all machines of a cluster); None: sessions are kept by the caller.
    state_dir: str | None = None
    #: Key of the surrogates: who knows it can confirm a guessed original. Another one for each configuration unless given.
    salt: str = field(default_factory=lambda: os.urandom(16).hex())

    def __post_init__(self) -> None:
        if self.state_dir is not None and not os.path.isdir(self.state_dir):
            raise ValueError(f"state_dir is not a directory: {self.state_dir}")

    def with_options(self, **options: object) -> EngineConfig:
        unknown = set(options) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return replace(self, **options)


TYPE_ALIASES: dict[str, tuple[str, ...]] = {
    "bank": ("us_bank_number",),
    "crypto": ("crypto",),
    "facility": ("FAC",),
    "license": ("us_driver_license",),
    "location": ("GPE", "LOC"),
    "name": ("PERSON",),
    "names": ("PERSON",),
    "org": ("ORG",),
    "phone": ("phone_intl", "phone_uk", "phone_us"),
    "postal_code": ("postcode_uk", "zip_us"),
    "postcode": ("postcode_uk",),
    "zip": ("zip_us",),
}


def expand_types(names: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    return tuple(sorted({t for n in names for t in TYPE_ALIASES.get(n, (n,))}))


@dataclass
class Preferences:
    """Persisted display settings; a damaged or missing file gives the defaults."""

    values: dict[str, object] = field(default_factory=dict)

    DEFAULTS = {"detailed_view": True, "show_surrogates": True, "auto_approve": True}

    @classmethod
    def load(cls, path: str) -> Preferences:
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            found = {}
        return cls({**cls.DEFAULTS, **(found if isinstance(found, dict) else {})})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=2)
