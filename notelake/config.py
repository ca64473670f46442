"""Settings from the environment: where notes and the index lie, and the models' names."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    vault: str = "."
    store: str = ""
    embedder: str = "hashing-64"
    reranker: str = "overlap"
    log_level: str = "WARNING"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **given: str | None) -> Config:
        """NOTELAKE_VAULT, NOTELAKE_STORE, ... ; what is given counts before that. The store defaults to a hidden folder in the vault."""
        env = os.environ if env is None else env
        known = {f: given.get(f) or env.get(f"NOTELAKE_{f.upper()}") or getattr(cls, f) for f in cls.__dataclass_fields__}
        known["store"] = known["store"] or known["vault"].rstrip("/") + "/.notelake"
        return cls(**known)

    @property
    def reranking(self) -> bool:
        return self.reranker not in ("", "off", "none")
