"""Runtime settings: which providers are configured, and whether uploads may be taken.

Which variables configure a provider is the deployment's business: the caller says so,
as a mapping from a role to the names of its variables.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions import vocab

#: Roles that a deployment names variables for. The first two make storage durable; ``hosted`` marks a shared deployment.
ROLES = ("database", "storage", "hosted", "parser", "ai")
DURABLE = ROLES[:2]
#: What serves a role that is configured, and what does otherwise.
SERVED = {"database": ("external", "local-json"), "storage": ("external", "local-filesystem"), "parser": ("hosted", "local-layout-parser"), "ai": ("hosted-model", "local-heuristic")}


@dataclass(frozen=True)
class Readiness:
    deployment: str
    status: str
    uploads_enabled: bool
    missing: tuple[str, ...]
    summary: str
    detail: str


@dataclass(frozen=True)
class Settings:
    """Settings read from a mapping of environment variables; empty values do not count."""

    env: Mapping[str, str]
    names: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    max_upload_mb: int = vocab.MAX_UPLOAD_MB
    chunk_target_tokens: int = vocab.CHUNK_TARGET_TOKENS
    vector_dimensions: int = vocab.VECTOR_DIMENSIONS

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, names: Mapping[str, tuple[str, ...]] | None = None) -> Settings:
        env, names = {k: v for k, v in (os.environ if env is None else env).items() if v}, dict(names or {})
        if unknown := set(names) - set(ROLES):
            raise ValueError(f"unknown roles: {', '.join(sorted(unknown))}")
        numbers = {}
        for name, key in (("max_upload_mb", "MAX_UPLOAD_MB"), ("chunk_target_tokens", "CHUNK_TARGET_TOKENS"), ("vector_dimensions", "VECTOR_DIMENSIONS")):
            if key in env:
                try:
                    numbers[name] = int(env[key])
                except ValueError as e:
                    raise ValueError(f"Invalid environment configuration: {key} is no number") from e
        return cls(env, names, **numbers)

    def has(self, role: str) -> bool:
        """Is one of the role's variables set?"""
        return any(n in self.env for n in self.names.get(role, ()))

    @property
    def hosted(self) -> bool:
        return self.has("hosted")

    @property
    def durable(self) -> bool:
        return all(map(self.has, DURABLE))

    @property
    def inline_ingestion(self) -> bool:
        return not self.durable

    def capabilities(self) -> dict[str, str]:
        return {role: own if self.has(role) else other for role, (own, other) in SERVED.items()}

    def readiness(self) -> Readiness:
        wanted = {role: " or ".join(self.names.get(role, ())) or role for role in DURABLE}
        if not self.hosted:
            return Readiness("local", "ready", True, (), "Local mode: files and tables stay on this machine.", f"Durable storage needs {' and '.join(wanted.values())}.")
        missing = tuple(wanted[role] for role in DURABLE if not self.has(role))
        if missing:
            return Readiness("hosted", "setup-required", False, missing, "Uploads are off until durable storage is configured.", f"Set {' and '.join(missing)}.")
        return Readiness("hosted", "ready", True, (), "Durable storage is configured.", "Scanned files and hosted answers need their own keys.")

    def require_uploads(self) -> None:
        state = self.readiness()
        if not state.uploads_enabled:
            raise RuntimeError(f"{state.summary} Missing: {', '.join(state.missing)}.")
