"""Canonical keys and edge-kind normalisation."""

from __future__ import annotations

import re

#: Schemes whose keys must be well formed (fixed value).
SCHEMES = ("csharp", "xaml", "js", "ts", "jsx", "tsx", "c", "cpp", "proto")
_KEY = re.compile(r"^([a-z]+):([A-Za-z][A-Za-z0-9-]*):(\S.*)$")
_KEBAB = re.compile(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")
#: Edge kinds that are known whether or not an edge has them (fixed value).
EDGE_KINDS = (
    "calls", "inherits", "implements", "uses-type", "overrides-member", "implements-member", "instantiates", "throws", "references", "reads", "writes", "binds-to", "handles-event",
    "command-executes", "grpc-calls", "implements-rpc", "rpc-dispatches-to", "pinvoke-maps-to", "struct-maps-to", "tests", "binds-path", "uses-resource", "applies-style",
)
#: Accessibility names (fixed value).
ACCESSIBILITY = {"private": 1, "private protected": 2, "protected": 3, "internal": 4, "protected internal": 5, "public": 6}
SEVERITIES = {"hidden": 0, "info": 1, "warning": 2, "error": 3}


def is_canonical_key(text: str) -> bool:
    """Well formed ``scheme:kind:rest`` of a known scheme."""
    found = _KEY.match(text)
    return bool(found) and found[1] in SCHEMES


def claims_scheme(text: str) -> bool:
    """The text begins like a key of a known scheme."""
    return text.split(":", 1)[0] in SCHEMES and ":" in text


def require_intent(text: str) -> bool:
    """Whether the text must be matched as an exact key; a malformed key of a known scheme is an
    error, never a fuzzy search."""
    if not claims_scheme(text):
        return False
    if not is_canonical_key(text):
        raise ValueError(f"malformed canonical key: {text}")
    return True


def is_kebab(text: str) -> bool:
    return bool(_KEBAB.match(text))


def edge_kind(text: str | None, vocabulary: frozenset | set = frozenset()) -> str | None:
    """Normalised kind; None for all kinds.  Unknown kinds are an error unless no kind is known."""
    if text is None:
        return None
    kind = text.strip().lower().replace("_", "-")
    if kind in ("", "all", "any", "*"):
        return None
    kind = {"overrides": "overrides-member", "implements": "implements-member"}.get(kind, kind)
    if vocabulary and kind not in vocabulary:
        raise ValueError(f"unknown edge kind: {text}; known: {', '.join(sorted(vocabulary))}")
    return kind


def accessibility_code(text: str | None) -> int | None:
    if text is None or not text.strip():
        return None
    name = " ".join(text.strip().lower().replace("-", " ").replace("_", " ").split())
    if name not in ACCESSIBILITY:
        raise ValueError(f"unknown accessibility: {text}")
    return ACCESSIBILITY[name]


def severity_code(text: str | None) -> int:
    if text is None:
        return 0
    if text.strip().lower() not in SEVERITIES:
        raise ValueError(f"unknown severity: {text}")
    return SEVERITIES[text.strip().lower()]
