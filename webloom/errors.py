"""The engine's errors, each with a stable code."""

from __future__ import annotations


class WebloomError(Exception):
    code = "ERROR"


class NetworkError(WebloomError):
    code = "NETWORK_ERROR"


class TimeoutExceeded(WebloomError):
    code = "TIMEOUT"


class ParseError(WebloomError):
    code = "PARSE_ERROR"


class ValidationError(WebloomError):
    code = "VALIDATION_ERROR"


class SecurityBlocked(WebloomError):
    code = "SECURITY_BLOCKED"


class CircuitOpen(WebloomError):
    code = "CIRCUIT_OPEN"


class RobotsDisallowed(WebloomError):
    code = "ROBOTS_DISALLOWED"


class DuplicateContent(WebloomError):
    code = "DUPLICATE_CONTENT"


class Blocked(WebloomError):
    """A response that a block verdict names; the verdict's fields are at hand."""

    code = "BLOCKED"

    def __init__(self, verdict: dict, url: str | None = None) -> None:
        name = verdict.get("vendor_name") or verdict.get("vendor") or "unknown"
        status = f" HTTP {verdict['status']}" if verdict.get("status") else ""
        super().__init__(f"{name} {verdict.get('kind') or 'block'} detected{status}" + (f" for {url}" if url else ""))
        self.verdict, self.url, self.retryable = verdict, url, verdict.get("retryable", True)
