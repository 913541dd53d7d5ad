"""Who may do what, and how often."""

from __future__ import annotations

import hashlib
import hmac
import time
from dataclasses import dataclass
from threading import Lock

PUBLIC, METRICS, WRITE, ADMIN = "public", "metrics", "write", "admin"
BURST = 30
#: Callers whose buckets are kept; those full again go first.
CALLERS = 10_000


class Refused(Exception):
    """A request without the right to be served: HTTP status, reason, seconds to wait."""

    def __init__(self, status: int, reason: str, wait: int = 0):
        super().__init__(reason)
        self.status, self.reason, self.wait = status, reason, wait


@dataclass(frozen=True)
class Keys:
    """Bearer tokens. Without a write and an admin key all is open; without an admin key
    the write key serves for both; without a metrics key metrics are open."""

    write: str | None = None
    admin: str | None = None
    metrics: str | None = None

    def caller(self, tier: str, authorization: str | None, address: str) -> str:
        """The caller's name for the limiter; raises Refused."""
        if tier == METRICS:
            if self.metrics is not None and not _same(self.metrics, self._token(authorization)):
                raise Refused(401, "invalid")
            return "metrics"
        if self.write is None and self.admin is None:
            return f"address {address}"
        token = self._token(authorization)
        # All comparisons are made, so that time tells nothing.
        is_admin, is_write = _same(self.admin, token), _same(self.write, token)
        if not (is_admin or is_write):
            raise Refused(401, "invalid")
        if tier == ADMIN and not is_admin and self.admin is not None:
            raise Refused(403, "forbidden")
        return f"key {hashlib.blake2b(token.encode(), digest_size=8).hexdigest()}"

    @staticmethod
    def _token(authorization: str | None) -> str:
        scheme, _, token = (authorization or "").partition(" ")
        if scheme not in ("Bearer", "bearer") or not token:
            raise Refused(401, "missing")
        return token


def _same(key: str | None, token: str) -> bool:
    own = hashlib.sha256((key or "").encode()).digest()
    return hmac.compare_digest(own, hashlib.sha256(token.encode()).digest()) and key is not None


class Limiter:
    """Token buckets by caller: ``rate`` requests a second, ``burst`` at once. No rate, no limit."""

    def __init__(self, rate: float | None, burst: int = BURST, clock=time.monotonic):
        self.rate, self.burst, self.clock = rate or 0, max(1, burst), clock
        self._held: dict[str, tuple[float, float]] = {}
        self._lock = Lock()

    def take(self, caller: str) -> None:
        if not self.rate:
            return
        with self._lock:
            now = self.clock()
            left, at = self._held.get(caller, (float(self.burst), now))
            left = min(self.burst, left + (now - at) * self.rate)
            if left < 1:
                raise Refused(429, "rate_limited", max(1, round((1 - left) / self.rate)))
            self._held[caller] = (left - 1, now)
            if len(self._held) > CALLERS:
                full = [c for c, (n, t) in self._held.items() if n + (now - t) * self.rate >= self.burst]
                for c in full or list(self._held)[: CALLERS // 2]:
                    del self._held[c]
