"""A polite client for sources that are fetched: spaced requests, bounded retries. The transport is given, so that a
harvest can be tested without a network."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

#: transport(url, params) gives (status, headers, body) or raises OSError.
Transport = Callable[[str, Mapping[str, str]], tuple[int, Mapping[str, str], bytes]]


class Spacing:
    """At most one request in `seconds`, over all threads that share it."""

    def __init__(self, seconds: float = 3.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.lock, self.free = seconds, clock, sleep, threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            delay = max(0.0, self.free - now)
            self.free = max(now, self.free) + self.seconds
        if delay:
            self.sleep(delay)


class FetchError(OSError):
    pass


@dataclass
class PoliteClient:
    transport: Transport
    spacing: Spacing
    attempts: int = 5
    shortest: float = 1.0
    longest: float = 20.0

    def get(self, url: str, params: Mapping[str, str] | None = None) -> bytes:
        """The body of a 200; 429, 5xx and transport errors are tried again, after Retry-After or a growing pause."""
        last = ""
        for n in range(self.attempts):
            self.spacing.wait()
            pause = min(self.longest, self.shortest * 2**n) * (0.5 + random.random() / 2)
            try:
                status, headers, body = self.transport(url, params or {})
            except OSError as e:
                last = str(e)
            else:
                if status == 200:
                    return body
                last = f"status {status}"
                if status != 429 and status < 500:
                    break
                after = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
                pause = min(60.0, float(after)) if after.replace(".", "", 1).isdigit() else pause
            if n + 1 < self.attempts:
                self.spacing.sleep(pause)
        raise FetchError(f"{url}: {last}")
