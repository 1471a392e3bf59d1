"""The fetch stage: plain HTTP that lands raw responses. Nothing of it runs inside Spark."""

from __future__ import annotations

import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator


class RateLimiter:
    """Lets requests start at least 60 / per_minute seconds apart, in the order in which they ask."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if not per_minute > 0:
            raise ValueError(f"requests per minute must be positive, not {per_minute}")
        self.gap, self.clock, self.sleep, self.free, self.lock = 60 / per_minute, clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            start = max(self.free, now)
            self.free = start + self.gap
        if start > now:
            self.sleep(start - now)


def get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


def worth_retrying(error: Exception) -> bool:
    """Too many requests, a server's own faults and network faults; not other refusals."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def fetch(url: str, limiter: RateLimiter, retries: int = 3, timeout: float = 20, read: Callable[[str, float], str] = get, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text at a URL; retries wait half a second, doubled each time up to eight, and a little more."""
    for attempt in range(retries + 1):
        limiter.wait()
        try:
            return read(url, timeout)
        except Exception as error:
            if attempt == retries or not worth_retrying(error):
                raise
            sleep(min(8.0, 0.5 * 2**attempt) + random.random() * 0.25)  # noqa: S311
    raise AssertionError


class Hosts:
    """Tries hosts in turn and goes on with the one that answered last."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.good = names, ""

    def ask(self, ask: Callable[[str], str]) -> str:
        failed: Exception | None = None
        for host in sorted(self.names, key=lambda h: h != self.good):
            try:
                text = ask(host)
            except Exception as error:  # noqa: BLE001  the next host may answer
                failed = error
                self.good = "" if host == self.good else self.good
            else:
                self.good = host
                return text
        raise failed or ValueError("no hosts")


def pages(page: Callable[[int], str], count: Callable[[str], int], size: int = 100, most: int = 300, total: Callable[[str], int] = lambda body: 0) -> Iterator[tuple[int, str]]:
    """(number, body) of listing pages, until one is short or as many entries have come as the listing says it has."""
    seen = 0
    for k in range(1, most + 1):
        body = page(k)
        n = count(body)
        if n:
            yield k, body
        seen += n
        if n < size or 0 < total(body) <= seen:
            return


def backwards(page: Callable[[str], str], earliest: Callable[[str], tuple[int, str]], start: str, size: int = 640, most: int = 8) -> Iterator[tuple[int, str]]:
    """(number, body) of pages that end at ever earlier days. earliest: a page's rows and first day (yyyyMMdd)."""
    from datetime import datetime, timedelta

    end = "2099-12-31"
    for k in range(most):
        body = page(end)
        yield k, body
        n, first = earliest(body)
        if n < size or not first or first <= start:
            return
        end = (datetime.strptime(first, "%Y%m%d") - timedelta(days=1)).strftime("%Y-%m-%d")
