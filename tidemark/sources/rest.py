"""How a paged API is read: the cursor, the end and the retries of one run of pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator


class RateLimited(Exception):
    """The server asks for a pause; the request is not tried again here."""


def pages(call: Callable[[int], list[list]], start_ms: int, end_ms: int, interval_ms: int, retries: int = 5, pause: Callable[[float], None] = time.sleep) -> Iterator[list[list]]:
    """Batches from start_ms on: the cursor moves to the last opening time plus the interval; an empty batch or a cursor
    that stands still ends it. The last batch may reach past end_ms. Network errors are tried again after 1 to 10 seconds."""
    cursor = start_ms
    while cursor < end_ms:
        for attempt in range(retries):
            try:
                batch = call(cursor)
                break
            except (ConnectionError, TimeoutError):
                if attempt == retries - 1:
                    raise
                pause(min(10.0, 2.0**attempt))
        if not batch:
            return
        yield batch
        after = int(batch[-1][0]) + interval_ms
        if after <= cursor:
            return
        cursor = after
