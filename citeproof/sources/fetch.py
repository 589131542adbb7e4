"""JSON over HTTP for the rows that a cache or a dimension could not answer: a client for each partition, with retries.

A client keeps its connections open as long as its partition runs.

Give it the narrow table of what is missing (see cache.read_through), never a wide one; how many requests run at once is
how many partitions it is dealt to.
"""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Answers that are tried again, and the answer that says there is no record.
RETRIED, MISSING = (429, 502, 503, 504), 404


@dataclass(frozen=True)
class Policy:
    retries: int = 3
    timeout_s: float = 12.0
    #: Least and most seconds to wait before another try; for a host that asks to slow down, and for one that fails.
    least_s: float = 0.5
    most_asked_s: float = 10.0
    most_failed_s: float = 8.0
    #: Seconds for one row with all its tries.
    total_s: float = 35.0


def backoff(attempt: int, most: float, policy: Policy, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds to wait after the attempt (from 0 on): drawn between the least and 2 ** attempt, `most` at most."""
    return draw(policy.least_s, max(policy.least_s, min(most, 2.0**attempt)))


def active_proxies() -> dict[str, str]:
    """The proxies of the environment or the system; a cluster sets them by spark.executorEnv.HTTPS_PROXY."""
    return urllib.request.getproxies()


def open_url(url: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body; the standard client, which heeds the proxies of the environment."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


class Client:
    """open_url with a connection for each host that stays open. Proxies and redirects are left to the standard client."""

    def __init__(self):
        self.kept: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def __call__(self, url: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
        at = urlsplit(url)
        if at.scheme in active_proxies() and not urllib.request.proxy_bypass(at.hostname or ""):
            return open_url(url, timeout)
        host = (at.scheme, at.netloc)
        if host not in self.kept:
            self.kept[host] = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc)
        connection = self.kept[host]
        connection.timeout = timeout
        try:
            if connection.sock is not None:
                connection.sock.settimeout(timeout)
            connection.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"Accept": "application/json"})
            answer = connection.getresponse()
            body = answer.read()
        except BaseException as e:
            # Whatever is left of an answer must not be taken for the next one.
            self.kept.pop(host).close()
            if isinstance(e, http.client.HTTPException):
                raise OSError(str(e)) from e
            raise
        if answer.status in (301, 302, 303, 307, 308):
            return open_url(url, timeout)
        return answer.status, dict(answer.headers), body

    def close(self) -> None:
        while self.kept:
            self.kept.popitem()[1].close()


class Pace:
    """Calls an opener no faster than so many times a second; retries count as well."""

    def __init__(self, opener: Callable, per_second: float | None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.opener, self.gap, self.sleep, self.clock = opener, 1 / per_second if per_second else 0.0, sleep, clock
        self.next = clock()

    def __call__(self, url: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.gap
        return self.opener(url, timeout)


def get_json(url: str, policy: Policy = Policy(), opener: Callable = open_url, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[str | None, str | None]:
    """(JSON text, failure): a text, or neither where there is no record, or why all tries failed."""
    began, failure = clock(), "NO_ANSWER"
    for attempt in range(policy.retries + 1):
        left = policy.total_s - (clock() - began)
        if left <= 0:
            return None, "TIMEOUT"
        try:
            status, headers, body = opener(url, min(policy.timeout_s, left))
        except (TimeoutError, OSError) as e:
            wait, failure = backoff(attempt, policy.most_failed_s, policy), "TIMEOUT" if isinstance(e, TimeoutError) else "NETWORK"
        else:
            if status == MISSING:
                return None, None
            if status not in RETRIED:
                if status >= 400:
                    return None, f"HTTP_{status}"
                try:
                    return json.dumps(json.loads(body)), None
                except ValueError:
                    return None, "NOT_JSON"
            asked = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            wait, failure = float(asked) if asked.isdigit() else backoff(attempt, policy.most_asked_s, policy), f"HTTP_{status}"
        if attempt < policy.retries:
            sleep(min(wait, max(0.0, policy.total_s - (clock() - began))))
    return None, failure


def fetch(requests: DataFrame, at_once: int = 5, policy: Policy = Policy(), opener: Callable | None = None, per_second: float | None = None) -> DataFrame:
    """(key, json, failure, ms) for requests (key, url), with `at_once` requests at a time; ms is what an answer took, with
    its retries and waits.

    per_second bounds the requests of all partitions together: each has an equal share of it. Keys are dealt by their hash,
    so that equal ones meet, and each is asked for once by a run of its partition. A result that is read several times, or
    whose partition is lost, is asked for again; cache.read_through writes it once.
    """
    share = per_second / at_once if per_second else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = opener or Client()
        paced = Pace(client, share)
        try:
            for batch in batches:
                answers, ms = [], []
                for u in batch["url"]:
                    began = time.perf_counter()
                    answers.append(get_json(u, policy, paced) if u else (None, "NO_URL"))
                    ms.append(1000 * (time.perf_counter() - began))
                rows = pd.DataFrame({"key": batch["key"], "json": [a for a, _ in answers], "failure": [f for _, f in answers]}, dtype=object)
                yield rows.assign(ms=pd.Series(ms, rows.index, float))
        finally:
            if isinstance(client, Client):
                client.close()

    return requests.select("key", "url").dropDuplicates(["key"]).repartition(at_once, "key").mapInPandas(run, "key string, json string, failure string, ms double")
