"""Archives over HTTP: listings page by page, and files fetched by the tasks that read them."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Answers after which asking again is of use.
PASSING = {408, 425, 429, 500, 502, 503, 504}


def fetch(url: str, *, tries: int = 4, timeout: float = 60.0, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The content of a URL; None if there is none (404), which is an answer and not a failure.

    Failures that can pass are tried again after twice the pause each time; the last one is raised.
    """
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in PASSING or k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
        sleep(pause * 2**k)
    raise ValueError("at least one try is needed")


def listing(bucket: str, prefix: str, *, delimiter: str | None = None, get: Callable[[str], bytes | None] = fetch) -> Iterator[str]:
    """Keys under a prefix of a listing in the usual XML form, or with a delimiter the folders right under it, page by page."""
    marker = ""
    while True:
        asked = {"prefix": prefix, "marker": marker} | ({"delimiter": delimiter} if delimiter else {})
        body = get(f"{bucket}?{urllib.parse.urlencode(asked)}")
        if body is None:
            return
        page = ET.fromstring(body)
        text = lambda node, tag: next((c.text or "" for c in node if c.tag.rsplit("}", 1)[-1] == tag), "")
        kind, tag = ("CommonPrefixes", "Prefix") if delimiter else ("Contents", "Key")
        keys = [text(n, tag) for n in page if n.tag.rsplit("}", 1)[-1] == kind]
        yield from keys
        following = text(page, "NextMarker") or (keys[-1] if keys else "")
        if text(page, "IsTruncated") != "true" or following in ("", marker):
            return
        marker = following


def fetched(urls: DataFrame, url: str = "url", **how) -> DataFrame:
    """(path, content) of the URLs that have content; each task fetches its own, so no file passes through the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u in pdf["path"]:
                body = fetch(u, **how)
                if body is not None:
                    yield pd.DataFrame({"path": [u], "content": [body]})

    return urls.selectExpr(f"`{url}` AS path").mapInPandas(run, schema="path string, content binary")
