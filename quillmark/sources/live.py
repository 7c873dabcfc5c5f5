"""Proposals from a local helper over HTTP. Off unless it is asked for; nothing leaves the machine.

Each request is sent by the task that holds its row. Before it is sent a marker is made in
a shared spool folder, and the answer is put beside it, so a task that runs again hands on
the answer that is there and asks for none twice: a request whose marker stands without an
answer was cut off in between and is reported as such. Speculative copies of a task would
see the marker of the first one; leave ``spark.speculation`` off.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.vocabulary import LOOPBACK_HOSTS, REQUEST_SECONDS

ROUTE = "/v1/proposals"
#: More of an answer than this is not read; it is malformed.
MOST_BYTES = 16 << 20
_OUT = pa.schema([("request_id", pa.string()), ("outcome", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("message", pa.string())])


def local_url(url: str) -> str:
    """The URL's origin with the route; an error unless its host is a loopback one."""
    parts = urlsplit(url)
    host = f"[{parts.hostname}]" if ":" in (parts.hostname or "") else parts.hostname
    if parts.scheme not in ("http", "https") or host not in LOOPBACK_HOSTS or parts.username or parts.password:
        raise ValueError(f"proposals are asked of a loopback URL only, not of {url}")
    return f"{parts.scheme}://{parts.netloc}{ROUTE}"


class _Here(urllib.request.HTTPRedirectHandler):
    """Redirects are refused, as they may lead off the machine."""

    def redirect_request(self, *_):
        return None


def ask(url: str, body: str, token: str | None, seconds: float = REQUEST_SECONDS) -> tuple[str, int | None, str | None, str | None]:
    """(outcome, HTTP status, body, message) of one request; outcome is ok, rejected, malformed or unavailable."""
    headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {token}"} if token else {})
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), _Here)
    try:
        with opener.open(urllib.request.Request(url, body.encode(), headers, method="POST"), timeout=seconds) as answer:
            status, raw = answer.status, answer.read(MOST_BYTES + 1)
    except urllib.error.HTTPError as e:
        return "rejected", e.code, None, _reason(e)
    except (OSError, urllib.error.URLError, ValueError) as e:
        return "unavailable", None, None, str(getattr(e, "reason", e)) or type(e).__name__
    try:
        if len(raw) > MOST_BYTES or not isinstance(json.loads(raw), dict):
            raise ValueError
        return "ok", status, raw.decode(), None
    except (ValueError, RecursionError):
        return "malformed", status, None, "the answer is no JSON object"


def _reason(e: urllib.error.HTTPError) -> str:
    try:
        said = json.loads(e.read(MOST_BYTES)).get("error")
    except (OSError, ValueError, AttributeError, RecursionError):
        said = None
    return str(said) if said else "unknown error"


class Spool:
    """Markers and answers of requests in a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, request_id: str, kind: str) -> str:
        return os.path.join(self.folder, f"{hashlib.sha256(request_id.encode()).hexdigest()}.{kind}")

    def once(self, request_id: str, send) -> tuple:
        """What ``send`` returns, called at most once for a request in all runs over this folder."""
        answer = self._path(request_id, "answer")
        try:
            with open(self._path(request_id, "sent"), "x"):
                pass
        except FileExistsError:
            try:
                with open(answer, encoding="utf-8") as f:
                    return tuple(json.load(f))
            except FileNotFoundError:
                return ("interrupted", None, None, "an earlier attempt was cut off; the request is not sent again")
        got = send()
        with open(f"{answer}.part", "w", encoding="utf-8") as f:
            json.dump(got, f)
        os.replace(f"{answer}.part", answer)
        return got


def fetch(requests: DataFrame, url: str, spool: str, token: str | None = None, seconds: float = REQUEST_SECONDS) -> DataFrame:
    """``request_id, outcome, status, body, message``, a row for each of ``requests`` (requestId and the other fields of the contract).

    Request ids must be settled, not made anew when a task runs again: pass requests that
    were written and read back. Rows without an id are not sent (``unsent``). ``spool`` is a
    local path that all executors share. A partition's requests are sent one after another;
    the number of partitions is that of requests under way at a time.
    """
    where = local_url(url)
    id_only = F.col("requestId").cast("string")
    rows = requests.select(id_only.alias("request_id"), F.to_json(F.struct(*requests.columns)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Spool(spool)
        for batch in batches:
            for request_id, body in zip(batch.column("request_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                got = ("unsent", None, None, "the request has no id") if request_id is None else folder.once(request_id, lambda body=body: ask(where, body, token, seconds))
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, (request_id, *got), strict=True))], schema=_OUT)

    return rows.mapInArrow(run, "request_id string, outcome string, status int, body string, message string")
