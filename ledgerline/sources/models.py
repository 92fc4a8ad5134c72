"""Language models behind HTTP endpoints, asked from Spark tasks.

Requests are rows; each partition asks with a bounded number of threads and the number of partitions is bounded too, so an
endpoint never sees more than ``tasks * at_once`` calls.  Busy or failing endpoints are asked again after growing pauses.
A call that fails for good is a row with an error, never the end of the job.

With a ``store`` each reply is a file named by the digest of what was asked, written by the task the moment it is
there, on any file system that all executors reach.  A task that is run again, on another executor or in a later job,
finds it there and doesn't call: a lost executor loses the calls that were under way and no others.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HTTP codes of an endpoint that may do better later.
PASSING = {408, 409, 425, 429, 500, 502, 503, 504}


@dataclasses.dataclass(frozen=True)
class Endpoint:
    """Where a model answers: an OpenAI-like ``/chat/completions``, or ``/api/chat`` where ``native``."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 600.0
    native: bool = False
    context: int | None = None
    attempts: int = 4
    pause: float = 1.0
    at_once: int = 4
    tasks: int = 8

    def url(self) -> str:
        base = self.base_url.rstrip("/")
        return base.removesuffix("/v1") + "/api/chat" if self.native else base + "/chat/completions"

    def body(self, messages: list[dict], schema: dict | None, stream: bool = False) -> dict:
        """What is sent: nothing is drawn at random, and the model doesn't think aloud."""
        out: dict = {"model": self.model, "messages": messages, "stream": stream}
        if self.native:
            limit = {} if self.context is None else {"num_ctx": self.context}
            return out | {"think": False, "options": {"temperature": 0} | limit} | ({} if schema is None else {"format": schema})
        form = {} if schema is None else {"response_format": {"type": "json_schema", "json_schema": {"name": "reply", "strict": True, "schema": schema}}}
        return out | {"temperature": 0, "chat_template_kwargs": {"enable_thinking": False}} | form

    def _opened(self, messages: list[dict], schema: dict | None, stream: bool):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.url(), json.dumps(self.body(messages, schema, stream)).encode(), headers)
        for attempt in range(1, self.attempts + 1):
            try:
                return urllib.request.urlopen(request, timeout=self.timeout)
            except urllib.error.HTTPError as error:
                if error.code not in PASSING or attempt == self.attempts:
                    raise
                asked = error.headers.get("Retry-After", "")
                wait = float(asked) if asked.replace(".", "", 1).isdigit() else 0.0
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.attempts:
                    raise
                wait = 0.0
            time.sleep(max(wait, self.pause * 2 ** (attempt - 1)))
        raise OSError("no attempt is allowed")

    def reply(self, messages: list[dict], schema: dict | None = None) -> str:
        """Text of the reply; OSError if the endpoint doesn't answer, ValueError if its answer isn't one."""
        with self._opened(messages, schema, False) as got:
            data = json.load(got)
        try:
            content = data["message"]["content"] if self.native else data["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as error:
            raise ValueError(f"no reply in the answer: {str(data)[:200]}") from error
        if not isinstance(content, str):
            raise ValueError("the reply isn't text")
        return content

    def deltas(self, messages: list[dict]) -> Iterator[str]:
        """Pieces of the reply as they come.  A stream that ends without its end mark raises ConnectionError."""
        with self._opened(messages, None, True) as got:
            for raw in got:
                line = raw.decode("utf-8").strip()
                if self.native and line:
                    data = json.loads(line)
                    piece, done = data.get("message", {}).get("content"), data.get("done")
                elif line.startswith("data:"):
                    text = line[5:].strip()
                    done = text == "[DONE]"
                    piece = None if done else ((json.loads(text).get("choices") or [{}])[0].get("delta") or {}).get("content")
                else:
                    continue
                if piece:
                    yield piece
                if done:
                    return
        raise ConnectionError("the stream broke off")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(files: fs.FileSystem, path: str, text: str) -> None:
    """Write a file whole or not at all."""
    files.create_dir(path.rpartition("/")[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(beside) as out:
        out.write(text.encode("utf-8"))
    files.move(beside, path)


def get(files: fs.FileSystem, path: str) -> str | None:
    """A file's text; None without one."""
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as got:
        return got.read().decode("utf-8")


def digest(endpoint: Endpoint, messages: str, schema: dict | None) -> str:
    """Name of a request: the model, what it is asked, and the form of its reply."""
    return hashlib.sha256(json.dumps([endpoint.url(), endpoint.model, endpoint.context, schema, messages]).encode()).hexdigest()


def once(endpoint: Endpoint, messages: str, schema: dict | None, store: str | None) -> str:
    """The reply to messages (JSON text), from the store if it is there."""
    if store is None:
        return endpoint.reply(json.loads(messages), schema)
    files, root = filesystem(store)
    name = digest(endpoint, messages, schema)
    path = f"{root.rstrip('/')}/{name[:2]}/{name}.txt"
    known = get(files, path)
    if known is None:
        known = endpoint.reply(json.loads(messages), schema)
        put(files, path, known)
    return known


def replies(requests: DataFrame, endpoint: Endpoint, schema: dict | None = None, store: str | None = None) -> DataFrame:
    """``requests`` (with a column ``messages``, JSON text) with ``reply`` and ``error``, one of them null.

    Equal messages are asked once.  Null messages aren't asked and have neither.  Without a store a part that is
    computed again is asked again.
    """
    asked = requests.select("messages").filter("messages is not null").distinct().repartition(endpoint.tasks)

    def one(messages: str) -> tuple[str, str | None, str | None]:
        try:
            return messages, once(endpoint, messages, schema, store), None
        except (OSError, ValueError) as error:
            return messages, None, f"{type(error).__name__}: {error}"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(endpoint.at_once) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(one, frame["messages"])), columns=["messages", "reply", "error"])

    got = asked.mapInPandas(work, T.StructType([T.StructField(n, T.StringType()) for n in ("messages", "reply", "error")]))
    return requests.join(got, "messages", "left")


def parsed(reply, ddl: str):
    """The JSON object in a reply as a struct; null if there is none.  Text around the object (code fences) goes."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), ddl)
