"""Connectors to text models, and what their requests are cut into. No model is required."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

ATTEMPTS = 3
RETRIED = frozenset({429, 500, 502, 503, 504})
BATCH_ITEMS, BATCH_BYTES, ITEM_BYTES = 10, 32_000, 8_000
FRAGMENT_BYTES, EMBED_BYTES = 2_048, 4_096
OPTIONS, OPTION_CHARS = 128, 4_000


class _NoAuthorizationElsewhere(urllib.request.HTTPRedirectHandler):
    """A redirect does not take the key along."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None:
            new.remove_header("Authorization")
        return new


def _wait(attempt: int, after: str | None) -> float:
    try:
        return min(60.0, max(0.0, float(after)))
    except (TypeError, ValueError):
        return 0.2 * 2**attempt


def post_json(url: str, payload: dict, key: str, timeout: float = 90, opener=None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """POST JSON and decode the JSON reply; busy servers, broken connections and broken JSON are tried again."""
    opener = opener or urllib.request.build_opener(_NoAuthorizationElsewhere)
    body = json.dumps(payload, ensure_ascii=False).encode()
    for attempt in range(ATTEMPTS):
        after = None
        try:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with opener.open(request, timeout=timeout) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == ATTEMPTS - 1:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
        except (OSError, json.JSONDecodeError):
            if attempt == ATTEMPTS - 1:
                raise
        sleep(_wait(attempt, after))
    raise AssertionError("unreachable")


def content_json(reply: str) -> dict:
    """The JSON object in a model's reply, whatever stands around it; empty without one."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        found = json.loads(reply[start : end + 1]) if 0 <= start < end else {}
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def string_list(value: object, most: int = 64) -> list[str]:
    return [v.strip() for v in value if isinstance(v, str) and v.strip()][:most] if isinstance(value, list) else []


def is_vector(value: object) -> bool:
    """A non-empty list of finite numbers; booleans are not numbers."""
    return isinstance(value, list) and bool(value) and all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in value)


def batches(texts: Iterable[str], items: int = BATCH_ITEMS, size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in order, in groups of at most ``items`` and ``size`` bytes; a longer text goes alone."""
    held, held_bytes = [], 0
    for t in texts:
        n = len(t.encode())
        if held and (len(held) == items or held_bytes + n > size):
            yield held
            held, held_bytes = [], 0
        held.append(t)
        held_bytes += n
    if held:
        yield held


def fragments(text: str, size: int = FRAGMENT_BYTES) -> list[str]:
    """A text in pieces of at most ``size`` bytes that split no character."""
    out, raw, at = [], text.encode(), 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return out or [""]


def compact_options(options: list[str], most: int = OPTIONS, chars: int = OPTION_CHARS) -> list[str]:
    """At most ``most`` options, evenly taken, together at most ``chars`` long: each keeps its head and tail."""
    picked = options if len(options) <= most else [options[i * len(options) // most] for i in range(most)]
    if sum(map(len, picked)) <= chars:
        return picked
    room = max(3, chars // len(picked))
    return [o if len(o) <= room else o[: (room - 1) // 2] + "…" + o[len(o) - (room - 1 - (room - 1) // 2) :] for o in picked]


def embed_with(model: Callable[[list[str]], list[list[float]]], rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``vector``: chunks of each text through ``model`` in batches, averaged by their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chunks = [fragments(t or "", EMBED_BYTES) for t in frame[text]]
            given = [v for group in batches([c for own in chunks for c in own]) for v in model(group)]
            out, at = [], 0
            for own in chunks:
                mine = given[at : at + len(own)]
                at += len(own)
                weights = [max(1, len(c.encode())) for c in own]
                out.append(mine[0] if len(mine) == 1 else [sum(v[d] * w for v, w in zip(mine, weights, strict=True)) / sum(weights) for d in range(len(mine[0]))])
            yield frame.assign(vector=out)

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add("vector", ArrayType(DoubleType())))


def annotate_with(model: Callable[[list[str]], list[list[str]]], rows: DataFrame, text: str, items: int = 16) -> DataFrame:
    """``rows`` with ``annotation``: terms that ``model`` gives each text's fragments, distinct in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pieces = [fragments(t or "") for t in frame[text]]
            given = iter([terms for group in batches([p for own in pieces for p in own], items) for terms in model(group)])
            yield frame.assign(annotation=[" ".join(dict.fromkeys(t for _ in own for t in string_list(next(given)))) for own in pieces])

    from pyspark.sql.types import StringType, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add("annotation", StringType()))


def local_embedding(text: Column) -> Column:
    """The deterministic stand-in for an embedding model."""
    return vectors.mock_embedding(F.coalesce(text, F.lit("")))

