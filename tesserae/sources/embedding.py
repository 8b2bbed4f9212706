"""Embedding providers: HTTP connectors for three protocols, and a column form of any provider."""
from __future__ import annotations

import json
import math
import os
import urllib.request
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.errors import EmbeddingError

#: endpoint, dimensions, path, whether extra dimensions are cut off, sent, checked, and whether a key is sent
PROTOCOLS = {
    "llamacpp": {"endpoint": "http://127.0.0.1:8080", "dimensions": 768, "path": "/v1/embeddings", "cut": True, "send": True, "key": True, "prefix": {"query": "search_query: ", "document": "search_document: "}},
    "openai": {"endpoint": "https://api.openai.com", "dimensions": 1536, "path": "/v1/embeddings", "cut": False, "send": True, "key": True, "prefix": {}},
    "ollama": {"endpoint": "http://127.0.0.1:11434", "dimensions": 768, "path": "/api/embed", "cut": False, "send": False, "key": False, "prefix": {}},
}


def post(url: str, body: dict, headers: dict, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.status, r.read()


class HttpProvider:
    """Options that are not given come from TESSERAE_EMBED_* variables, then from the protocol. `send` is the transport."""

    def __init__(self, protocol: str = "llamacpp", endpoint: str | None = None, model: str | None = None, dimensions: int | None = None, api_key: str | None = None, timeout: float | None = None, send: Callable = post):
        if protocol not in PROTOCOLS:
            raise EmbeddingError(f"unknown protocol {protocol}")
        env = lambda name: (os.environ.get(f"TESSERAE_EMBED_{name}") or "").strip() or None
        spec = PROTOCOLS[protocol]
        self.protocol, self.spec, self.send = protocol, spec, send
        self.endpoint = ((endpoint or "").strip() or env("ENDPOINT") or spec["endpoint"]).rstrip("/")
        self.model = (model or "").strip() or env("MODEL") or "nomic-embed-text"
        self.dimensions = int(dimensions or env("DIMENSIONS") or spec["dimensions"])
        self.api_key = (api_key or "").strip() or env("API_KEY")
        self.timeout = float(timeout or env("TIMEOUT_SECONDS") or 10)
        if self.dimensions < 1 or self.timeout <= 0:
            raise EmbeddingError("dimensions and timeout must be positive")

    def url(self) -> str:
        path = self.spec["path"]
        return self.endpoint + (path.removeprefix("/v1") if self.endpoint.endswith("/v1") and path.startswith("/v1") else path)

    def embed(self, text: str, purpose: str) -> list[float]:
        body: dict = {"input": self.spec["prefix"].get(purpose, "") + text, "model": self.model}
        if self.spec["send"]:
            body["dimensions"] = self.dimensions
        if self.protocol == "llamacpp":
            body["encoding_format"] = "float"
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {self.api_key}"} if self.spec["key"] and self.api_key else {})
        try:
            status, raw = self.send(self.url(), body, headers, self.timeout)
        except Exception as e:
            raise EmbeddingError(f"{self.protocol} embedding request failed") from e
        if not 200 <= status < 300:
            raise EmbeddingError(f"{self.protocol} embedding failed: {status}")
        try:
            got = json.loads(raw)
            v = got["embeddings"][0] if self.protocol == "ollama" else got["data"][0]["embedding"]
            v = [float(x) for x in v]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise EmbeddingError(f"{self.protocol} returned no embedding") from e
        if not v or not all(map(math.isfinite, v)):
            raise EmbeddingError(f"{self.protocol} returned no embedding")
        if self.spec["cut"] and len(v) > self.dimensions:
            return v[:self.dimensions]
        if len(v) != self.dimensions:
            raise EmbeddingError(f"{self.dimensions} dimensions were asked for, {len(v)} came")
        return v


class TableProvider:
    """Vectors by look-up of "purpose:text", then of the text, then the default if there is one."""

    def __init__(self, vectors: dict[str, list[float]], dimensions: int, model: str = "table", default: list[float] | None = None):
        self.vectors, self.dimensions, self.model, self.default = vectors, dimensions, model, default

    def embed(self, text: str, purpose: str) -> list[float]:
        got = self.vectors.get(f"{purpose}:{text}", self.vectors.get(text, self.default))
        if got is None:
            raise EmbeddingError("no vector for a text")
        return got


def embed_column(provider, text: Column, purpose: str = "document") -> Column:
    """Vectors of a column in Arrow batches; null for null. The provider goes to the executors; a text that
    stands several times in a batch is asked for once. Another length than the provider's raises an error."""

    @F.pandas_udf("array<float>")
    def run(s):
        made = {t: [float(x) for x in provider.embed(t, purpose)] for t in s.dropna().unique()}
        if any(len(v) != provider.dimensions or not all(map(math.isfinite, v)) for v in made.values()):
            raise EmbeddingError(f"{provider.dimensions} finite numbers are wanted of the provider")
        return s.map(made.get)

    return run(text)
