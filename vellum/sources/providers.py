"""Interfaces to what lies outside the engine (PDF, recognition, vision, embeddings, language models), with offline stand-ins.

A provider is a plain object that is sent to the workers; its calls run inside Arrow or pandas batches.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PageReader(Protocol):
    def pages(self, data: bytes) -> list[dict]: ...


@dataclass(frozen=True)
class TextPages:
    """Pages of a text file, divided at form feeds; stands in for a PDF reader."""

    def pages(self, data: bytes) -> list[dict]:
        return [{"raw_text": t.strip(), "images": 0, "drawings": 0} for t in data.decode("utf-8", "replace").split("\f")]


def read_pages(files: DataFrame, reader: PageReader | None = None) -> DataFrame:
    """(doc_id, page_num, raw_text, images, drawings) of rows (path, content), as from the binaryFile source."""
    reader = reader or TextPages()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path.rsplit("/", 1)[-1], i, p["raw_text"], p.get("images", 0), p.get("drawings", 0)) for path, data in zip(f.path, f.content, strict=True) for i, p in enumerate(reader.pages(bytes(data)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "raw_text", "images", "drawings"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_num int, raw_text string, images int, drawings int")


def usable_images(images: DataFrame, first: int = 5, least: int = 100) -> DataFrame:
    """The first ``first`` image references of a page, then those of at least ``least`` pixels each way."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("xref")
    return images.withColumn("r", F.row_number().over(w)).where(f"r <= {first}").drop("r").where((F.col("width") >= least) & (F.col("height") >= least))


def vector_diagrams(pages: DataFrame, least: int = 5) -> DataFrame:
    """Pages to be rendered as diagrams: enough drawing operations and no more raster images than were kept."""
    return pages.where((F.col("drawings") >= least) & (F.col("images") <= F.coalesce("kept_images", F.lit(0))))


@dataclass(frozen=True)
class HashedEmbedder:
    """Signed feature hashing of words; deterministic and offline."""

    dim: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def in_request_order(responses: list[dict]) -> list:
    """The embeddings of a service's answers (index, embedding), which may come in any order, in the order of the requests."""
    return [r["embedding"] for r in sorted(responses, key=lambda r: r["index"])]


def embedded(df: DataFrame, text_col: str, out: str = "embedding", embedder: HashedEmbedder | None = None, batch: int = 512) -> DataFrame:
    embedder = embedder or HashedEmbedder()

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, embed(F.col(text_col)))


@dataclass(frozen=True)
class Retrying:
    """Calls with ``pace`` seconds before each and up to ``tries`` attempts, waiting 2, 4, ... times ``pause``; failure gives "" ."""

    call: Callable[..., str]
    tries: int = 3
    pause: float = 0.0
    pace: float = 0.0

    def __call__(self, *args) -> str:
        if self.pace:
            time.sleep(self.pace)
        for i in range(self.tries):
            try:
                return self.call(*args)
            except Exception:  # noqa: BLE001 - any failure of a remote service counts
                if i + 1 < self.tries:
                    time.sleep(self.pause * 2 ** (i + 1))
        return ""


def described(images: DataFrame, describe: Callable[[bytes], str], out: str = "description", pace: float = 0.0) -> DataFrame:
    """Adds a description of each image (column ``data``); ``pace`` seconds pass between the calls of a task."""
    call = Retrying(describe, pace=pace)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: call(bytes(d)) if d is not None else "")

    return images.withColumn(out, run("data"))


def recognised(pages: DataFrame, recognise: Callable[[bytes], str], min_chars: int = 20) -> DataFrame:
    """Adds ocr_text to the scanned pages (little text, some image) of rows with the page's picture in ``data``."""
    from ..operators.structure import is_scanned

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda d: recognise(bytes(d)) if d is not None else None)

    scanned = is_scanned(F.col("raw_text"), F.col("images"), min_chars)
    return pages.withColumn("ocr_text", read(F.when(scanned, F.col("data"))))


def offline_description(data: bytes) -> str:
    """Stands in for a vision model."""
    return f"Image of {len(data)} bytes." if data else ""


EMBEDDERS: dict[str, Callable[[int], HashedEmbedder]] = {"hashed": HashedEmbedder}


def get_embedder(name: str, dim: int) -> HashedEmbedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedding provider: {name}")
    return EMBEDDERS[name](dim)


@dataclass
class OfflineModel:
    """Answers with the first source's first sentence; stands in for a language model."""

    calls: list[str] = field(default_factory=list)

    def generate(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.0) -> str:
        self.calls.append(prompt)
        body = prompt.split("]\n", 1)[-1].split("\n\n---", 1)[0]
        return f"{body.split('. ')[0].strip()} [Source 1]"

    def stream(self, prompt: str, **options) -> Iterator[str]:
        yield from (w + " " for w in self.generate(prompt, **options).split(" "))


MODELS: dict[str, Callable[[], OfflineModel]] = {"offline": OfflineModel}


def get_model(name: str) -> OfflineModel:
    if name not in MODELS:
        raise ValueError(f"unknown model provider: {name}")
    return MODELS[name]()
