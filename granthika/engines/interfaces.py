"""Model calls as exchangeable engines, applied to DataFrames in Arrow batches.

An engine turns N texts into N results in order; another number is an error. Real engines (chat services, local models) are supplied by
the caller; the ones here are deterministic and serve tests and dry runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


class Translator(Protocol):
    def translate(self, texts: list[str], retry: bool = False) -> list[str]: ...


class Editor(Protocol):
    def edit(self, drafts: list[str], glossary: dict[str, str], context: str) -> list[tuple[str, str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Narrator(Protocol):
    def speak(self, text: str, emotion: str) -> bytes: ...


def checked(results: list, wanted: int, what: str) -> list:
    """``results`` if there are as many as wanted, else an error: outputs are never padded, cut or guessed."""
    if len(results) != wanted:
        raise ValueError(f"{what}: {len(results)} results for {wanted} inputs")
    return results


class LetterTranslator:
    """Every Latin letter becomes one letter of the target script; inline markers stay."""

    def __init__(self, letter: str = "ಕ") -> None:
        self.letter = letter

    def translate(self, texts: list[str], retry: bool = False) -> list[str]:
        return [re.sub(r"⟦/?\d+⟧|[A-Za-z]", lambda m: m.group() if m.group()[0] == "⟦" else self.letter, t) for t in texts]


class PlainEditor:
    """Gives drafts back as they are, with a neutral emotion."""

    def edit(self, drafts: list[str], glossary: dict[str, str], context: str) -> list[tuple[str, str]]:
        return [("Narration", d) for d in drafts]


class GramEmbedder:
    """Hashed character trigrams, normalised: equal texts have cosine 1."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = 0
                for c in padded[i : i + 3]:
                    h = (h * 131 + ord(c)) % 1_000_003
                v[h % self.size] += 1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class ToneNarrator:
    """A short tone as long as the text."""

    def speak(self, text: str, emotion: str) -> bytes:
        return b"".join(int(8000 * math.sin(i / 8)).to_bytes(2, "little", signed=True) for i in range(10 * len(text)))


def translate_column(rows: DataFrame, make: Callable[[], Translator], source: str, target: str, wanted: str | None = None) -> DataFrame:
    """``rows`` with ``target`` = the translation of ``source``; rows whose ``wanted`` flag is false keep the source text.

    The engine is made once for each task and called once for each Arrow batch.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(target, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            need = batch[source].notna() & (batch[wanted].fillna(False).astype(bool) if wanted else True)
            out = batch[source].astype(object).copy()
            texts = batch.loc[need, source].tolist()
            if texts:
                out[need] = checked(engine.translate(texts), len(texts), "translator")
            yield batch.assign(**{target: out})

    return rows.mapInPandas(run, schema)


def embed_column(rows: DataFrame, make: Callable[[], Embedder], source: str, target: str) -> DataFrame:
    """``rows`` with the vector of each text; null texts have none."""
    schema = T.StructType([*rows.schema.fields, T.StructField(target, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            some = batch[source].notna()
            vectors = iter(checked(engine.embed(batch.loc[some, source].tolist()), int(some.sum()), "embedder"))
            yield batch.assign(**{target: [next(vectors) if x else None for x in some]})

    return rows.mapInPandas(run, schema)


def edit_batches(rows: DataFrame, make: Callable[[], Editor], keys: list[str]) -> DataFrame:
    """(keys, position, emotion, edited) of rows (keys, position, draft, prior_context, terms), a batch at a time.

    A batch that the editor answers with another number of paragraphs is halved, down to single paragraphs.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("position", T.IntegerType()), T.StructField("emotion", T.StringType()), T.StructField("edited", T.StringType())])

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        engine = make()
        batch = batch.sort_values("position")

        def edit(drafts: list[str], context: str) -> list[tuple[str, str]]:
            terms = batch["terms"].iloc[0] if "terms" in batch else None
            try:
                return checked(engine.edit(drafts, dict(terms or {}), context), len(drafts), "editor")
            except ValueError:
                if len(drafts) <= 1:
                    raise
                half = len(drafts) // 2
                return edit(drafts[:half], context) + edit(drafts[half:], " ".join(drafts[:half]))

        done = edit(batch["draft"].tolist(), str(batch["prior_context"].iloc[0] or ""))
        return batch[[*keys, "position"]].assign(emotion=[e for e, _ in done], edited=[t for _, t in done])

    return rows.groupBy(*keys).applyInPandas(run, schema)


def narrate(rows: DataFrame, make: Callable[[], Narrator], keep: list[str], text: str = "text", emotion: str = "emotion") -> DataFrame:
    """(keep, pcm): the sound of each text."""
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            yield batch[keep].assign(pcm=[engine.speak(t, e) for t, e in zip(batch[text], batch[emotion], strict=True)])

    return rows.where(F.col(text).isNotNull()).mapInPandas(run, schema)
