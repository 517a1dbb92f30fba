"""Exact token counts without token ids: batch encoding that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import CACHES, ids_of, map_arrow, texts_of

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
# Bytes of text handed to the library in one call, and lengths remembered in a worker.
BATCH_BYTES = 1 << 20
REMEMBERED = 300_000

# No piece of the vocabulary holds its space mark after another character, so no merge crosses
# a space that follows anything but a space (or a literal space mark). The space itself is what
# the library puts before every text it is given, so the part after it is encoded alike.
SAFE_SPACE = re.compile(r"(?<=[^ ▁]) (?= *[^ ])")
SPACE_MARK = "▁"

_loaded: dict[str, object] = CACHES.setdefault(__name__, {})


def safe_parts(text: str) -> list[str]:
    """Split where the library's own merges cannot reach across; the counts of the parts add up."""
    if SPACE_MARK in text or "  " in text or text[:1] == " " or text[-1:] == " ":
        return SAFE_SPACE.split(text)
    return text.split(" ")


def by_bytes(parts: Iterable[str], limit: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Batches of about equal bytes, however long the single parts are."""
    batch, size = [], 0
    for part in parts:
        batch.append(part)
        size += len(part.encode())
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Counter:
    """Lengths of texts for one model; remembers the lengths of the commonest kind of parts."""

    def __init__(self, path: str):
        import sentencepiece

        for name in dir(sentencepiece):
            if name == "set_min_log_level":
                sentencepiece.set_min_log_level(2)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str | None]) -> list[int]:
        split = [safe_parts(text) if text else [] for text in texts]
        wanted: set[str] = set()
        for parts in split:
            wanted.update(parts)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known = {}
        known = self.known
        for batch in by_bytes(sorted(wanted - known.keys())):
            encoded = self.model.encode(batch, num_threads=1, add_bos=False, add_eos=False)
            known.update(zip(batch, map(len, encoded)))
        return [sum(map(known.__getitem__, parts)) for parts in split]


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(
    docs: DataFrame,
    model: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row.

    Null and empty texts have no bytes and no tokens. Equal rows each give a row; rows
    without an id keep a null id. Other columns are not read. ``model`` is a file that every
    executor has (by default the public tokenizer package's).
    """

    def measure(batch: pa.RecordBatch) -> dict:
        import public_tokenizers

        path = model or public_tokenizers.path(MODEL)
        texts = texts_of(batch, text_column)
        counts = []
        # slices of bounded bytes, so that the parts of one slice fit the worker's memory
        start = size = 0
        for i, text in enumerate(texts, 1):
            size += len(text) if text else 0
            if size >= 8 * BATCH_BYTES or i == len(texts):
                counts += counter(path).lengths(texts[start:i])
                start, size = i, 0
        return {
            id_column: ids_of(batch, id_column),
            "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
        }

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(
        docs.select(F.col(id_column), F.col(text_column)),
        measure,
        f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )
