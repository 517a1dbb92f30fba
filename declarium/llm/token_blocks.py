"""Token ids as binary files: patched frame-of-reference blocks with an index of block starts.

File format (Parquet rows as the container, so writing is atomic, retried tasks leave nothing
behind, and any store that Spark reaches will do). Each row is a segment of whole documents:

    part, segment     place in the order of documents
    first             ids before this segment within its part
    doc_ids, lengths  the documents of the segment, ids each (with the end id)
    starts            the block index: byte offset of every block in ``payload``, uint32
    payload           blocks of 1,024 ids

Block (little-endian): minimum u32 | count u16 | width u8 | exceptions u16 | packed bits |
exception places u16 each | exception values u32 each. An id is stored as its difference to the
block's minimum in ``width`` bits; the width is that of the chosen percentile of the block's
differences, and what does not fit is stored whole in the exception list.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declarium.llm.common import CACHES, give_back, make_room, shared_folder, slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
PUNCTUATION = string.punctuation
BLOCK = 1024
PERCENTILE = 95
# Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
# Bytes of text encoded at once, and words and their bytes whose ids a worker remembers.
SLICE_BYTES = 8 << 20
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 64 << 20
JOINED_BYTES = 1 << 16
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Blocks packed or unpacked at once.
BLOCKS = 64
# Ids copied at once.
COPIED_IDS = 1 << 18
# Printable ASCII, line breaks and Latin letters.
PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ɏ]*")
HEADER = struct.Struct("<IHBH")

SEGMENT_SCHEMA = (
    "part int, segment int, first long, doc_ids array<bigint>, lengths array<bigint>, "
    "n_ids long, starts binary, payload binary"
)

_loaded: dict[str, "Encoder"] = CACHES.setdefault(__name__, {})


# -- blocks ---------------------------------------------------------------------------------


def pack_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of equally many, at most 65,535, unsigned 32-bit values: one of each row."""
    values = values.astype(np.uint32, copy=False)
    count = values.shape[1]
    lows = values.min(axis=1)
    rest = values - lows[:, None]
    place = -(-(count - 1) * percentile // 100)
    # the exponent of a whole number is its bit length
    widths = np.frexp(np.partition(rest, place, axis=1)[:, place].astype(float))[1]
    over = rest >> widths[:, None].astype(np.uint64) != 0
    kept = np.where(over, np.uint32(0), rest)
    blocks = [b""] * len(values)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width == 16:  # the same bytes as below, faster
            packed = kept[rows].astype("<u2").view(np.uint8)
        else:
            bits = np.unpackbits(
                kept[rows].astype("<u4", copy=False).view(np.uint8).reshape(-1, 4),
                axis=1, count=width, bitorder="little",
            )
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for row, held in zip(rows.tolist(), packed):
            places = np.flatnonzero(over[row])
            blocks[row] = b"".join((
                HEADER.pack(lows[row], count, width, len(places)), held.tobytes(),
                places.astype("<u2").tobytes(), rest[row, places].astype("<u4").tobytes(),
            ))
    return blocks


def pack_block(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of at most 65,535 unsigned 32-bit values."""
    return pack_blocks(np.asarray(values)[None], percentile)[0]


def unpack_blocks(data: bytes, starts: list[int]) -> list[np.ndarray]:
    """The blocks at these offsets; those of one size and width together."""
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(starts)
    alike: dict[tuple[int, int], list[int]] = {}
    headers = [HEADER.unpack_from(data, start) for start in starts]
    for i, (_, count, width, _) in enumerate(headers):
        alike.setdefault((count, width), []).append(i)
    for (count, width), members in alike.items():
        size = (count * width + 7) // 8
        begins = [starts[i] + HEADER.size for i in members]
        packed = np.stack([np.frombuffer(data, np.uint8, size, begin) for begin in begins])
        if width == 16:
            values = packed.view("<u2").astype("<u4")
        else:
            bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little")
            rest = np.zeros((len(members), count, 32), np.uint8)
            rest[:, :, :width] = bits.reshape(len(members), count, width)
            values = np.packbits(rest, axis=2, bitorder="little").view("<u4")[:, :, 0]
        for i, begin, own in zip(members, begins, values):
            low, _, _, exceptions = headers[i]
            places = np.frombuffer(data, "<u2", exceptions, begin + size)
            own[places] = np.frombuffer(data, "<u4", exceptions, begin + size + 2 * exceptions)
            found[i] = own + np.uint32(low)
    return found


def unpack_block(data: bytes, start: int = 0) -> np.ndarray:
    return unpack_blocks(data, [start])[0]


def runs(count: int) -> Iterator[tuple[int, int]]:
    """Places of so many blocks, some at a time."""
    return ((i, min(i + BLOCKS, count)) for i in range(0, count, BLOCKS))


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Block index and payload."""
    full = len(ids) // BLOCK
    even = ids[: full * BLOCK].reshape(full, BLOCK)
    blocks = [block for low, high in runs(full) for block in pack_blocks(even[low:high])]
    if len(ids) > full * BLOCK:
        blocks.append(pack_block(ids[full * BLOCK :]))
    starts = np.cumsum([0, *map(len, blocks[:-1])]) if blocks else np.empty(0)
    return starts.astype("<u4").tobytes(), b"".join(blocks)


def unpack_ids(starts: bytes, payload: bytes) -> np.ndarray:
    places = np.frombuffer(starts, "<u4").tolist()
    found = [
        block for low, high in runs(len(places)) for block in unpack_blocks(payload, places[low:high])
    ]
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def read_block(starts: bytes, payload: bytes, block: int) -> np.ndarray:
    """One block alone, found through the index."""
    return unpack_block(payload, int(np.frombuffer(starts, "<u4")[block]))


# -- encoding -------------------------------------------------------------------------------


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``data``, one after the other; copied run by run, as places take more than ids."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    found = np.empty(total, data.dtype)
    cut = np.searchsorted(ends, np.arange(COPIED_IDS, total, COPIED_IDS), side="right")
    edges = np.unique([0, *cut.tolist(), len(sizes)]).tolist()
    for low, high in zip(edges, edges[1:]):
        first, last = int(ends[low - 1]) if low else 0, int(ends[high - 1])
        own = sizes[low:high]
        places = np.repeat(starts[low:high] - (ends[low:high] - own), own)
        places += np.arange(first, last)
        found[first:last] = data[places]
    return found


def pieces_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of each word end, and the bytes of all."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return ends[1:].astype(np.int64) - ends[0], held[ends[0] : ends[-1]]


class Known:
    """Words and their ids, in few arrays: a word takes little more than its bytes and ids."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        # where the ids of each word stand in ``data``
        self.data, self.starts, self.sizes = (np.empty(0, k) for k in ("<u4", np.int64, np.int64))
        self.used = np.empty(0, bool)

    def add(self, names: pa.Array, data: list[np.ndarray], sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.data) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.data = np.concatenate([self.data, *data])
        self.names = pa.concat_arrays([self.names, names])
        self.used = np.concatenate([self.used, np.ones(len(names), bool)])

    def forget(self) -> None:
        """Keep the words that the last batches used."""
        kept = np.flatnonzero(self.used)
        self.data = gathered(self.data, self.starts[kept], self.sizes[kept])
        self.sizes = self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names = self.names.take(pa.array(kept))
        self.used = np.zeros(len(kept), bool)

    def find(self, wanted: pa.Array, learn: Callable[[pa.Array], None]) -> np.ndarray:
        """Places of words; ``learn`` gets the distinct ones that are not known, and adds them."""
        if len(self.names) > REMEMBERED or self.names.nbytes > REMEMBERED_BYTES:
            self.forget()
        at = pc.fill_null(pc.index_in(wanted, value_set=self.names), -1).to_numpy().copy()
        missing = at < 0
        if missing.any():
            before = len(self.names)
            new = wanted.filter(pa.array(missing)).dictionary_encode()
            learn(new.dictionary)
            at[missing] = new.indices.to_numpy() + before
        self.used[at] = True
        return at


class Encoder:
    """Ids of whole texts.

    The tokenizer never merges across a space that follows a character other than white
    space, nor from a letter to a full stop or comma, so the words between are encoded alone:
    every distinct word of a batch once, and common ones remembered. New words go to the
    library as long texts of many words; as it is byte-level, the byte lengths of the tokens
    tell where each word ends. Texts with special strings or unusual characters or white space
    go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)  # one character a byte
        self.stems, self.tails = Known(), Known()

    def whole(self, text: str) -> np.ndarray:
        # of the library's calls the one that keeps no offsets
        (coded,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, "<u4")

    def learn(self, words: pa.Array) -> None:
        """Ids of words as they are after a space, or with their line break before them."""
        parts = pc.if_else(
            pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(" ", words, "")
        )
        ends, joined = pieces_of(parts)
        sizes = np.diff(ends, prepend=0)
        edges = [0, *(np.flatnonzero(np.diff(ends // JOINED_BYTES)) + 1).tolist(), len(parts)]
        found, lengths = [], []
        for low, high in zip(edges, edges[1:]):
            text = joined[ends[low] - sizes[low] : ends[high - 1]].tobytes().decode()
            ids = self.whole(text)
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[low:high])) + 1
            found.append(ids)
            lengths.append(np.diff(last, prepend=0))
        self.stems.add(words, found, np.concatenate(lengths))

    def learn_tails(self, tails: pa.Array) -> None:
        found = [self.whole(tail) for tail in tails.to_pylist()]
        self.tails.add(tails, found, np.array([len(ids) for ids in found]))

    def words(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        # punctuation behind a letter is encoded alone
        bare = pc.utf8_rtrim(wanted, characters=PUNCTUATION)
        plain = pc.utf8_is_alpha(pc.utf8_slice_codeunits(bare, -1))
        stems = pc.if_else(plain, bare, wanted)
        at = self.stems.find(stems, self.learn)
        starts, sizes = self.stems.starts[at], self.stems.sizes[at]
        ends, data = pieces_of(wanted)
        behind = np.diff(ends, prepend=0) - pc.binary_length(stems).to_numpy()
        tailed = np.flatnonzero(behind)
        if not len(tailed):
            return gathered(self.stems.data, starts, sizes), sizes
        behind = behind[tailed]
        tails = gathered(data, ends[tailed] - behind, behind)
        offsets = np.cumsum([0, *behind], dtype=np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(tails)]
        at = self.tails.find(pa.Array.from_buffers(pa.string(), len(tailed), buffers), self.learn_tails)
        after, lengths = np.zeros((2, len(sizes)), np.int64)
        after[tailed] = self.tails.starts[at] + len(self.stems.data)
        lengths[tailed] = self.tails.sizes[at]
        both = np.stack([starts, after], axis=1).ravel(), np.stack([sizes, lengths], axis=1).ravel()
        known = np.concatenate([self.stems.data, self.tails.data])
        return gathered(known, *both), sizes + lengths

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id; ids of each."""
        listed = texts.to_pylist()
        others = {i: t for i, t in enumerate(listed) if t and not self.safe(t)}
        # every word begins with its line break, or stands after a space; so does the first
        marked = [
            "\n" + t.replace("\n", " \n") if t and i not in others else ""
            for i, t in enumerate(listed)
        ]
        # each form of the texts goes when the next one is made
        del listed
        marked = pa.array(marked, pa.string())
        split = pc.split_pattern(marked, " ")
        del marked
        coded = split.values.dictionary_encode()
        firsts = split.offsets.to_numpy()[:-1].copy()
        del split
        codes, names = coded.indices.to_numpy(), coded.dictionary
        data, sizes = self.words(pc.if_else(pc.equal(names, ""), "\n", names))
        found = [self.whole(text) for text in others.values()]
        held = len(data) + sum(map(len, found))
        kind = np.int32 if held < 1 << 31 else np.int64
        begins, lengths = (np.cumsum(sizes) - sizes).astype(kind)[codes], sizes.astype(kind)[codes]
        # the line break put before the first word goes; other texts are one such part
        begins[firsts] += 1
        lengths[firsts] -= 1
        own = np.array([len(ids) for ids in found], np.int64)
        first = firsts[list(others)]
        begins[first], lengths[first] = len(data) + np.cumsum(own) - own, own
        places = np.append(firsts[1:], len(codes))
        del coded, codes, names
        begins, lengths = np.insert(begins, places, held), np.insert(lengths, places, 1)
        data = np.concatenate([data, *found, np.array([END_ID], "<u4")])
        ids = gathered(data, begins, lengths)
        ends = np.cumsum(lengths)[places + np.arange(len(places))]
        return ids, np.diff(ends, prepend=0)

    def safe(self, text: str) -> bool:
        """Every space stands alone between characters that are no white space."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return False
        if "\n " in text or " \n" in text or "\n\n" in text:
            return False
        if any(s in text for s in self.special):
            return False
        return PLAIN.fullmatch(text) is not None


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cuts(sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of documents with about SEGMENT_IDS ids."""
    edges = (np.flatnonzero(np.diff(np.cumsum(sizes) // SEGMENT_IDS)) + 1).tolist()
    return [0, *edges], [*edges, len(sizes)]


# -- files ----------------------------------------------------------------------------------


def _segments(path: str | None, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        make_room(__name__)
        tokens = encoder(path or public_tokenizers.path(TOKENIZER))
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            starts, payload = pack_ids(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([starts], pa.binary()),
                    pa.array([payload], pa.binary()),
                ],
                names=[f.split()[0] for f in SEGMENT_SCHEMA.split(", ")],
            )

        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                ids, sizes = tokens.ids(rows.column(1))
                for low, high in zip(*cuts(sizes)):
                    begin = sizes[:low].sum()
                    doc_ids += rows.column(0).slice(low, high - low).to_pylist()
                    lengths.append(sizes[low:high])
                    pieces.append(ids[begin : begin + sizes[low:high].sum()])
                    held += len(pieces[-1])
                    if held >= SEGMENT_IDS:
                        yield close()
                        segment, first = segment + 1, first + held
                        doc_ids, lengths, pieces, held = [], [], [], 0
            batch = rows = ids = None  # before the next one is read
        if doc_ids:
            yield close()
        doc_ids, lengths, pieces = [], [], []
        give_back()

    return run


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes while this lasts, unless the session sets their size.

    A batch stands in the JVM, in a buffer of up to twice its size, and in Python.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    if before is None:
        spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every whole text and write its ids in ascending order of id.

    Null and empty texts hold the end id alone. Rows without an id come first; rows with equal
    ids are ordered by text. Only the id and the text are read and shuffled, once, by ranges of
    the id; encoding happens after the shuffle, so ids move nowhere but into the files. Texts go to
    Python in batches of about SLICE_BYTES, unless the session sets their size.
    """
    ordered = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    ordered = ordered.repartitionByRange(id_column).sortWithinPartitions(id_column, text_column)
    coded = ordered.mapInArrow(_segments(tokenizer, id_column, text_column), SEGMENT_SCHEMA)
    with batches_of(docs.sparkSession, SLICE_BYTES):
        coded.write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and ids (uint32 bytes).

    ``start`` counts the ids of all documents before: the part totals are summed in order and sent
    to the segments, which stay where they are read. There is one total of 12 bytes for each written
    part, so for each task that wrote. Without ``with_ids`` the ids stay in the tasks that read them.
    """
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("first")).alias("first"), "doc_ids", "lengths", "starts", "payload"
    )
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, doc_ids, lengths, starts, payload = (c[row].as_py() for c in batch.columns)
                data = unpack_ids(starts, payload).astype("<u4", copy=False).tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                ids = [data[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist())]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(first + begins, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(unpack, f"{schema}, ids binary" if with_ids else schema)


def token_blocks(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write the files and read them back; by default below the shared folder."""
    path = path or shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path, with_ids)
