"""Token ids as flat binary files: unsigned integers plus 64-bit document offsets, memory-mapped.

Layout of a dataset below one folder, in ascending doc_id order over the shards::

    <n>.ids   the ids of the shard's documents, one after the other, little endian, 16 bits where the
              vocabulary has at most 65,536 ids, else 32
    <n>.off   64-bit little-endian offsets into <n>.ids, one per document and one for the end
    <n>.doc   64-bit little-endian doc_ids, one per document

A shard's base (the ids in all shards before it) is the prefix sum of the shards' totals, so a document's
place in the whole dataset is base + offset and no shard has to know another's size to be written.

Defined results: a null text is an empty one and has the end id alone; rows with equal doc_ids stand side
by side in order of their texts, nulls first; a null doc_id comes first of all and is written as the
smallest 64-bit integer; an empty table gives no files; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lean import lean
from tessera.llm.store import bounded_batches, filesystem, new_path, put
from tessera.llm.textkit import slices

END_ID = 1
NO_DOC = np.iinfo(np.int64).min


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pieces that normalisation leaves as they are but for case, and without added tokens: their words can be counted beforehand.
_PLAIN = "^[!-~\u00c0-\u00ff]+$"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_TOGETHER, MOST_KNOWN = 256, 400_000


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Whether each id ends a word."""
    vocab = _tokenizer(path).get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return ends


def _encode_pieces(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in some order, where each piece's ids start in them and how many they are).

    Plain pieces are encoded many at a time, as one text with spaces between; an id that ends a word tells where
    each stops. Others, and a run whose words are not as many as counted, are encoded one by one.
    """
    lower = pc.utf8_lower(pieces)
    plain = np.asarray(pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.invert(pc.match_substring(pieces, "<|"))).to_numpy(zero_copy_only=False), dtype=bool)
    count = np.asarray(pc.count_substring_regex(lower, _WORDS)).astype(np.int64)
    text, encoder, ends = pieces.to_pylist(), _tokenizer(path), _word_ends(path)
    size = np.zeros(len(text), np.int64)
    together, alone = np.flatnonzero(plain & (count > 0)), np.flatnonzero(~(plain & (count > 0))).tolist()
    runs = [together[i : i + _TOGETHER] for i in range(0, len(together), _TOGETHER)]
    flat: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    # A few runs at a time: an encoding keeps far more than its ids.
    for lo in range(0, len(runs), 32):
        some = runs[lo : lo + 32]
        for run, e in zip(some, encoder.encode_batch_fast([" ".join([text[i] for i in run.tolist()]) for run in some], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=np.uint32)
            stop = np.flatnonzero(ends[found])
            if len(stop) != count[run].sum():
                alone += run.tolist()
                continue
            cut = stop[np.cumsum(count[run]) - 1] + 1
            size[run] = np.diff(np.r_[0, cut])
            flat.append(found)
            owner.append(run)
    for i, e in zip(alone, encoder.encode_batch_fast([text[i] for i in alone], add_special_tokens=False), strict=True):
        flat.append(np.array(e.ids, dtype=np.uint32))
        size[i] = len(flat[-1])
        owner.append(np.array([i]))
    if not flat:
        return np.zeros(0, np.uint32), np.zeros((2, len(text)), np.int64)
    order = np.concatenate(owner)
    table, first = np.concatenate(flat), np.zeros(len(text), np.int64)
    first[order] = np.cumsum(size[order]) - size[order]
    return table, np.stack([first, size])


class _Known:
    """Pieces that this worker has encoded, for the batches after; started anew when there are ``MOST_KNOWN`` of them."""

    def __init__(self) -> None:
        self.pieces, self.table, self.first, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's ids start, how many they are)."""
        at = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1)).astype(np.int64)
        if (at < 0).any():
            if len(self.pieces) + (at < 0).sum() > MOST_KNOWN:
                self.__init__()
                at[:] = -1
            new, missing = pieces.filter(pa.array(at < 0)), np.flatnonzero(at < 0)
            at[missing] = len(self.pieces) + np.arange(len(missing))
            table, (first, size) = _encode_pieces(new, path)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.first, self.size = np.r_[self.first, first + len(self.table)], np.r_[self.size, size]
            self.table = np.concatenate([self.table, table])
        return self.table, self.first[at], self.size[at]


_KNOWN: dict[str, _Known] = {}


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, number of ids of each text), without special tokens.

    The tokenizer drops white space and no word crosses it, so the ids of a text are those of its pieces between
    ASCII white space, and a worker encodes each distinct piece once in a while (tests compare with whole texts).
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    if not len(code):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    table, first, size = _KNOWN.setdefault(path, _Known()).places(coded.dictionary, path)
    each = size[code]
    ends = np.cumsum(each)
    gather = np.arange(int(ends[-1]), dtype=np.int32)
    gather += np.repeat((first[code] - (ends - each)).astype(np.int32), each)
    at = np.r_[0, ends][np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()]
    return table[gather], np.diff(at)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end_id`` after them."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


@dataclass(frozen=True)
class TokenFiles:
    """A written dataset. shards: (number, documents, ids) by number; bounded by the number of partitions."""

    folder: str
    id_bytes: int
    shards: tuple[tuple[int, int, int], ...]

    def bases(self) -> list[int]:
        """Ids before each shard."""
        return np.r_[0, np.cumsum([n for _, _, n in self.shards])][:-1].tolist()


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_bytes: int = 2, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every text and write the files, one shard per partition of a range split by doc_id."""
    spark, path = docs.sparkSession, tokenizer or vocabulary()
    bounded_batches(spark)
    folder = folder or new_path(spark, "tokens")
    kind = np.dtype(f"<u{id_bytes}")

    @lean
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, totals, offsets, owners = TaskContext.get().partitionId(), [0, 0], [np.zeros(1, np.int64)], []

        def ids_of(stream):
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, counts = with_end(*encode(part.column("text"), path), end_id)
                    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                        raise ValueError(f"id {ids.max()} needs more than {id_bytes} bytes")
                    stream.write(ids.astype(kind).tobytes())
                    offsets.append(totals[1] + np.cumsum(counts))
                    owners.append(np.asarray(pc.fill_null(part.column("doc_id"), int(NO_DOC)), dtype=np.int64))
                    totals[0] += len(counts)
                    totals[1] += len(ids)

        put(f"{folder}/{number:07d}.ids", ids_of)
        put(f"{folder}/{number:07d}.off", lambda s: s.write(np.concatenate(offsets).astype("<i8").tobytes()))
        put(f"{folder}/{number:07d}.doc", lambda s: s.write(np.concatenate([*owners, np.zeros(0, np.int64)]).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [number], "docs": [totals[0]], "ids": [totals[1]]})

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(shard, "shard long, docs long, ids long").collect()
    return TokenFiles(folder, id_bytes, tuple(sorted((r["shard"], r["docs"], r["ids"]) for r in rows)))


def _open(uri: str, kind: str, length: int) -> np.ndarray:
    """A file's integers: memory-mapped where the folder is mounted, else read whole."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if length == 0:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r", shape=(length,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read(spark: SparkSession, files: TokenFiles, docs_at_once: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of each document, from the files.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers.
    """
    shards = [(n, d, i, base) for (n, d, i), base in zip(files.shards, files.bases(), strict=True) if d]
    folder, id_bytes = files.folder, files.id_bytes

    @lean
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['shard']:07d}"
                off, doc = _open(f"{name}.off", "<i8", row["docs"] + 1), _open(f"{name}.doc", "<i8", row["docs"])
                ids = _open(f"{name}.ids", f"<u{id_bytes}", row["ids"])
                for lo in range(0, row["docs"], docs_at_once):
                    hi = min(lo + docs_at_once, row["docs"])
                    ends = np.asarray(off[lo : hi + 1])
                    block = memoryview(np.asarray(ids[ends[0] : ends[-1]]).astype("<u4")).cast("B")
                    crc = [zlib.crc32(block[4 * a : 4 * b]) for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]
                    owner = np.asarray(doc[lo:hi])
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(owner, mask=owner == NO_DOC), "start": row["base"] + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": pa.array(crc, pa.int64()), "shard": np.full(hi - lo, row["shard"])}
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(shards, "shard long, docs long, ids long, base long").repartition(len(shards))
    return listed.mapInArrow(documents, schema)


def encoded(docs: DataFrame, **options) -> DataFrame:
    """Write the files of ``docs`` and return what reading them back gives."""
    return read(docs.sparkSession, write(docs, **options))
