"""Language-model scores by a hashed, class-factored maximum-entropy model.

A known word has a path of three choices: f, the bits of its count in the training texts; g, a hash of its last two bytes;
u, further bits of its own hash. With a history h of the words before, a token has

    P(w | h) = (1 - unknown) * P(f | h) * P(g | f, h) * P(u | f, g, h) * P(w | f, g, u)

where the first three are softmaxes over hashed n-gram and skip features of h around the path's own frequencies, and the
last is the word's smoothed share of the few words of its path: frequent words have paths of their own, so the history
decides for the word itself. An unknown word has the Good-Turing mass and is then spelled out, byte by byte, so that the
probabilities of all words sum to one and the score is that of the text.

The weights have ``rows_for`` rows, about the square root of the training tokens, as vocabularies grow; what the model
gathers besides (counts of words) grows with the corpus. Training is synchronous: training documents are dealt to
``ROUNDS`` rounds by their ids, each round sums the gradient of its documents over all tasks at the same weights, in whole
units of ``UNIT`` so that no order of summing matters, and takes one step scaled by the curvature at the path frequencies.
Neither partitions nor chunks change the weights or a score.

The corpus goes through once into chunks of texts, stored as codes into the chunk's own sorted list of word hashes. Those
lists meet by hash range, where counts over all training texts are summed, and return to their chunk as a file beside it;
so a word crosses the network once a chunk and not once a document, and no vocabulary is broadcast.

Training texts are those with crc32 of the decimal doc_id mod 5 other than 1. A text ends with an end token.

Defined results: a null text is an empty one, of the end token alone; a null doc_id counts as the empty string; rows with
equal ids are rows of their own; without training texts every token is unknown; an empty table gives an empty table;
further columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import lean
from tessera.llm.store import bounded_batches, filesystem, new_path, put, saved
from tessera.llm.textkit import mix, slices, word_hashes, words

#: Choices of each kind, features of a history, rounds, tokens a step, texts a chunk in bytes, hash ranges at least.
N_F, N_G, N_U, FEATURES, ROUNDS = 32, 16, 16, 4, 6
WIDTH, PATHS = N_F + N_G + N_U, N_F * N_G * N_U
STEP_TOKENS, CHUNK_BYTES, RANGES, RANGE_WORDS = 1 << 15, 8 << 20, 64, 4_000_000
#: Step length (as many features as share a move), precision of the weights' Gaussian prior, largest move and weight, unit of summed gradients, rows a part.
RATE, PRIOR, MOST_MOVE, MOST_WEIGHT, UNIT, PART_ROWS = 1 / FEATURES, 20.0, 1.0, 8.0, 2.0**-20, 1 << 10
END, START = np.uint64(0x9AE16A3B2F90404F) & ~np.uint64(15), np.uint64(0xC3A5C85C97CB3127)
_MASK = np.uint64(15)
#: Natural logarithm of the probability of one byte of an unknown word, and of its going on and ending.
SPELL, GO_ON, STOP = -math.log(250), math.log(7 / 8), math.log(1 / 8)


def rows_for(tokens: int) -> int:
    """Rows of the weight table: a power of two of about twice the square root of the training tokens."""
    return 1 << max(10, round(math.log2(max(tokens, 1)) / 2 + 1))


def round_of(doc_id: int | None) -> int:
    """The round whose gradient a training document enters; ROUNDS for documents that are held out."""
    code = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return ROUNDS if code % 5 == 1 else code // 5 % ROUNDS


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _ids(distinct: pa.Array) -> np.ndarray:
    """Word hashes whose lowest four bits are the class g: a hash of the last two bytes."""
    plain = word_hashes(distinct)
    tails = np.fromiter((int.from_bytes(w[-2:], "little") for w in distinct.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(distinct))
    return (plain & ~_MASK) | (mix(tails + np.uint64(77)) & _MASK)


def _chunks(ranges: int):
    @lean
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, names = TaskContext.get().partitionId() << 32, ["chunk", "bucket", "x", "y", "ids", "z"]
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                codes, ends, distinct = words(batch.column("text"))
                owners = batch.column("doc_id").to_pylist()
                when = np.fromiter(map(round_of, owners), dtype=np.int64, count=len(owners))
                value = np.append(_ids(distinct), END)
                length = np.append(np.asarray(pc.binary_length(distinct), dtype=np.uint32), 0).astype(np.uint32)
                # Codes are ranks in the sorted hashes; equal hashes share a rank.
                ranked, first, rank = np.unique(value, return_index=True, return_inverse=True)
                length = length[first]
                tokens = rank[np.insert(codes, ends[1:], len(distinct))].astype(np.uint32)
                sizes = np.diff(ends) + 1
                count = np.bincount(tokens[np.repeat(when < ROUNDS, sizes)], minlength=len(ranked)).astype(np.uint32)
                to = ((ranked >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)].tolist()
                runs = list(zip(cuts[:-1], cuts[1:], strict=True))
                owner = np.repeat(when, sizes)
                for r in np.unique(when).tolist():
                    own = np.flatnonzero(when == r)
                    row = [[number], [-1 - r], [tokens[owner == r].tobytes()], [sizes[own].astype(np.uint32).tobytes()], [[owners[i] for i in own.tolist()]], [None]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=names)
                blobs = [pa.array([v[a:b].tobytes() for a, b in runs], pa.binary()) for v in (ranked, count, length)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(runs), pa.int64()), pa.array(to[cuts[:-1]].astype(np.int32)), blobs[0], blobs[1], pa.nulls(len(runs), pa.list_(pa.int64())), blobs[2]], names=names)
                number += 1

    return chunk


def paths_of(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f, g, u) of words; those of an unknown word are zeros."""
    f = np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, N_F - 1), 0)
    return f, np.where(count > 0, (value & _MASK).astype(np.int64), 0), np.where(count > 0, ((value >> np.uint64(4)) & _MASK).astype(np.int64), 0)


def _counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of a hash range: each chunk's words with their counts over all chunks (path -1), and the paths' sums (counts, words)."""
    parts = [(c, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint32), z.as_py()) for c, x, y, z in zip(table.column("chunk").to_pylist(), table.column("x"), table.column("y"), table.column("z"), strict=True)]
    value, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([p[2] for p in parts]), minlength=len(value)).astype(np.int64)
    known = total > 0
    f, g, u = paths_of(value[known], total[known])
    path = (f * N_G + g) * N_U + u
    mass, size = np.bincount(path, weights=total[known], minlength=PATHS), np.bincount(path, minlength=PATHS)
    some = np.flatnonzero(size)
    at = np.cumsum([0] + [len(p[1]) for p in parts])
    blobs = [total[place[a:b]].astype(np.int64).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    n, k = len(parts), len(some)
    return pa.table(
        {
            "chunk": pa.array([p[0] for p in parts] + [None] * k, pa.int64()),
            "bucket": pa.array([key[0].as_py()] * (n + k), pa.int32()),
            "x": pa.array([p[1].tobytes() for p in parts] + [None] * k, pa.binary()),
            "y": pa.array(blobs + [None] * k, pa.binary()),
            "z": pa.array([p[3] for p in parts] + [None] * k, pa.binary()),
            "path": pa.array([-1] * n + some.tolist(), pa.int32()),
            "mass": pa.array([0] * n + mass[some].astype(np.int64).tolist(), pa.int64()),
            "size": pa.array([0] * n + size[some].tolist(), pa.int64()),
        }
    )


def _filed(folder: str):
    def file(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A file of the chunk's words in order: their number, their hashes, their counts, their lengths in bytes."""
        chunk, order = key[0].as_py(), np.argsort(np.asarray(table.column("bucket")))
        value, count, length = (b"".join(table.column(c)[int(i)].as_py() for i in order) for c in ("x", "y", "z"))

        def write(stream):
            stream.write(np.int64(len(value) // 8).tobytes())
            stream.write(value)
            stream.write(count)
            stream.write(length)

        put(f"{folder}/{chunk:020d}.words", write)
        return pa.table({"chunk": pa.array([chunk], pa.int64())})

    return file


class Model:
    """Weights, path sums and what follows from them."""

    def __init__(self, mass: np.ndarray, size: np.ndarray, singles: int, weights: np.ndarray | None = None) -> None:
        """mass, size: counts and words of each path (f, g, u); singles: words that occur once."""
        self.tokens, self.words = int(mass.sum()), int(size.sum())
        self.z = self.tokens + 0.5 * (self.words + 1)
        self.unknown = min(0.5, max(singles, 0.5) / max(self.tokens, 1)) if self.tokens else 1.0
        self.smooth = mass + 0.5 * size
        share = lambda x, of: np.where(x > 0, np.log(np.maximum(x, 1e-9) / np.maximum(of, 1e-9)), -1e4).astype(np.float32)
        by_f, by_g = self.smooth.sum(axis=(1, 2)), self.smooth.sum(axis=2)
        self.bias_f, self.bias_g = share(by_f, by_f.sum()), share(by_g, by_f[:, None])
        self.bias_u = share(self.smooth, by_g[:, :, None]).reshape(N_F * N_G, N_U)
        # Curvature of each weight at the path frequencies.
        q = np.concatenate([by_f, by_g.sum(axis=0), self.smooth.sum(axis=(0, 1))]) / max(by_f.sum(), 1e-9)
        self.curve = q * (1 - q)
        self.weights = np.zeros((rows_for(self.tokens), WIDTH), np.float32) if weights is None else weights

    def known_log10(self, count: np.ndarray) -> np.ndarray:
        """The base's log10 probability of words with these counts."""
        return np.log10((count + 0.5) / self.z)

    def step(self, gradient: np.ndarray, tokens: np.ndarray) -> None:
        """One step against a round's gradients of the weights' rows, given its tokens that have each row as a feature."""
        move = RATE * (ROUNDS * gradient + PRIOR * self.weights) / (ROUNDS * tokens[:, None] * self.curve + PRIOR)
        self.weights = np.clip(self.weights - np.clip(move, -MOST_MOVE, MOST_MOVE), -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def contexts(value: np.ndarray, f: np.ndarray, g: np.ndarray, inside: np.ndarray, rows: int) -> np.ndarray:
    """(FEATURES, tokens): rows of the weight table for the word before, the one before that, and the paths of the last ones.

    inside: each token's place in its text. Words further back than the arrays begin must be of another text or not matter.
    """
    n = len(value)
    back = lambda x, k, none: np.where(inside >= k, np.r_[np.full(min(k, n), none, x.dtype), x[: max(n - k, 0)]], none)
    w1, w2 = back(value, 1, START), back(value, 2, START)
    cls = (f * N_G + g).astype(np.uint64)
    g64 = g.astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = (
            w1 * np.uint64(3) + np.uint64(1),
            w2 * np.uint64(5) + np.uint64(2),
            (back(cls, 1, np.uint64(1023)) * np.uint64(1024) + back(cls, 2, np.uint64(1023))) * np.uint64(7) + np.uint64(3),
            ((back(g64, 1, np.uint64(31)) * np.uint64(32) + back(g64, 2, np.uint64(31))) * np.uint64(32) + back(g64, 3, np.uint64(31))) * np.uint64(11) + np.uint64(4),
        )
    return np.stack([(mix(k) & np.uint64(rows - 1)).astype(np.int32) for k in keys])


def blocks(value: np.ndarray, paths: tuple, tokens: np.ndarray, sizes: np.ndarray, rows: int) -> Iterator[tuple]:
    """(first token, rows, f, g, u) of runs of ``STEP_TOKENS`` tokens of a chunk, so that memory does not follow the chunk."""
    starts = np.cumsum(sizes) - sizes
    for lo in range(0, len(tokens), STEP_TOKENS):
        hi, first = min(lo + STEP_TOKENS, len(tokens)), max(lo - 3, 0)
        part, place = tokens[first:hi], np.arange(first, hi)
        owner = np.searchsorted(starts, place, "right") - 1
        f, g, u = (p[part] for p in paths)
        at = contexts(value[part], f, g, place - starts[owner], rows)
        cut = lo - first
        yield lo, at[:, cut:], f[cut:], g[cut:], u[cut:]


def _exponentials(model: Model, rows: np.ndarray, f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the scores of all f given h, all g given h and f, all u given h, f and g. Weights are at most ``MOST_WEIGHT``, so none overflows."""
    s = np.take(model.weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        s += np.take(model.weights, r, axis=0, mode="clip")
    s[:, :N_F] += model.bias_f
    s[:, N_F : N_F + N_G] += np.take(model.bias_g, f, axis=0, mode="clip")
    s[:, N_F + N_G :] += np.take(model.bias_u, f * N_G + g, axis=0, mode="clip")
    np.exp(s, out=s)
    return s[:, :N_F], s[:, N_F : N_F + N_G], s[:, N_F + N_G :]


def gradients(model: Model, chunks: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(gradient in units, tokens of each row) of training ``chunks`` (hashes, counts, tokens, sizes), as integers."""
    rows = len(model.weights)
    total, seen = np.zeros((WIDTH, rows), np.int64), np.zeros(rows, np.int64)
    for value, count, tokens, sizes in chunks:
        for _, r, f, g, u in blocks(value, paths_of(value, count), tokens, sizes, rows):
            n, at = len(f), np.arange(len(f))
            error, lo = np.empty((WIDTH, n), np.float64), 0
            for e, own in zip(_exponentials(model, r, f, g), (f, g, u), strict=True):
                part = error[lo : lo + e.shape[1]]
                np.divide(e.T, e.sum(axis=1), out=part)
                part[own, at] -= 1
                lo += e.shape[1]
            # Whole units a token: sums are the same however tokens are dealt to blocks, chunks and tasks.
            np.rint(error / UNIT, out=error)
            seen += np.bincount(r.ravel(), minlength=rows)
            flat = r.ravel().astype(np.intp)
            for k in range(WIDTH):
                total[k] += np.bincount(flat, weights=np.tile(error[k], FEATURES), minlength=rows).astype(np.int64)
    return total.T, seen


def token_scores(model: Model, value: np.ndarray, count: np.ndarray, length: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each token of a chunk given those before it in its text."""
    f_all, g_all, u_all = paths = paths_of(value, count)
    with np.errstate(divide="ignore"):
        share = np.where(count > 0, np.log((count + 0.5) / np.maximum(model.smooth[f_all, g_all, u_all], 0.5)), 0.0)
    spelled = math.log(model.unknown) + length * (SPELL + GO_ON) + STOP
    score, known = np.empty(len(tokens)), math.log(max(1 - model.unknown, 1e-300))
    for lo, rows, f, g, u in blocks(value, paths, tokens, sizes, len(model.weights)):
        at, part = np.arange(len(f)), slice(lo, lo + len(f))
        p = known + share[tokens[part]]
        for e, own in zip(_exponentials(model, rows, f, g), (f, g, u), strict=True):
            p += np.log(np.maximum(e[at, own].astype(np.float64), 1e-300)) - np.log(np.maximum(e.sum(axis=1, dtype=np.float64), 1e-30))
        score[part] = np.where(f > 0, p, spelled[tokens[part]])
    return score / math.log(10)


def log10_scores(model: Model, value: np.ndarray, count: np.ndarray, length: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, its part of known tokens, base score, known tokens) of each text of a chunk."""
    starts = np.cumsum(sizes) - sizes
    total = lambda x: np.add.reduceat(x, starts)
    score = token_scores(model, value, count, length, tokens, sizes)
    return total(score), total(np.where(count[tokens] > 0, score, 0.0)), total(model.known_log10(count)[tokens]), total((count[tokens] > 0).astype(np.int64))


def _stored(folder: str, row: dict) -> tuple:
    """(hashes, counts, lengths, tokens, sizes, ids) of a chunk row and the file beside it."""
    system, path = filesystem(f"{folder}/{row['chunk']:020d}.words")
    with system.open_input_file(path) as stream:
        blob = stream.read()
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    value, count, length = np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n), np.frombuffer(blob, np.uint32, n, 8 + 16 * n)
    return value, count, length, np.frombuffer(row["x"], np.uint32), np.frombuffer(row["y"], np.uint32).astype(np.int64), row["ids"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunk rows, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summed(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' gradients of a part of the rows."""
    total = seen = 0
    for batch in parts:
        for g, n in zip(batch.column("g"), batch.column("n"), strict=True):
            total, seen = total + np.frombuffer(g.as_buffer(), np.int64), seen + np.frombuffer(n.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([total.tobytes()], pa.binary()), "n": pa.array([seen.tobytes()], pa.binary())})


def learned(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, Model]:
    """(chunk rows, folder of the chunks' words, model) of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark, CHUNK_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(RANGES, int(size // 40) // RANGE_WORDS)
    stored = saved(rows.mapInArrow(_chunks(ranges), "chunk long, bucket int, x binary, y binary, ids array<long>, z binary"), "chunks")
    lists = stored.where("bucket >= 0").select("chunk", "bucket", "x", "y", "z")
    counted = saved(lists.groupBy("bucket").applyInArrow(_counted, "chunk long, bucket int, x binary, y binary, z binary, path int, mass long, size long"), "counted")
    sums = counted.where("path >= 0").groupBy("path").agg(F.sum("mass").alias("mass"), F.sum("size").alias("size")).collect()
    mass, number = np.zeros(PATHS), np.zeros(PATHS)
    for r in sums:
        mass[r["path"]], number[r["path"]] = r["mass"], r["size"]
    folder = new_path(spark, "words")
    counted.where("path = -1").select("chunk", "bucket", "x", "y", "z").groupBy("chunk").applyInArrow(_filed(folder), "chunk long").agg(F.count("*")).collect()
    model = Model(mass.reshape(N_F, N_G, N_U), number.reshape(N_F, N_G, N_U), int(number.reshape(N_F, -1)[1].sum()))
    texts = stored.where("bucket < 0").select("chunk", "bucket", "x", "y", "ids")
    # Few tasks, so that their sums are small beside the texts.
    tasks = max(1, spark.sparkContext.defaultParallelism)
    for now in range(ROUNDS if model.tokens else 0):
        held = spark.sparkContext.broadcast(model)

        @lean
        def steps(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            def chunks():
                for row in _rows(batches):
                    value, count, _, tokens, sizes, _ = _stored(folder, row)
                    yield value, count, tokens, sizes

            g, n = gradients(held.value, chunks())
            starts = [k for k in range(0, len(n), PART_ROWS) if n[k : k + PART_ROWS].any()]
            yield pa.RecordBatch.from_pydict({"part": pa.array([k // PART_ROWS for k in starts], pa.int32()), "g": pa.array([g[k : k + PART_ROWS].tobytes() for k in starts], pa.binary()), "n": pa.array([n[k : k + PART_ROWS].tobytes() for k in starts], pa.binary())})

        part = texts.where(F.col("bucket") == -1 - now).coalesce(tasks).mapInArrow(steps, "part int, g binary, n binary")
        gradient, seen = np.zeros(model.weights.shape), np.zeros(len(model.weights))
        for r in part.groupBy("part").applyInArrow(_summed, "part int, g binary, n binary").toLocalIterator():
            at = slice(r["part"] * PART_ROWS, (r["part"] + 1) * PART_ROWS)
            gradient[at], seen[at] = np.frombuffer(r["g"], np.int64).reshape(-1, WIDTH) * UNIT, np.frombuffer(r["n"], np.int64)
        model = Model(mass.reshape(N_F, N_G, N_U), number.reshape(N_F, N_G, N_U), int(number.reshape(N_F, -1)[1].sum()), model.weights)
        model.step(gradient, seen)
    return texts, folder, model


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score (of the known tokens alone) of each row of ``docs``."""
    texts, folder, model = learned(docs, text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            value, count, length, tokens, sizes, ids = _stored(folder, row)
            s, part, base, known = log10_scores(held.value, value, count, length, tokens, sizes)
            out = np.full(len(ids), row["bucket"] == -1 - ROUNDS)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": out, "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(ids), held.value.tokens), "base_score": base, "score": s, "known_score": part})

    return texts.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double")
