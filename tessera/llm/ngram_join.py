"""Jaccard self-join of word n-gram sets by parity sketches.

A document's set holds its distinct shingles of five words. A parity sketch has a bit for each place that a hash can name,
and every shingle flips its bit: sketches differ in at most as many bits as the sets' symmetric difference has shingles,
and sets of similarity 0.75 or more differ in at most (|A| + |B|) / 7 of them.

* **Size bands.** Band k holds the sets of 2**k to 2**(k+1) - 1 shingles, and those up to a third larger again as the
  larger partner. Its packed sketch has 8 bits for each of 2**k members; that of the band above folds into it by XOR of
  its halves.
* **Pigeonhole.** A wide sketch with a bit for every 64-bit hash, never stored, is cut into 2**k runs of bits. Of T runs that
  are not empty at most d can differ, so two similar sets share one of the first d + 1 runs of each in any common order.
  A run is known by the XOR of the hashes of its set bits. The order takes runs without a very common shingle first,
  then runs with more shingles, so that passages that many documents share hardly ever meet.
* **Hot runs.** A run that a task emits ``HOT`` times or more is chained where it is, and only two of its members meet the
  rest of the corpus, so no task holds all members of a run that a third of the documents share.
* **Verification.** In each run, classes are first compared with their neighbours in the order of classes; the pairs
  that neither sizes nor the Hamming distance of packed sketches rule out are verified on the sets, and the links found
  make components. Runs of three classes or more whose members are still of different components are then compared
  in blocks, sketch against sketch, across components only: members outside a large run's main component meet the others,
  members of the main component never meet each other. Each class proposes its nearest while that joins many, and a last
  round verifies all that is left. So no link between different components is lost, though neither copies nor the
  members of a run are expanded into pairs.

Equal sets are one class (a 64-bit fingerprint), whose runs ("pieces") each task emits once. No cap on partners, candidates
or pieces is set anywhere.

Defined results: a text without words, an empty or a null one has an empty set and is its own component; a text of
fewer than five words has one shingle of all of them; rows with equal ids are rows of their own; a null doc_id is
never the smallest of a component; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.lean import lean, trim
from tessera.llm.rows import without
from tessera.llm.store import bounded_batches, saved
from tessera.llm.textkit import mix, shingles, slices, word_hashes, words

WIDTH = 5
#: Similarity from which on two documents link: 100 * intersection >= 75 * union.
PERCENT = 75
LEAST_BAND = 6
#: A shingle in more than this share of the documents of some stretch is common; it orders pieces, nothing else.
COMMON_SHARE = 1 / 1000
STRETCH = 1_000_000
#: Pieces to a bucket, about; a task of the piece join holds one bucket at a time.
BUCKET_PIECES = 1_500_000
#: Members of pieces that a task compares at a time, about, and those of one piece from which on it is cut into blocks.
CALL_MEMBERS, BLOCK = 100_000, 1 << 14
#: Pairs that a call compares, about; a call holds at most as many at a time.
CALL_TESTS = 1_000_000
#: The same as members in bytes of sketches.
CALL_BYTES, BLOCK_BYTES = 64 << 20, 32 << 20
#: Members of a piece in one task's stretch from which on they are chained there; salts of the join of classes and components.
HOT, SALTS = 64, 16
#: Document ids (8 bytes each) that are broadcast at most.
MOST_BROADCAST = 500_000


def linked(shared: int, a: int, b: int) -> bool:
    """Whether sets of sizes a and b with ``shared`` common members link."""
    return shared > 0 and 100 * shared >= PERCENT * (a + b - shared)


def farthest(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    least = -(-PERCENT * (a + b) // (100 + PERCENT))
    return a + b - 2 * least


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, ends, distinct = words(texts)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    found, to = shingles(hashes, ends, WIDTH)
    return [np.unique(found[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def class_of(s: np.ndarray) -> int:
    """Fingerprint of a set, as a signed 64-bit integer."""
    x = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mix(np.array([x ^ np.uint64(len(s))]))[0].astype(np.int64))


def band(n: int) -> int:
    return max(LEAST_BAND, n.bit_length() - 1)


def pieces(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece of each member, starts of the runs of equal pieces) in a band of 2**k pieces."""
    at = s >> np.uint64(64 - k)
    return at, np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]


def sketch(s: np.ndarray) -> bytes:
    """The packed parity bits of the set's own band: each member flips one of 8 * 2**k bits."""
    bits = 8 << band(len(s))
    place = (mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The pieces by which a set can meet a similar one, as hashes; ``common`` is sorted."""
    n, out = len(s), []
    own = band(n)
    roles = [(own, farthest(n, n * 100 // PERCENT) if n * 100 // PERCENT > n else 0)]
    roles[0] = (own, max(farthest(n, m) for m in {n, n * 100 // PERCENT, max(n * 100 // PERCENT - 1, n)}))
    least = -(-PERCENT * n // 100)
    if band(least) < own:
        roles.append((band(least), max(farthest(n, m) for m in {least, least + 1, min(n, (1 << own) - 1), min(n, (1 << own) - 2)} if m >= least)))
    frequent = np.zeros(n, bool)
    if len(common):
        place = np.minimum(np.searchsorted(common, s), len(common) - 1)
        frequent = common[place] == s
    mixed = mix(s)
    for k, far in roles:
        at, starts = pieces(s, k)
        value = np.bitwise_xor.reduceat(mixed, starts)
        token = mix(value ^ mix((at[starts] << np.uint64(8)) | np.uint64(k)))
        if far + 1 < len(starts):
            sizes = np.diff(np.r_[starts, n])
            all_common = np.logical_and.reduceat(frequent, starts)
            token = token[np.lexsort((token, -sizes, all_common))[: far + 1]]
        out.append(token)
    return np.concatenate(out)


@lean
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0: doc_id, class, size), of common shingles of a stretch (kind 1: shingle, documents) and of
    sketches (kind 2: class, size), one for each class and stretch."""
    held, count, docs = [], 0, 0

    def common() -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= max(3, math.ceil(COMMON_SHARE * docs))
        return pa.RecordBatch.from_pydict({"kind": np.ones(many.sum(), np.int32), "a": value[many].astype(np.int64), "b": n[many].astype(np.int64), "n": np.zeros(many.sum(), np.int64), "sketch": pa.nulls(int(many.sum()), pa.binary())})

    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = sets_of(batch.column("text"))
            classes = [class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(sets), np.int32), "a": batch.column("doc_id"), "b": pa.array(classes, pa.int64()), "n": np.array([len(s) for s in sets], np.int64), "sketch": pa.nulls(len(sets), pa.binary())})
            fresh = []
            for s, c in zip(sets, classes, strict=True):
                docs += 1
                if len(s) and c not in seen:
                    seen.add(c)
                    held.append(s)
                    fresh.append((c, len(s), sketch(s)))
                    count += len(s)
            if fresh:
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(fresh), 2, np.int32), "a": pa.array([x[0] for x in fresh], pa.int64()), "b": pa.nulls(len(fresh), pa.int64()), "n": pa.array([x[1] for x in fresh], pa.int64()), "sketch": pa.array([x[2] for x in fresh], pa.binary())})
            if count >= STRETCH:
                yield common()
                held, count, docs, seen = [], 0, 0, set()
    if held:
        yield common()


EMITTED = "bucket int, hot int, tokens binary, owners binary"


def _emitter(common, buckets: int, hot: int, stretch: int):
    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket (hot 0: its pieces and their owners; 1: the same of two members of each hot piece) and rows of
        hot pieces themselves (hot 2: whole pieces and all their owners in this stretch)."""
        known, tokens, owners, count, seen = common.value, [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            to = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            piece = (to << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
            order = np.lexsort((owner, piece))
            piece, owner = piece[order], owner[order]
            starts = np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(piece)])
            many = np.repeat(sizes >= hot, sizes)
            if many.any():
                ends = (starts + sizes - 1)[sizes >= hot]
                two = np.r_[starts[sizes >= hot], ends]
                two = two[np.argsort(piece[two], kind="stable")]
                yield from rows(piece[two], owner[two], 1)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1], pa.int32()), "hot": pa.array([2], pa.int32()), "tokens": pa.array([piece[many].tobytes()], pa.binary()), "owners": pa.array([owner[many].tobytes()], pa.binary())})
            if not many.all():
                yield from rows(piece[~many], owner[~many], 0)

        def rows(piece: np.ndarray, owner: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            to, low = (piece >> np.uint64(32)).astype(np.int32), piece.astype(np.uint32)
            cuts = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)].tolist()
            runs = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to[cuts[:-1]], pa.int32()), "hot": pa.array([kind] * len(runs), pa.int32()), "tokens": pa.array([low[a:b].tobytes() for a, b in runs], pa.binary()), "owners": pa.array([owner[a:b].tobytes() for a, b in runs], pa.binary())})

        for whole in batches:
            for batch in slices(whole, "text"):
                for s in sets_of(batch.column("text")):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    token = signatures(s, known)
                    tokens.append(token)
                    owners.append(np.full(len(token), c, np.int64))
                    count += len(token)
                if count >= stretch:
                    yield from flush()
                    tokens, owners, count = [], [], 0
        if tokens:
            yield from flush()

    return emit


MET = "kind int, a long, b long, n long"


def _chained(piece: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of owners that are neighbours in a piece, how many pieces) of sorted pieces and owners."""
    next_to = np.flatnonzero(piece[1:] == piece[:-1]) if len(piece) else np.zeros(0, np.int64)
    pairs = np.stack([owner[next_to], owner[next_to + 1]], axis=1) if len(next_to) else np.zeros((0, 2), np.int64)
    return np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))


@lean
def _hot_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hot pieces in a stretch: pairs of neighbours (kind 0) and members (kind 2: piece, class)."""
    for batch in batches:
        for t, o in zip(batch.column("tokens"), batch.column("owners"), strict=True):
            piece, owner = np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(o.as_buffer(), np.int64)
            pairs, shared = _chained(piece, owner)
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(pairs), np.int32), "a": pairs[:, 0].copy(), "b": pairs[:, 1].copy(), "n": shared.astype(np.int64)})
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(piece), 2, np.int32), "a": piece, "b": owner, "n": np.zeros(len(piece), np.int64)})


def _meetings(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of a bucket: pairs of classes that are neighbours in a piece (kind 0: a, b, pieces), members of larger pieces (kind 1: the
    group's hash, class), and members of pieces that are hot in some stretch (kind 2: piece, class)."""
    token = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("tokens")])
    owner = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("owners")])
    hot = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x, h in zip(table.column("tokens"), table.column("hot").to_pylist(), strict=True) if h)]))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    token, owner = token[twice], owner[twice]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    if len(token):
        fresh = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        token, owner = token[fresh], owner[fresh]
    pairs, shared = _chained(token, owner)
    a, b, n, kind = [pairs[:, 0]], [pairs[:, 1]], [shared], [np.zeros(len(pairs), np.int32)]
    if len(token):
        starts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1]
        sizes = np.diff(np.r_[starts, len(token)])
        group = np.bitwise_xor.reduceat(mix(owner.astype(np.uint64)), starts).astype(np.int64)
        known = np.isin(token[starts], hot)
        _, first = np.unique(group, return_index=True)
        large = np.zeros(len(starts), bool)
        large[first] = sizes[first] > 2
        large &= ~known
        for which, name, number in ((large, group, 1), (known, (np.int64(key[0].as_py()) << 32) | token[starts].astype(np.int64), 2)):
            rows = np.repeat(which, sizes)
            a.append(np.repeat(name, sizes)[rows])
            b.append(owner[rows])
            n.append(np.repeat(sizes, sizes)[rows])
            kind.append(np.full(int(rows.sum()), number, np.int32))
    trim()
    return pa.table({"kind": np.concatenate(kind), "a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n).astype(np.int64)})


def _distinct_groups(members: DataFrame) -> DataFrame:
    """(piece, cls) of one piece of all those that have the same members."""
    members = saved(members.distinct(), "hot")
    marks = members.groupBy("piece").agg(F.bit_xor(F.xxhash64("cls")).alias("mark"), F.count("*").alias("n"))
    kept = marks.where("n > 2").groupBy("mark", "n").agg(F.min("piece").alias("piece")).select("piece")
    return members.join(kept, "piece", "left_semi")


def _maybe(classes: DataFrame, column: str):
    """A bitmap in which every value of ``column`` has its bit: 16 bits a value, 16 MB at most. It only spares work."""
    spark = classes.sparkSession
    bits = max(1 << 16, 1 << min(27, max(classes.count(), 1).bit_length() + 4))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words_ = classes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(bits // 64, np.uint64)
    rows = words_.toArrow()
    table[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).astype(np.uint64)
    return spark.sparkContext.broadcast(table)


def _payloads(docs: DataFrame, classes: DataFrame, table: DataFrame) -> DataFrame:
    """(cls, members) of the classes in ``classes``, once each.

    While they are few, only a document of each class is read for it, by a broadcast of at most ``MOST_BROADCAST`` ids;
    beyond that every document is hashed again and a bitmap picks them out.
    """
    classes = saved(classes, "wanted")
    if classes.count() <= MOST_BROADCAST:
        ids = table.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("rep")).select("rep").distinct()
        docs = docs.join(F.broadcast(saved(ids, "reps")), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    maybe = _maybe(classes, "cls")

    @lean
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = maybe.value, set()
        mask = len(table) * 64 - 1
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for s in sets_of(batch.column("text")):
                    if len(s) and (c := class_of(s)) not in seen and (int(table[(c & mask) >> 6]) >> (c & 63)) & 1:
                        seen.add(c)
                        rows.append((c, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "members"])

    found = docs.mapInArrow(compute, "cls long, members binary")
    return found.join(classes, "cls", "left_semi").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                ok = 100 * len(x) >= PERCENT * len(y)
                if ok:
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    ok = linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    x = payload.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    y = payload.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of a band as they are in the band below."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither sizes nor sketches rule out."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(batch.column("x"), batch.column("y"), batch.column("m").to_pylist(), batch.column("n").to_pylist(), strict=True):
                ok = 100 * min(m, n) >= PERCENT * max(m, n)
                if ok:
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    x, y = (_folded(x) if len(x) > len(y) else x), (_folded(y) if len(y) > len(x) else y)
                    ok = len(x) == len(y) and int(np.bitwise_count(x ^ y).sum()) <= farthest(m, n)
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    x = sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("m"))
    y = sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y"), "n")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(check, "a long, b long")


def _apart(sketches: list[bytes], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distance of sketches i and j, in the band of the smaller set; -1 where bands are further apart."""
    bands = np.array([band(int(x)) for x in sizes])
    place, tables, folds = np.zeros(len(sizes), np.int64), {}, {}
    for k in np.unique(bands).tolist():
        at = np.flatnonzero(bands == k)
        place[at] = np.arange(len(at))
        tables[k] = np.stack([np.frombuffer(sketches[x], np.uint64) for x in at.tolist()])
    i, j = np.where(bands[i] <= bands[j], i, j), np.where(bands[i] <= bands[j], j, i)
    out = np.full(len(i), -1)
    for k in tables:
        for up in (0, 1):
            if k + up in tables:
                if up and k + 1 not in folds:
                    folds[k + 1] = _folded(tables[k + 1])
                x, y = tables[k], folds[k + 1] if up else tables[k]
                some = np.flatnonzero((bands[i] == k) & (bands[j] == k + up))
                step = max(1, (8 << 20) >> k)
                for lo in range(0, len(some), step):
                    part = some[lo : lo + step]
                    out[part] = np.bitwise_count(x[place[i[part]]] ^ y[place[j[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _survivors(every: bool):
    """A function of the pieces in a call (or of two blocks of a large one) and of their classes' sketches that gives pairs of
    different components which neither sizes nor sketches rule out: all of them, or for each class its nearest."""

    def compare(key: tuple[pa.Scalar, ...], members: pa.Table, kinds: pa.Table) -> pa.Table:
        value, size, of = (np.asarray(kinds.column(c)) for c in ("cls", "n", "root"))
        by_value = np.argsort(value, kind="stable")
        value, size, of = value[by_value], size[by_value], of[by_value]
        raw = kinds.column("sketch")
        sketches = [raw[int(x)].as_py() for x in by_value]
        piece, cls, side = (np.asarray(members.column(c)) for c in ("piece", "cls", "side"))
        known = np.isin(cls, value)
        piece, side, place = piece[known], side[known], np.searchsorted(value, cls[known])
        order = np.argsort(piece, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(piece[order])) + 1, len(order)].tolist()
        seen, held, count = [], [], 0

        def tested() -> None:
            nonlocal held, count
            codes = np.unique(np.concatenate(held))
            held, count = [], 0
            i, j = np.divmod(codes, len(value))
            apart = _apart(sketches, size, i, j)
            least = -(-PERCENT * (size[i] + size[j]) // (100 + PERCENT))
            near = (apart >= 0) & (apart <= size[i] + size[j] - 2 * least)
            seen.append(np.stack([i[near], j[near], apart[near]]))

        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            inside, half = place[at], side[at]
            roots, number = np.unique(of[inside], return_counts=True)
            if len(roots) < 2:
                continue
            # Members of the piece's largest component meet only the others, so a group of copies costs its outsiders alone.
            main = of[inside] == roots[np.argmax(number)]
            inside, half = np.r_[inside[main], inside[~main]], np.r_[half[main], half[~main]]
            base, step = int(main.sum()), max(1, CALL_TESTS // len(inside))
            for lo_row in range(base, len(inside), step):
                rows = np.arange(lo_row, min(lo_row + step, len(inside)))
                m, n = size[inside[rows]][:, None], size[inside][None, :]
                ok = (of[inside[rows]][:, None] != of[inside][None, :]) & (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n))
                ok[:, base:] &= np.arange(base, len(inside))[None, :] > rows[:, None]
                if key[1].as_py() != key[2].as_py():
                    ok &= half[rows][:, None] != half[None, :]
                x, y = np.nonzero(ok)
                if len(x):
                    i, j = inside[rows[x]], inside[y]
                    held.append(np.minimum(i, j) * len(value) + np.maximum(i, j))
                    count += len(x)
                    if count > CALL_TESTS:
                        tested()
        if held:
            tested()
        i, j, apart = np.unique(np.concatenate(seen, axis=1), axis=1) if seen else np.zeros((3, 0), np.int64)
        if not every and len(i):
            i, j, apart = np.r_[i, j], np.r_[j, i], np.r_[apart, apart]
            best = np.lexsort((apart, i))
            i, j = i[best], j[best]
            first = np.r_[True, i[1:] != i[:-1]]
            i, j = i[first], j[first]
        a, b = value[i], value[j]
        del seen, sketches, raw
        trim()
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compare


def _across(groups: DataFrame, roots: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) that meet in a piece of three or more classes, are in different components and may link.

    Small pieces share calls: those with the same smallest class go together, as far as a call's load allows, since pieces
    of similar documents have much the same members, and a call needs each class's sketch once. A large one is cut into blocks: those of the members outside its main component (as many as
    they need) and those of the others; a call holds an outer block and another block, so that the rows are the pieces'
    members times their outer blocks and never the square of a group that has already been joined.
    """
    rooted = sketches.select("cls", F.octet_length("sketch").cast("long").alias("bytes")).join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = saved(rooted, "rooted")
    by_root = groups.join(rooted, "cls").groupBy("piece", "root").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"), F.min("cls").alias("least"))
    load = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    main = F.struct("members", "bytes", "root")
    mixed = by_root.groupBy("piece").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.max(main).alias("main"), F.count("*").alias("roots"), F.min("least").alias("least")).where("roots > 1")
    outer = load(F.col("members") - F.col("main.members"), F.col("bytes") - F.col("main.bytes"))
    tests = (F.col("members").cast("double") * (F.col("members") - F.col("main.members"))).alias("tests")
    mixed = mixed.select("piece", "least", "members", "bytes", tests, F.col("main.root").alias("main"), (load(F.col("members"), F.col("bytes")) == 1).alias("small"), outer.alias("outer"), load(F.col("main.members"), F.col("main.bytes")).alias("inner"))
    share = F.when(F.col("small"), F.col("members") / CALL_MEMBERS + F.col("bytes") / CALL_BYTES + F.col("tests") / CALL_TESTS).otherwise(0.0)
    mixed = mixed.withColumn("chunk", F.floor(F.sum(share).over(Window.partitionBy("least").orderBy("piece"))))
    mixed = saved(mixed, "mixed")
    sums = mixed.where("small").agg(F.sum("members"), F.sum("bytes"), F.sum("tests")).first()
    calls = max(1, (sums[0] or 0) // CALL_MEMBERS, (sums[1] or 0) // CALL_BYTES, int((sums[2] or 0) // CALL_TESTS))
    spread = groups.join(mixed.drop("members", "bytes", "tests"), "piece").join(rooted.select("cls", "root"), "cls").withColumn("out", F.col("root") != F.col("main"))
    own = F.when(F.col("out"), F.pmod(F.xxhash64("cls"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("cls"), F.col("inner"))).cast("int")
    others = F.when(F.col("out"), F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    spread = spread.withColumn("own", F.when(F.col("small"), F.lit(0)).otherwise(own)).withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0))).otherwise(others)))
    call = F.when(F.col("small"), F.pmod(F.xxhash64("least", "chunk"), F.lit(calls))).otherwise(F.col("piece"))
    members = saved(spread.select("small", call.alias("call"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "piece", F.col("own").alias("side"), "cls"), "members")
    keys = ("call", "lo", "hi", "small")
    kinds = members.select(*keys, "cls").distinct().join(sketches, "cls").join(rooted.select("cls", "root"), "cls").select(*keys, "cls", "n", "root", "sketch")
    kinds = kinds.select(*(F.col(c).alias(f"{c}2") for c in kinds.columns)).toDF(*kinds.columns)
    return members.toDF(*members.columns).groupBy(*keys).cogroup(kinds.groupBy(*keys)).applyInArrow(_survivors(every), "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n) of each row of ``docs``, and (node, root) of the classes that links join to others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    summary = saved(rows.mapInArrow(_summaries, "kind int, a long, b long, n long, sketch binary"), "summary")
    table = summary.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), "n")
    total = table.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
    limit = max(3, math.ceil(COMMON_SHARE * (total["docs"] or 0) / 2))
    # At most 2 / COMMON_SHARE times a document's mean size: a bound that does not grow with the documents.
    frequent = summary.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= limit).select("a").toArrow()
    common = spark.sparkContext.broadcast(np.sort(np.asarray(frequent.column("a")).astype(np.int64).view(np.uint64)))
    buckets = max(64, -(-int(total["n"] or 0) // BUCKET_PIECES))
    emitted = saved(rows.mapInArrow(_emitter(common, buckets, HOT, STRETCH), EMITTED), "emitted")
    met = emitted.where("hot < 2").groupBy("bucket").applyInArrow(_meetings, MET)
    met = saved(met.union(emitted.where("hot = 2").select("tokens", "owners").mapInArrow(_hot_meetings, MET)), "met")
    pairs = met.where("kind = 0").select("a", "b").distinct()
    named = lambda kind: met.where(F.col("kind") == kind).select(F.col("a").alias("piece"), F.col("b").alias("cls"))
    groups = saved(named(1).distinct().union(_distinct_groups(named(2))), "groups")
    seen = met.where("kind = 0").select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sketches = summary.where("kind = 2").select(F.col("a").alias("cls"), "n", "sketch").join(seen, "cls", "left_semi").dropDuplicates(["cls"])
    sketches = saved(sketches, "sketches")
    tested = saved(_near(pairs, sketches), "near")
    payload = saved(_payloads(rows, tested.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), table), "payload")
    links = saved(_verified(tested, payload), "links")
    roots = saved(components(links), "roots")
    every = False
    while True:
        # Meetings in larger pieces, across components only; what has been tested is left out, and the last round tests all.
        more = saved(_across(groups, roots, sketches, every).join(tested, ["a", "b"], "left_anti"), "near")
        if not more.isEmpty():
            fresh = more.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(payload, "cls", "left_anti")
            if not fresh.isEmpty():
                payload = saved(payload.union(_payloads(rows, fresh, table)), "payload")
            found = saved(_verified(more, payload), "links")
            tested = saved(tested.union(more), "tested")
            if not found.isEmpty():
                before = links.count()
                links = saved(links.union(found), "links")
                roots = saved(components(links), "roots")
                if not every and 20 * found.count() > before:
                    continue
        if every:
            return table, roots
        every = True


def joined(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    table, roots = classes(docs, text)
    full = table.where("cls is not null")
    first = full.groupBy("cls").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    first = saved(first, "classes")
    alone = first.where("root is null").select(F.col("cls").alias("of"), F.col("first").alias("component_id"), F.lit(1).cast("long").alias("n_classes"))
    merged = first.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_classes"))
    # Each component's row meets its classes in SALTS places, as one component may hold very many of them.
    merged = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = first.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    placed = saved(first.join(merged, ["root", "salt"]).select(F.col("cls").alias("of"), "component_id", "n_classes").union(alone), "placed")
    found = full.join(placed, F.col("cls") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_classes")
    return found.union(table.where("cls is null").select("doc_id", "n", "doc_id", F.lit(0).cast("long")))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one for each id.

    A row without an id cannot be told from others and is kept.
    """
    groups = joined(docs, text)
    rest = without(docs, groups.where("doc_id <> component_id").select("doc_id"), {"doc_id": F.col("doc_id")})
    again = saved(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rest
    return without(rest, again, {"doc_id": F.col("doc_id")}).union(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*rest.columns))


ORACLE = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where 100 * c >= 75 * (i.n + j.n - c)),
e as (select x, y from l union all select y, x from l),
reach(a, b) as (select doc_id, doc_id from d union select r.a, e.y from reach r join e on r.b = e.x),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from d join c using (doc_id) left join n using (doc_id)
"""
