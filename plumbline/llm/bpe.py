"""Byte-level BPE: ranked merges folded over byte arrays by Spark's higher-order functions.

Texts are cut into pieces by the tokenizer's pattern. A task sends each distinct piece once, as an array of
bytes, through a Spark expression that folds the merges over it: of all neighbouring tokens, the pair of the
lowest rank becomes one token, until no pair has a rank. The fold's state is one array of longs, for each token
the rank of the pair that it makes with the next one, and the token: the least entry is the leftmost pair to
merge. The ranks are the value of a scalar subquery over a local row, so that no description of a plan spells them
out: one array for pairs of bytes, and for pairs of tokens a map laid out in two arrays, where the first token
picks the row and the second the place in it. The same rows come back with the ids and with the bytes that
concatenating the tokens' binary pieces gives, and the task strings its texts together from them. No text moves, so
nothing is skewed, and the work a task repeats after a loss is its own. Pieces that are common in a bounded sample
of the texts are folded beforehand, once for all tasks, and broadcast: that saves work, and changes no result.

Pieces that are a token need no fold and are looked up. As the fold copies its state at each merge, which is
quadratic in a piece's length, pieces of more than LONG bytes are merged with a heap instead, to the same ids.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm._spark import release, small_batches, text_bytes, written

#: Texts that wait for their pieces, at most (a longer text waits alone), and bytes of pieces in a row.
TEXT_BYTES = 4 << 20
ROW_BYTES = 16 << 10
#: A task forgets its pieces beyond so many, and sends them anew.
KNOWN = 1 << 18
ID_BITS = 18
LONG = 256
#: Tokens of a long piece that travel as one.
RUN = 1024
#: Pieces that are common in a sample of about so many bytes of text are folded once, for all tasks; so many at most.
SAMPLE_BYTES, COMMON = 64 << 20, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold in plain Python: a heap of neighbouring pairs, linear in the piece's length but for the heap."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heap.append((rank, i, end[j])) if not ready else heapq.heappush(heap, (rank, i, end[j]))

    ready = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has merged otherwise since
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def rows_of(pairs: dict[tuple[int, int], int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A map from pairs of ids in two arrays: pair (a, b) is at place shift[a] + b, as a << ID_BITS | value.

    Rows, the fullest first, take the first shift at which all their places are free.
    """
    by_first: dict[int, list[tuple[int, int]]] = {}
    for (a, b), value in pairs.items():
        by_first.setdefault(a, []).append((b, value))
    free = np.ones(size * 2 + len(pairs) * 2, bool)
    table, shift = np.full(len(free), -1, np.int64), np.zeros(size, np.int64)
    spare = np.zeros(0, np.int64)
    singles = []
    for a, row in sorted(by_first.items(), key=lambda x: -len(x[1])):
        if len(row) == 1:
            singles.append((a, *row[0]))
            continue
        seconds = np.sort(np.array([b for b, _ in row]))
        at = 0
        while True:
            window = np.flatnonzero(free[at : at + (1 << 12)]) + at - seconds[0]
            window = window[window >= -int(seconds[0])]
            fits = window[free[window[:, None] + seconds[None, 1:]].all(1)] if len(window) else window
            fits = fits[fits >= 0]
            if len(fits):
                shift[a] = fits[0]
                break
            at += 1 << 12
        free[shift[a] + seconds] = False
        for b, value in row:
            table[shift[a] + b] = a << ID_BITS | value
    spare = np.flatnonzero(free)
    used = 0
    for a, b, value in sorted(singles, key=lambda x: x[1]):
        while spare[used] < b:
            used += 1
        shift[a] = spare[used] - b
        table[spare[used]] = a << ID_BITS | value
        used += 1
    last = int(np.flatnonzero(table >= 0)[-1]) if len(pairs) else 0
    return shift, table[: last + 1]


def bound(value: Column, use) -> Column:
    """use(value), with value computed once, and once in the plan: a fold over nothing, which begins with value and ends with use."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


class Vocabulary:
    """Expressions over tables of ranks, which a scalar subquery holds. Every single byte must be a token.

    As literals, the tables would be spelt out in each description of a plan, and the driver keeps these.
    """

    def __init__(self, ranks: dict[bytes, int], spark: SparkSession):
        self.size = max(ranks.values()) + 1
        if self.size >= 1 << ID_BITS or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks need every byte, and ids of at most 18 bits")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        shift, table = rows_of(pairs, self.size)
        single = [ranks[bytes([b])] for b in range(256)]
        self.none = self.size << ID_BITS
        first = [pairs.get((a, b), self.size) << ID_BITS | a for a in single for b in single]
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token

        # Any second id is a place in the table.
        places = np.concatenate([table, np.full(self.size, -1, np.int64)])
        tables = {"shift": pa.array(shift), "table": pa.array(places), "pair": pa.array(first, pa.int64()), "last": pa.array([self.none | a for a in single], pa.int64()), "tokens": pa.array(tokens, pa.binary())}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in tables.values()]
        self.tables = spark.createDataFrame(pa.table(lists, list(tables))).select(F.struct("*")).scalar()

    def folded(self, frame: DataFrame) -> DataFrame:
        """The frame with ids and decoded in place of pieces and given.

        ids: token ids of each of the pieces, which are arrays of byte values; where ids are given, these. decoded:
        the bytes of each of the pieces. A subquery may not be written within a higher-order function, so it is a
        column first; as one expression uses it once, the optimizer puts it there, and no row carries the tables.
        """
        kept = [c for c in frame.columns if c not in ("pieces", "given")]
        made = bound(F.col("tables"), lambda x: bound(self._ids(x, F.col("pieces"), F.col("given")), lambda ids: F.struct(ids.alias("ids"), self._bytes(x, ids).alias("decoded"))))
        return frame.withColumn("tables", self.tables).select(*kept, made.alias("made")).select(*kept, "made.ids", "made.decoded")

    def _ids(self, tables: Column, pieces: Column, given: Column) -> Column:
        def each(shift: Column, table: Column, pair: Column, last: Column) -> Column:
            fold = lambda piece: self._encode(piece, shift, table, pair, last)
            return F.zip_with(pieces, given, lambda piece, ids: F.when(F.size(piece) == 0, ids).otherwise(fold(piece)))

        return bound(tables["shift"], lambda shift: bound(tables["table"], lambda table: bound(tables["pair"], lambda pair: bound(tables["last"], lambda last: each(shift, table, pair, last)))))

    def _bytes(self, tables: Column, pieces: Column) -> Column:
        """The tokens' bytes of each of the pieces, put together."""
        return bound(tables["tokens"], lambda tokens: F.transform(pieces, lambda ids: F.aggregate(ids, F.lit(b""), lambda a, i: F.concat(a, F.get(tokens, i)))))

    def _encode(self, piece: Column, shift: Column, table: Column, pair: Column, last: Column) -> Column:
        long = lambda x: F.lit(x).cast("long")
        token = lambda x: x.bitwiseAND(long((1 << ID_BITS) - 1))
        n = F.size(piece)

        def entry(a: Column, b: Column) -> Column:
            """The rank of the pair of tokens a and b, and a."""
            found = F.get(table, (F.get(shift, a) + b).cast("int"))
            return F.when(F.shiftright(found, ID_BITS) == a, F.shiftleft(token(found), ID_BITS)).otherwise(long(self.none)).bitwiseOR(a)

        def step(state: Column, _: Column) -> Column:
            def at_place(at: Column) -> Column:
                low = F.get(state, at - 1)
                made = F.shiftright(low, ID_BITS)
                before = entry(token(F.get(state, at - 2)), made)
                own = F.when(at + 1 < F.size(state), entry(made, token(F.get(state, at + 1)))).otherwise(made.bitwiseOR(long(self.none)))
                # Flattening copies an array at a time, where concat goes through a lazy list of elements.
                first, rest = F.slice(state, F.lit(1), at - 2), F.slice(state, at + 2, n)
                merged = F.when(at > 1, F.flatten(F.array(first, F.array(before, own), rest))).otherwise(F.flatten(F.array(F.array(own), rest)))
                return F.when(low < long(self.none), merged).otherwise(state)

            return bound(F.array_position(state, F.array_min(state)).cast("int"), at_place)

        begin = F.transform(piece, lambda b, i: F.when(i + 1 < n, F.get(pair, b.cast("int") * 256 + F.get(piece, i + 1))).otherwise(F.get(last, b)))
        folded = F.aggregate(F.slice(piece, F.lit(2), n), begin, step)
        return F.transform(folded, lambda x: token(x).cast("int"))


def packed(new: list[bytes | list[int]]) -> tuple[pa.Array, pa.Array, list[int]]:
    """New pieces, as arrays of byte values, some to a row; of those whose ids are known, these."""
    data = [x if isinstance(x, bytes) else b"" for x in new]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    values = np.frombuffer(b"".join(data), np.uint8).astype(np.int16)
    weight = np.cumsum([4 + len(x) for x in new])
    cuts = np.unique(np.append(np.searchsorted(weight, np.arange(0, weight[-1], ROW_BYTES)), len(data)))
    pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    ids = [x if isinstance(x, list) else [] for x in new]
    given = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array([i for x in ids for i in x], pa.int32()))
    ends = pa.array(cuts, pa.int32())
    return pa.ListArray.from_arrays(ends, pieces), pa.ListArray.from_arrays(ends, given), cuts.tolist()


def _cut(pattern: str, ranks, common):
    """Batches of rows with pieces that are new to the task, each before the rows with the texts they are of."""
    names = ["row", "pieces", "given", "numbers", "anew"]
    listed = pa.list_(pa.list_(pa.int16())), pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, schema, often = regex.compile(pattern), None, common.value
        known, runs, most = dict(often), {}, len(often) + KNOWN

        def rows(new: list[bytes | list[int]]) -> Iterator[pa.RecordBatch]:
            pieces, given, _ = packed(new)
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, schema.field(0).type), pieces, given, pa.nulls(n, pa.list_(pa.int32())), pa.array([False] * n)], names=names)

        def flush(at: pa.Array, numbers: list[list[int]], new: list, anew: bool) -> Iterator[pa.RecordBatch]:
            empty = lambda n: [pa.nulls(n, t) for t in listed]
            if anew:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), *empty(1), pa.nulls(1, pa.list_(pa.int32())), pa.array([True])], names=names)
            if new:
                yield from rows(new)
            yield pa.RecordBatch.from_arrays([at, *empty(len(at)), pa.array(numbers, pa.list_(pa.int32())), pa.array([False] * len(at))], names=names)

        def add(piece: str) -> list[int]:
            """Numbers of a piece that is new; a long one is several."""
            data = piece.encode()
            if data in ranks.value:
                parts = [[ranks.value[data]]]
            elif len(data) <= LONG:
                parts = [data]
            else:
                ids = merge(data, ranks.value)
                parts = [ids[i : i + RUN] for i in range(0, len(ids), RUN)]
            begin = used[0]
            new.extend(parts)
            used[0] += len(parts)
            return list(range(begin, used[0]))

        used = [len(often)]
        for batch in batches:
            schema = batch.schema
            texts, begin, size, numbers, new, anew = batch.column("text"), 0, 0, [], [], False
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if len(known) > most and not numbers:
                    known, runs, anew, used[0] = dict(often), {}, True, len(often)
                pieces = find.findall(text)
                line = list(map(known.get, pieces))
                at, several = -1, False
                for _ in range(line.count(None)):  # pieces that are new, or several tokens' runs
                    at = line.index(None, at + 1)
                    x = pieces[at]
                    if x not in known and x not in runs:
                        made = add(x)
                        if len(made) == 1:
                            known[x] = made[0]
                        else:
                            runs[x] = made
                    line[at] = known.get(x)
                    several |= line[at] is None
                if several:
                    line = [m for x, n in zip(pieces, line) for m in ((n,) if n is not None else runs[x])]
                numbers.append(line)
                size += len(text)
                if size >= TEXT_BYTES or len(known) > most or i + 1 == len(texts):
                    yield from flush(batch.column("row").slice(begin, i + 1 - begin), numbers, new, anew)
                    begin, size, numbers, new, anew = i + 1, 0, [], [], False
        known, runs = {}, {}
        release()

    return run


def gather(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges offsets[c] to offsets[c + 1] of values, one after another, and how long each is."""
    first = offsets[chosen]
    many = offsets[chosen + 1] - first
    step = np.int32 if len(values) + int(many.sum()) < 2**31 else np.int64
    at = np.arange(int(many.sum()), dtype=step) + np.repeat((first - (np.cumsum(many) - many)).astype(step), many)
    return values[at], many


def _string(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """Texts as the ids and the bytes of their pieces."""
    parts: dict[str, list] = {"ids": [], "bytes": []}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = dict(common.value)

    def settle() -> None:
        for name, new in parts.items():
            if new:
                values, offsets = held[name]
                held[name] = (np.concatenate([values, *(v for v, _ in new)]), np.concatenate([offsets, *(o for _, o in _shifted(new, offsets[-1]))]))
                new.clear()

    for batch in batches:
        numbers, pieces, anew = batch.column("numbers"), batch.column("ids"), batch.column("anew")
        texts = []
        for i in range(batch.num_rows):
            if anew[i].as_py():
                held = dict(common.value)
                for new in parts.values():
                    new.clear()
            elif numbers[i].is_valid:
                texts.append(i)
                last = i + 1 == batch.num_rows or not numbers[i + 1].is_valid
                if last or len(texts) >= 256:
                    settle()
                    yield _texts(batch.column("row").take(pa.array(texts)), numbers.take(pa.array(texts)), held)
                    texts = []
            elif pieces[i].is_valid:
                lists = pieces[i].values
                parts["ids"].append((lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())))
                blobs = batch.column("decoded")[i].values
                lengths = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1])
                parts["bytes"].append((np.frombuffer(b"".join(blobs.to_pylist()), np.uint8), lengths))


def _shifted(new: list, at: int):
    for values, lengths in new:
        ends = at + np.cumsum(lengths)
        at = ends[-1] if len(ends) else at
        yield values, ends


def _texts(row: pa.Array, numbers: pa.Array, held: dict) -> pa.RecordBatch:
    flat, ends = numbers.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(numbers.value_lengths().to_numpy(zero_copy_only=False))])
    out = {}
    for name, (values, offsets) in held.items():
        got, many = gather(values, offsets, flat)
        out[name] = got, np.concatenate([[0], np.cumsum(many)])[ends].astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(out["ids"][1]), pa.array(out["ids"][0]))
    decoded = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(out["bytes"][1].tobytes()), pa.py_buffer(np.ascontiguousarray(out["bytes"][0]))])
    return pa.RecordBatch.from_arrays([row, ids, decoded], names=["row", "ids", "decoded"])


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token ids of texts, and the bytes that these ids decode to.

    Returns, for each row of docs, `row` (a struct of the kept columns, all by default), ids and decoded. Null
    and empty texts have no ids and decode to no bytes. Special tokens are ordinary text. Texts and pieces can
    have any length; an empty table gives an empty one. Each task of the scan folds its own distinct pieces.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(ranks, spark)
    keep = docs.columns if keep is None else keep
    small_batches(spark)
    held = F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    packed = docs.select(held.alias("row"), docs[text_col].cast("string").alias("text"))
    row = StructField("row", packed.schema["row"].dataType, True)  # rows with pieces have none
    # Bounded: a vocabulary of at most 2**18 tokens, and COMMON pieces of at most LONG bytes.
    shared = spark.sparkContext.broadcast(ranks)
    names, values = _common(packed, pattern, vocabulary, shared)
    often, strings = spark.sparkContext.broadcast(names), spark.sparkContext.broadcast(values)
    release()
    cut = packed.mapInArrow(_cut(pattern, shared, often), StructType([row, *StructType.fromDDL("pieces array<array<short>>, given array<array<int>>, numbers array<int>, anew boolean").fields]))
    return vocabulary.folded(cut).mapInArrow(lambda batches: _string(batches, strings), StructType([row, *StructType.fromDDL("ids array<int>, decoded binary").fields]))


def _common(texts: DataFrame, pattern: str, vocabulary: Vocabulary, ranks) -> tuple[dict[str, int], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Numbers of the most frequent pieces of a sample, and the ids and bytes that the fold makes of them, one after another.

    The sample: whole texts, by their hash, about SAMPLE_BYTES in all.
    """
    every = max(1, text_bytes(texts, "text") // SAMPLE_BYTES)
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = regex.compile(pattern), Counter()

        def told() -> pa.RecordBatch:
            new = [(x, n) for x, n in counts.items() if len(x) <= LONG // 4 and x.encode() not in ranks.value]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.string()), pa.array([n for _, n in new], pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(find.findall(text.as_py() or ""))
                if len(counts) > KNOWN:
                    yield told()
        yield told()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pieces, given, cuts = packed([x.encode() for x in batch.column("piece").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column("piece")), pieces, given], names=["names", "pieces", "given"])

    best = chosen.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "piece").limit(COMMON)
    best = written(best.select("piece"), "pieces").repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism), "piece")
    spelt = best.mapInArrow(spell, "names array<string>, pieces array<array<short>>, given array<array<int>>")
    found = vocabulary.folded(spelt).toArrow()
    names = found["names"].combine_chunks().flatten().to_pylist()
    lists, blobs = found["ids"].combine_chunks().flatten(), found["decoded"].combine_chunks().flatten()
    starts = lambda lengths: np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False)
    return {x: i for i, x in enumerate(names)}, {
        "ids": (lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), starts(lists.value_lengths().to_numpy(zero_copy_only=False))),
        "bytes": (np.frombuffer(b"".join(blobs.to_pylist()), np.uint8), starts(sizes)),
    }


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """The whole of documents, by the ranks of byte_bpe_multi_50k."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
