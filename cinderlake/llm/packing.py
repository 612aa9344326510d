"""Best-fit packing of documents into fixed-length sequences by the linear grouping scheme.

Every document is tokenized whole, ends with id 0 and is cut only if longer than a sequence. The plan is made on
the histogram of piece lengths (at most ``capacity`` bins, whatever the corpus):

1. large lengths are rounded up inside ``groups`` groups of equal cardinality;
2. configurations of these few sizes are optimised by column generation (a linear programme with a knapsack for
   pricing), rounded down, and what is left over is packed best-fit;
3. actual lengths take the place of the rounded ones;
4. small pieces, and the space that rounding left, are filled best-fit, longest first.

The plan is a list of (lengths, how many sequences), from which each piece finds its sequence and offset by its
rank among the pieces of its length. Ranks are counted in buckets, so one very common length is never in one task.

Defined results: a null or empty text is one piece that holds id 0 alone; repeated rows are packed each; null ids
are kept; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, require
from ._words import U, Words, give_back, keeps, texts

CAPACITY = 2048
#: Bytes of text that are tokenized together.
BATCH_BYTES = 1 << 20
#: Distinct words in a worker's table, about 40 bytes each (results do not depend on it).
REMEMBERED = 2_000_000
#: Stands for the end of a text in the table of words; its id is 0.
TEXT_END = U(0x5851F42D4C957F2D)
_known: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable ones are themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers, from a table of the distinct words met so far.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in
    order. Words stand as 64-bit hashes in a sorted table with their ids in one flat array; only words that are new to
    the table are looked at as strings. A new word of plain Latin letters, digits and signs (no special token's opening in it) is
    lower-cased and split here by the tokenizer's own pattern, and only its parts go to the tokenizer's model; any
    other new word goes through the whole tokenizer.
    """

    # The pattern of word_bpe_49k.json, and the characters that its normaliser only lower-cases.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[!-~\u00a1-\u012f\u0131-\u017f]+"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)["pre_tokenizer"]
        #: another tokenizer file than the one whose rules stand above takes the whole way for every word
        self.known = self.PARTS in str(said.get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex"))
        self.parts, self.plain = regex.compile(self.PARTS + r"|\n").findall, re.compile(self.PLAIN).fullmatch
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x21, 0x180)}
        self.forget()

    def forget(self) -> None:
        """An empty table: its first entry is the end of a text."""
        self.hash, self.at, self.n = np.array([TEXT_END], U), np.zeros(1, np.int64), np.ones(1, np.int32)
        self.flat, self.asked = np.zeros(1, "<u4"), np.ones(1, bool)

    def tokenized(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order)."""
        plain, other = [], []
        for i, t in enumerate(b"\n".join(words).decode().split("\n")):
            (plain if self.known and self.plain(t) and "<|" not in t else other).append((i, t))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if plain:
            seen = self.parts("\n".join([t for _, t in plain]).lower())
            number = {p: k for k, p in enumerate(dict.fromkeys(seen))}
            tokenize, letters = self.model.tokenize, self.letters
            ids = [[] if p == "\n" else [t.id for t in tokenize(p if p.isascii() else p.translate(letters))] for p in number]
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.array([x for some in ids for x in some], "<u4")
            k = np.fromiter(map(number.__getitem__, seen), np.int64, len(seen))
            word = np.cumsum(k == number.get("\n", -1))
            found.append((np.array([i for i, _ in plain]), np.bincount(word, size[k], len(plain)).astype(np.int64), flat[_runs((np.cumsum(size) - size)[k], size[k])]))
        for k in range(0, len(other), 10_000):
            some = other[k : k + 10_000]
            ids = [e.ids for e in self.tokenizer.encode_batch([t for _, t in some], add_special_tokens=False)]
            found.append((np.array([i for i, _ in some]), np.array([len(x) for x in ids], np.int64), np.array([x for some in ids for x in some], "<u4")))
        word, size, flat = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word)
        return size[order], flat[_runs((np.cumsum(size) - size)[order], size[order])]

    def _missing(self, h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.hash[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)] != h)

    def learn(self, w: Words, h: np.ndarray, first: np.ndarray) -> None:
        """Enter those of the distinct hashes ``h``, met at the words ``first``, that the table lacks."""
        new = self._missing(h)
        if len(new) and len(self.hash) + len(new) > self.remembered:  # keep what was asked for since the last time
            k = np.flatnonzero(self.asked)
            self.hash, self.n, self.flat = self.hash[k], self.n[k], self.flat[_runs(self.at[k], self.n[k])]
            self.at, self.asked = np.cumsum(self.n, dtype=np.int64) - self.n, self.hash == TEXT_END
            new = self._missing(h)
            if len(self.hash) + len(new) > self.remembered:
                self.forget()
                new = self._missing(h)
        if not len(new):
            return
        raw, first = w.data.tobytes(), first[new]
        size, flat = self.tokenized([raw[a:z] for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
        hashes = np.concatenate([self.hash, h[new]])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.n = hashes[order], np.concatenate([self.n, size.astype(np.int32)])[order]
        self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.flat)])[order]
        self.asked = np.concatenate([self.asked, np.ones(len(new), bool)])[order]
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with id 0 at its end; where each text's ids begin, and the end of the last)."""
        m, h = w.n_docs, w.hash
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        u = s[new]
        self.learn(w, u, order[new])
        i = np.searchsorted(self.hash, u)
        self.asked[i] = True
        entry = np.empty(len(h) + m, np.int64)
        mine = np.empty(len(h), np.int64)
        mine[order] = i[np.cumsum(new) - 1]
        entry[np.arange(len(h)) + w.doc] = mine
        ends = np.cumsum(w.counts) + np.arange(m)
        entry[ends] = np.searchsorted(self.hash, TEXT_END)
        size = self.n[entry]
        upto = np.cumsum(size, dtype=np.int64)
        return self.flat[_runs(self.at[entry], size)], np.concatenate([[0], upto[ends]])


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after the other."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks until the worker turns to another operator."""
    if path not in _known:
        _known.clear()
        give_back()
        _known[path] = Encoder(path)
    keeps(_known.clear)
    return _known[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole text."""
    src = docs.select("doc_id", "text")
    path = tokenizer or default_tokenizer()
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for i, _, w in texts(b.column(1), BATCH_BYTES, keep=True):
                ids, at = enc.encode(w)
                size = np.diff(at)
                count = -(-size // capacity)
                row, piece = np.repeat(np.arange(len(size)), count), _runs(np.zeros(len(size), np.int64), count)
                length = np.minimum(size[row] - piece * capacity, capacity)
                begin, raw = at[row] + piece * capacity, memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                cols = [b.column(0).take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, schema)


# ---- the plan, on the histogram ----


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 600) -> list[tuple[dict[int, int], float]]:
    """Column generation for cutting stock: [(how many of each size, how often)], a fractional optimum (or near it)."""
    k = len(sizes)
    s, b = np.array(sizes), np.array(counts, float)
    columns = [{i: capacity // x} for i, x in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // x) for x in sizes])
    x = inverse @ b
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        # the best pattern for these prices: a knapsack in as many layers as a sequence can hold pieces
        best = [np.zeros(capacity + 1)]
        picks = []
        for _ in range(capacity // int(s.min())):
            value, pick = best[-1].copy(), np.full(capacity + 1, -1)
            for i, (size, price) in enumerate(zip(sizes, y, strict=True)):
                v = best[-1][: capacity + 1 - size] + price
                better = v > value[size:] + 1e-12
                value[size:][better] = v[better]
                pick[size:][better] = i
            best.append(value)
            picks.append(pick)
        if best[-1][capacity] <= 1 + 1e-4:
            break
        a, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                a[pick[c]] += 1
                c -= sizes[pick[c]]
        d = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out] = {i: int(n) for i, n in enumerate(a) if n}
        inverse[out] /= d[out]
        rest = d.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        x = np.maximum(inverse @ b, 0)
    return [(c, float(v)) for c, v in zip(columns, x, strict=True) if v > 1e-9]


class _Bins:
    """Sequences by what they hold: equal ones are one entry with a count."""

    def __init__(self, capacity: int):
        self.by_room: dict[int, Counter] = defaultdict(Counter)
        self.rooms: list[int] = []
        self.capacity = capacity

    def add(self, held: tuple[int, ...], n: int) -> None:
        if n:
            room = self.capacity - sum(held)
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room][held] += n

    def best_fit(self, length: int, n: int) -> None:
        """Put n pieces of one length each into the fullest sequence that takes it; open new ones when none does."""
        while n:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                self.add((length,) * each, n // each)
                self.add((length,) * (n % each), 1 if n % each else 0)
                return
            room = self.rooms[i]
            held, m = next(iter(self.by_room[room].items()))
            each = room // length  # a sequence that got one is fuller, so the next goes there too
            whole = min(m, n // each)
            if whole:
                self._take(room, held, whole)
                self.add(held + (length,) * each, whole)
                n -= whole * each
            else:
                self._take(room, held, 1)
                self.add(held + (length,) * n, 1)
                n = 0

    def _take(self, room: int, held: tuple[int, ...], n: int) -> None:
        self.by_room[room][held] -= n
        if not self.by_room[room][held]:
            del self.by_room[room][held]
            if not self.by_room[room]:
                self.rooms.remove(room)

    def plan(self) -> list[tuple[tuple[int, ...], int]]:
        return [(h, n) for room in self.rooms for h, n in self.by_room[room].items()]


#: (groups, largest small piece as a share of a sequence): each is planned, the plan of fewest sequences stays.
SETTINGS = ((64, 1 / 4), (64, 2 / 5), (200, 2 / 5), (64, 1 / 2))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, settings: Iterable[tuple[int, float]] = SETTINGS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)] that hold the histogram exactly."""
    return min((plan_once(histogram, capacity, g, s) for g, s in settings), key=lambda made: sum(n for _, n in made))


def plan_once(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[tuple[int, ...], int]]:
    """One run of the linear grouping scheme."""
    bins = _Bins(capacity)
    bins.add((capacity,), histogram.get(capacity, 0))
    large = sorted((x for x in histogram if small * capacity < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    # 1. groups of equal cardinality, rounded up to the longest of the group; one length stays in one group
    size = max(1, math.ceil(total / groups))
    members: list[list[int]] = []
    held = 0
    for x in large:
        if not members or held >= size:
            members.append([])
            held = 0
        members[-1].append(x)
        held += histogram[x]
    sizes, counts = [m[0] for m in members], [sum(histogram[x] for x in m) for m in members]
    left = {x: histogram[x] for x in large}
    there = sorted(left)  # lengths that are still left, ascending

    def longest(up_to: int) -> int | None:
        i = bisect.bisect_right(there, up_to)
        return there[i - 1] if i else None

    # 2. configurations of few sizes, rounded down
    for config, often in configurations(sizes, counts, capacity) if sizes else []:
        n = int(often + 1e-9)
        need = sorted((sizes[i] for i, c in config.items() for _ in range(c)), reverse=True)
        # 3. actual lengths in place of rounded ones: the longest left that is no longer; the last one may use
        # all the room that the others, being shorter than rounded, have left
        while n:
            got: Counter = Counter()
            room = capacity
            for at, want in enumerate(need):
                x = longest(room if at == len(need) - 1 else want)
                while x is not None and left[x] <= got[x]:
                    x = longest(x - 1)
                if x is not None:
                    got[x] += 1
                    room -= x
            if not got:
                break
            run = min(n, *(left[x] // c for x, c in got.items())) if len(got) else 0
            bins.add(tuple(sorted(got.elements(), reverse=True)), run)
            for x, c in got.items():
                left[x] -= c * run
                if not left[x]:
                    there.remove(x)
            n -= run
    # 4. what is left over, then the small ones, longest first
    rest = Counter({x: n for x, n in left.items() if n})
    rest.update({x: n for x, n in histogram.items() if x <= small * capacity})
    for x in sorted(rest, reverse=True):
        bins.best_fit(x, rest[x])
    return bins.plan()


def slots(made: Iterable[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks: pieces of ``length`` with ranks from ``rank`` on go to sequences from ``sequence`` on at ``offset``."""
    rows, used, first = [], Counter(), 0
    for held, n in made:
        at = 0
        for x in held:
            rows.append((x, used[x], first, at))
            used[x] += n
            at += x
        first += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": (cols[0] << 44) + cols[1], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def place(found: DataFrame, made: Iterable[tuple[tuple[int, ...], int]], rows: int) -> DataFrame:
    """``found`` (with ``length``) and its ``sequence_id`` and ``offset``."""
    buckets = max(1, min(1 << 16, math.ceil(math.sqrt(rows) / 4)))
    d = found.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = d.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    d = d.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    d = d.join(sums, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    d = d.select(*found.columns, (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    table = slots(made)  # its size follows the histogram's bins, not the corpus
    names = [*found.columns, "sequence_id", "offset"]
    n, at = len(found.columns), found.columns.index("length")

    def run(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, n))
            i = np.searchsorted(table["key"], (length << 44) + rank, "right") - 1
            seq = table["sequence"][i] + rank - table["rank"][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(seq), pa.array(table["offset"][i])], names)

    from pyspark.sql import types as T

    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return d.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **how) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, gapless in each sequence."""
    require(docs, "doc_id", "text")
    found = cut(token_pieces(docs, tokenizer, capacity))
    histogram = {int(r["length"]): r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    return place(found, plan(histogram, capacity, **how), sum(histogram.values()))
