"""SentencePiece encoding as a relational lattice, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taskmill.llm.common import STEP, found_in, free_names, let, released

SPACE = "▁"
# Boundaries of a word are bits of one long, so longer words are cut by the small merge below instead.
MAX_CHARS = 62
# Distinct words are cut once per batch of about this many bytes of text, so many at a time.
BATCH_BYTES = 2 * 1024 * 1024
WORDS_AT_ONCE = 1 << 14
# What an unknown character scores below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
# A model of more pieces than this is refused: the piece table goes to every task.
MAX_PIECES = 2_000_000


@dataclass(frozen=True)
class Pieces:
    """The pieces of a model: a fixed table of bounded size."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    texts: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    longest: int
    # Characters that end a word, apart from the space: no longer piece holds them.
    lone: str

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, score, rank): equal scores have equal ranks, the best has rank 0."""
        order = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = [(p, s, order[s]) for p, s in self.scores.items()]
        return spark.createDataFrame(rows, "piece string, score double, rank long")

    def units(self, text: str) -> list[str]:
        return re.findall(self.pattern(), _escaped(text)) if text else []

    def pattern(self) -> str:
        lone = "".join(re.escape(c) for c in self.lone)
        return f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else "")


def make_pieces(kind: str, pieces: list[tuple[str, float]], special: int = 0, byte_ids=(), unknown: int = 0) -> Pieces:
    """A piece table; the first ``special`` ids and those of bytes are never found in a text."""
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    if any(a != SPACE and b == SPACE for p, _ in pieces for a, b in zip(p, p[1:])):
        raise ValueError("a piece reaches over the end of a word")
    closed = {*range(special), *byte_ids}
    usable = {p: (i, s) for i, (p, s) in enumerate(pieces) if i not in closed}
    texts = [p.encode() for p, _ in pieces]
    for value, i in enumerate(byte_ids):
        texts[i] = bytes([value])
    for i in range(special):
        texts[i] = b""
    texts[unknown] = " ⁇ ".encode()
    joined = {c for p in usable if len(p) > 1 for c in p}
    return Pieces(
        kind, {p: i for p, (i, _) in usable.items()}, {p: s for p, (_, s) in usable.items()}, tuple(texts),
        tuple(byte_ids), unknown, max([1, *map(len, usable)]), "".join(c for c in "\n\r\t" if c not in joined),
    )


def load_pieces(model_file: str) -> Pieces:
    """The pieces of a SentencePiece model file, which only the driver reads.

    A model with byte pieces, or whose scores fall by one with each id, is taken as BPE, others as unigram.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.vocab_size()
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
    closed = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    if closed != list(range(len(closed))):
        raise ValueError("control and unused pieces are expected to come first")
    byte_ids = [i for i in range(n) if model.is_byte(i)]
    whole = all(float(s).is_integer() for _, s in pieces)
    return make_pieces("bpe" if whole else "unigram", pieces, len(closed), byte_ids, model.unk_id())


def _escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _merge_fold(edges: Column, chars: Column) -> Column:
    """The boundaries left when the best joinable pair is joined until none is left.

    Boundaries are bits: bit i stands before character i. An edge (key, ends, inside) can be joined if it
    begins and ends at a boundary with exactly one between. The least key is the best score and, of equal
    ones, the leftmost start.
    """
    def joinable(bounds: Column):
        return lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (
            F.bit_count(bounds.bitwiseAND(e["inside"])) == 1
        )

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(let(
            F.array_min(F.filter(edges, joinable(state["bounds"]))),
            lambda best: F.struct(
                F.coalesce(state["bounds"].bitwiseAND(F.bitwise_not(best["inside"])), state["bounds"]).alias("bounds"),
                best.isNull().alias("done"),
            ),
        ))

    every = F.when(chars >= 62, F.lit(2**63 - 1).cast("long")).otherwise(_bit(chars + 1) - 1)
    begin = F.struct(every.alias("bounds"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(chars, F.lit(1))), begin, step, lambda s: s["bounds"])


def _viterbi_fold(edges: Column, chars: Column, unknown: float) -> Column:
    """The boundaries of the way through the lattice with the best total score.

    The state holds, for each place so far, the best score to reach it and the boundaries of that way.
    """
    def step(ways: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["end"] == end)
        reached = F.transform(here, lambda e: F.struct(
            (F.get(ways, e["start"])["score"] + e["score"]).alias("score"), F.get(ways, e["start"])["bounds"].alias("bounds")
        ))
        single = F.when(~F.exists(here, lambda e: e["start"] == end - 1), F.struct(
            (F.get(ways, end - 1)["score"] + unknown).alias("score"), F.get(ways, end - 1)["bounds"].alias("bounds")
        ))
        best = F.array_max(F.array_compact(F.concat(reached, F.array(single))))
        return F.concat(ways, F.array(F.struct(
            best["score"].alias("score"), best["bounds"].bitwiseOR(_bit(end)).alias("bounds")
        )))

    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("bounds")))
    ends = F.sequence(F.lit(1), F.greatest(chars, F.lit(1)))
    return F.aggregate(ends, begin, step, lambda ways: F.get(ways, chars)["bounds"])


def segment_units(units: DataFrame, pieces: Pieces, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``bounds`` to a table of distinct words (keys, unit): bit i is set if a piece begins at place i.

    All substrings of a word up to the longest piece are exploded and joined to the piece table; the
    matches of a word are its lattice, which one fold walks. The piece table is broadcast, so if the words
    are partitioned by their keys nothing is shuffled. Words of one or more than ``MAX_CHARS`` characters
    are left out.
    """
    shortest = 2 if pieces.kind == "bpe" else 1
    chars = F.char_length("unit")
    words = units.where((chars >= 2) & (chars <= MAX_CHARS)).withColumn("__chars", chars)
    starts = words.withColumn("__start", F.explode(F.sequence(F.lit(0), F.col("__chars") - shortest)))
    longest = F.least(F.lit(pieces.longest), F.col("__chars") - F.col("__start"))
    parts = starts.withColumn("__len", F.explode(F.sequence(F.lit(shortest), longest)))
    found = parts.join(
        F.broadcast(pieces.table(units.sparkSession)),
        F.substring("unit", F.col("__start") + 1, F.col("__len")) == F.col("piece"),
    )
    by = [*keys, "unit", "__chars"]
    if pieces.kind == "bpe":
        edge = F.struct(
            F.expr("shiftleft(rank, 7) | __start").alias("key"),
            F.expr("shiftleft(1L, __start) | shiftleft(1L, __start + __len)").alias("ends"),
            F.expr("shiftleft(shiftleft(1L, __len - 1) - 1L, __start + 1)").alias("inside"),
        )
        lattice = found.groupBy(*by).agg(F.collect_list(edge).alias("__edges"))
        bounds = _merge_fold(F.col("__edges"), F.col("__chars"))
    else:
        edge = F.struct(F.col("__start").alias("start"), (F.col("__start") + F.col("__len")).alias("end"), "score")
        lattice = found.groupBy(*by).agg(F.collect_list(edge).alias("__edges"))
        worst = min(pieces.scores.values()) - UNKNOWN_PENALTY
        bounds = _viterbi_fold(F.col("__edges"), F.col("__chars"), worst)
    return lattice.select(*keys, "unit", bounds.alias("bounds"))


def merged(unit: str, pieces: Pieces) -> list[str]:
    """The same cut for one word of any length, with a heap or a row of best ways."""
    n, scores = len(unit), pieces.scores
    if pieces.kind != "bpe":
        worst = min(scores.values()) - UNKNOWN_PENALTY
        ways = [(0.0, 0)]
        for end in range(1, n + 1):
            reached = [
                (ways[s][0] + scores[unit[s:end]], s) for s in range(max(0, end - pieces.longest), end) if unit[s:end] in scores
            ]
            if unit[end - 1] not in scores:
                reached.append((ways[end - 1][0] + worst, end - 1))
            ways.append(max(reached))
        out, end = [], n
        while end:
            out.append(unit[ways[end][1] : end])
            end = ways[end][1]
        return out[::-1]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ends = list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (score := scores.get(unit[a : ends[b]])) is not None:
            heapq.heappush(heap, (-score, a, ends[b]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, a, end = heapq.heappop(heap)
        b = after[a] if alive[a] else n
        if b >= n or ends[b] != end:
            continue
        alive[b] = False
        ends[a], after[a] = end, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(unit[a : ends[a]])
        a = after[a]
    return out


class Lattice:
    """The piece table as arrays, for cutting many distinct words at once.

    The steps are those of ``segment_units``: substrings up to the longest piece are matched with the
    pieces, the matches of a word are its lattice, and one fold over all lattices finds the cuts.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        found = list(pieces.ids)
        self.lengths = np.array([len(p) for p in found], np.int64)
        codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.cumsum(self.lengths) - self.lengths
        hashes = np.zeros(len(found), np.uint64)
        for j in range(pieces.longest):
            here = self.lengths > j
            hashes[here] = hashes[here] * np.uint64(STEP) + codes[begin[here] + j] + np.uint64(1)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([pieces.ids[p] for p in found], np.int64)[order]
        self.scores = np.array([pieces.scores[p] for p in found])[order]
        self.ranks = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        # How long a piece with these two first characters can be.
        pairs = [(hash_, n) for hash_, n in zip(self._pairs(codes, begin), self.lengths) if n > 1]
        longest: dict[int, int] = {}
        for hash_, n in pairs:
            longest[int(hash_)] = max(int(n), longest.get(int(hash_), 0))
        self.pair = np.array(sorted(longest), np.uint64)
        self.reach = np.array([longest[int(h)] for h in self.pair], np.int64)

    @staticmethod
    def _pairs(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        second = np.minimum(begin + 1, len(codes) - 1)
        return (codes[begin] + np.uint64(1)) * np.uint64(STEP) + codes[second] + np.uint64(1)

    def edges(self, codes: np.ndarray, word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all substrings of two characters or more that are pieces."""
        at = np.flatnonzero(np.arange(len(codes)) + 1 < end[word])
        pair = found_in(self._pairs(codes, at), self.pair)
        at, reach = at[pair >= 0], self.reach[pair[pair >= 0]]
        hashes = codes[at] + np.uint64(1)
        out = []
        for n in range(2, self.pieces.longest + 1):
            more = (reach >= n) & (at + n <= end[word[at]])
            at, reach, hashes = at[more], reach[more], hashes[more]
            if not len(at):
                break
            hashes = hashes * np.uint64(STEP) + codes[at + n - 1] + np.uint64(1)
            piece = found_in(hashes, self.hashes)
            hit = piece >= 0
            out.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's ids begin and end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        end = np.cumsum(sizes)
        begin = end - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        short = sizes <= MAX_CHARS
        place, length, piece = self.edges(codes, word, np.where(short, end, begin))
        owner = word[place]
        start = (place - begin[owner]).astype(np.uint64)
        fold = self._merged if self.pieces.kind == "bpe" else self._best_ways
        bounds = fold(sizes, codes, begin, owner, start, length.astype(np.uint64), piece)
        first = np.zeros(len(codes), bool)
        offset = (np.arange(len(codes)) - begin[word]).astype(np.uint64)
        fits = short[word]
        first[fits] = (bounds[word[fits]] >> offset[fits]) & np.uint64(1) > 0
        for i in np.flatnonzero(~short):
            first[begin[i] + np.cumsum([0, *map(len, merged(words[i], self.pieces)[:-1])])] = True
        return self._ids_of(words, codes, np.flatnonzero(first), word, end)

    def _merged(self, sizes, codes, begin, owner, start, length, piece) -> np.ndarray:
        """Join the best joinable pair of every word, round by round; words that have none drop out."""
        one = np.uint64(1)
        bounds = (one << (np.minimum(sizes, MAX_CHARS).astype(np.uint64) + one)) - one
        ends = (one << start) | (one << (start + length))
        inside = ((one << (length - one)) - one) << (start + one)
        order = np.lexsort((start, self.ranks[piece], owner))
        owner, ends, inside = owner[order], ends[order], inside[order]
        while len(owner):
            now = bounds[owner]
            whole = (now & ends) == ends
            between = np.bitwise_count(now & inside)
            joinable = np.flatnonzero(whole & (between == 1))
            if not len(joinable):
                break
            best = joinable[_first_of_runs(owner[joinable])]
            bounds[owner[best]] &= ~inside[best]
            going = np.zeros(len(sizes), bool)
            going[owner[best]] = True
            keep = whole & (between > 0) & going[owner]
            keep[best] = False
            owner, ends, inside = owner[keep], ends[keep], inside[keep]
        return bounds

    def _best_ways(self, sizes, codes, begin, owner, start, length, piece) -> np.ndarray:
        """Viterbi over all words at once, one place of the words after the other."""
        longest = int(min(MAX_CHARS, sizes.max(initial=0)))
        lone = found_in(codes + np.uint64(1), self.hashes)
        single = np.where(lone >= 0, self.scores[lone], self.scores.min() - UNKNOWN_PENALTY)
        score = np.full((len(sizes), longest + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((len(sizes), longest + 1), np.int64)
        start, stop = start.astype(np.int64), (start + length).astype(np.int64)
        order = np.argsort(stop, kind="stable")
        owner, start, stop, gain = owner[order], start[order], stop[order], self.scores[piece[order]]
        for at in range(1, longest + 1):
            here = np.flatnonzero((sizes >= at) & (sizes <= MAX_CHARS))
            a, b = np.searchsorted(stop, [at, at + 1])
            who = np.concatenate([owner[a:b], here])
            since = np.concatenate([start[a:b], np.full(len(here), at - 1)])
            total = score[who, since] + np.concatenate([gain[a:b], single[begin[here] + at - 1]])
            order = np.lexsort((since, total, who))
            who, since, total = who[order], since[order], total[order]
            last = np.append(who[1:] != who[:-1], True) if len(who) else np.empty(0, bool)
            score[who[last], at], back[who[last], at] = total[last], since[last]
        bounds = np.zeros(len(sizes), np.uint64)
        rows = np.flatnonzero(sizes <= MAX_CHARS)
        at = sizes[rows].copy()
        while len(rows):
            bounds[rows] |= np.uint64(1) << at.astype(np.uint64)
            at = np.where(at > 0, back[rows, at], -1)
            rows, at = rows[at >= 0], at[at >= 0]
        return bounds

    def _ids_of(self, words, codes, first, word, end) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.append(first, len(codes)))
        hashes = np.zeros(len(first), np.uint64)
        for j in range(min(self.pieces.longest, int(size.max(initial=0)))):
            here = size > j
            hashes[here] = hashes[here] * np.uint64(STEP) + codes[first[here] + j] + np.uint64(1)
        piece = found_in(hashes, self.hashes)
        ids = np.where(piece >= 0, self.ids[piece], -1)
        strange = np.flatnonzero(piece < 0)
        counts = np.ones(len(first), np.int64)
        spelled = {}
        if len(strange) and self.pieces.byte_ids:
            for code in np.unique(codes[first[strange]]).tolist():
                spelled[code] = [self.pieces.byte_ids[b] for b in chr(code).encode()]
            counts[strange] = [len(spelled[c]) for c in codes[first[strange]].tolist()]
        out = np.repeat(ids, counts)
        if len(strange):
            spell = (spelled.get(c, [self.pieces.unknown]) for c in codes[first[strange]].tolist())
            out[np.repeat(piece < 0, counts)] = [i for ids_ in spell for i in ids_]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return out.astype(np.int32), upto[np.searchsorted(first, np.concatenate([[0], end]))]


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def encoded(texts: list[str | None], lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each text's ids begin and end); each distinct word is cut once."""
    find = re.compile(lattice.pieces.pattern()).findall
    units = [find(_escaped(t)) if t else [] for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [u for us in units for u in us]
    if not len(flat):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = pd.factorize(flat)
    cuts = [lattice.cut(list(distinct[i : i + WORDS_AT_ONCE])) for i in range(0, len(distinct), WORDS_AT_ONCE)]
    ids = np.concatenate([c[0] for c in cuts])
    ends = np.cumsum(np.concatenate([[0], *(np.diff(c[1]) for c in cuts)]))
    counts = np.diff(ends)[codes]
    upto = np.concatenate([[0], np.cumsum(counts)])
    out = ids[np.repeat(ends[codes] - upto[:-1], counts) + np.arange(int(upto[-1]))]
    return out, upto[np.concatenate([[0], np.cumsum(sizes)])]


def decoded(ids, pieces: Pieces) -> str:
    text = b"".join(map(pieces.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode(
    docs: DataFrame, pieces: Pieces, text: str = "text", keep: tuple[str, ...] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Add ``ids``, ``n_ids`` and ``round_trip`` (whether decoding gives the text back) to every document.

    Texts are cut into words that no piece reaches over, and each distinct word of a batch goes through the
    lattice once. Nothing is shuffled. Of the other columns ``keep`` stay, or all. A null or empty text has
    no ids. A space and U+2581 are the same to a model, so a text with U+2581 does not make the round trip.
    Words of any length are cut, long ones by a small merge of their own. Repeated rows stay; old columns
    of the new names are replaced.
    """
    new = ("ids", "n_ids", "round_trip")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    (body,) = free_names(docs, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c != text], F.col(f"`{text}`").alias(body))
    schema = T.StructType(
        [docs.schema[c] for c in keep] + T.StructType.fromDDL("ids array<int>, n_ids int, round_trip boolean").fields
    )
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False)
            turn = np.cumsum(sizes) // batch_bytes
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                texts = part.column(body).to_pylist()
                ids, ends = encoded(texts, lattice)
                same = [
                    decoded(ids[x:y].tolist(), lattice.pieces) == (t or "") for t, x, y in zip(texts, ends[:-1], ends[1:])
                ]
                out = {
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    "n_ids": pa.array(np.diff(ends), pa.int32()), "round_trip": pa.array(same, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([
                    out[f.name].cast(f.type) if f.name in out else part.column(body if f.name == text else f.name)
                    for f in arrow
                ], schema=arrow)

    return rows.mapInArrow(released(run), schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of every array of ids; null stays null, the empty array is the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else decoded(x, sent.value))

    return rows.withColumn(text, texts(F.col(ids)))
