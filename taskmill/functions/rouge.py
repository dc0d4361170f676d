"""ROUGE: n-gram overlap with built-ins, common subsequences (and n-grams beside them) in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
# The tokens of both sides, and what each key counts in common.
HITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("reference", "candidate", *KEYS)])
# Beyond this many tokens the places of a token are set one by one, not by shifting a number of that many bits.
LONG = 512


def overlap(reference: Iterable, candidate: Iterable) -> int:
    """How many elements two texts share, each as often as it occurs in both."""
    ours, theirs = Counter(reference), Counter(candidate)
    return sum(min(ours[x], theirs[x]) for x in ours.keys() & theirs.keys())


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array as 64-bit hashes; empty when there are fewer than n tokens."""
    if n == 1:
        return F.transform(tokens, lambda x: F.xxhash64(x))
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(tokens, rest, lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def shared(reference: Column, candidate: Column) -> Column:
    """How many hashes two arrays share, each as often as it occurs in both: ``overlap`` with built-ins.

    Both sides are sorted together as plain numbers, with the side as the lowest bit. Each is compared with the
    one before it, and one fold over what is left of them, two bits, pairs equal ones off. Its state is one
    number: the hits, and below them the hashes of the reference that are still free.
    """
    ours = F.transform(reference, lambda x: F.shiftleft(x, 1))
    theirs = F.transform(candidate, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(1).cast("bigint")))
    tagged = F.sort_array(F.concat(ours, theirs))
    return F.get(F.transform(F.array(tagged), _pairs), F.lit(0))


def _pairs(tagged: Column) -> Column:
    less = F.slice(tagged, 1, F.greatest(F.size(tagged) - 1, F.lit(0)))
    before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), less), 1, F.size(tagged))
    side = F.lit(1).cast("bigint")
    steps = F.zip_with(tagged, before, lambda x, last: F.when(
        F.shiftright(x, 1) == F.shiftright(last, 1), x.bitwiseAND(side)
    ).otherwise(x.bitwiseAND(side).bitwiseOR(F.lit(2).cast("bigint"))))
    hit, low = F.lit(1 << 32).cast("bigint"), F.lit((1 << 32) - 1).cast("bigint")

    def fold(state: Column, step: Column) -> Column:
        free = state.bitwiseAND(low)
        return (
            F.when(step == 0, state + 1)
            .when(step == 1, F.when(free > 0, state + (hit - 1)).otherwise(state))
            .when(step == 2, state - free + 1)
            .otherwise(state - free)
        )

    return F.aggregate(steps, F.lit(0).cast("bigint"), fold, lambda state: F.shiftright(state, 32).cast("int"))


def f_measure(hits: Column, in_reference: Column, in_candidate: Column) -> Column:
    """The F-measure of an overlap, rounded to four places, on a scale of 100."""
    total = in_reference + in_candidate
    score = F.when(total > 0, 2.0 * hits / total).otherwise(F.lit(0.0))
    return F.rint(score * 10000) / 100


def places(tokens: list[str]) -> dict[str, int]:
    """The places of each token in a sentence, as bits."""
    found: dict[str, int] = {}
    if len(tokens) <= LONG:
        for j, token in enumerate(tokens):
            found[token] = found.get(token, 0) | (1 << j)
        return found
    listed: dict[str, list[int]] = {}
    for j, token in enumerate(tokens):
        listed.setdefault(token, []).append(j)
    for token, where in listed.items():
        bits = bytearray((where[-1] >> 3) + 1)
        for j in where:
            bits[j >> 3] |= 1 << (j & 7)
        found[token] = int.from_bytes(bits, "little")
    return found


def lcs_rows(reference: list[str], candidate: list[str], where: dict[str, int]) -> Iterator[int]:
    """Row i of the subsequence table: bit j is set where cell (i, j+1) exceeds cell (i, j)."""
    full = (1 << len(candidate)) - 1
    state = full
    for token in reference:
        hit = state & where.get(token, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
        yield full ^ state


def lcs_length(reference: list[str], candidate: list[str]) -> int:
    """Length of the longest common subsequence: a step for each token of the shorter side that the longer one has."""
    if len(reference) > len(candidate):
        reference, candidate = candidate, reference
    where = places(candidate)
    state = full = (1 << len(candidate)) - 1
    for token in reference:
        hit = state & where.get(token, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(candidate) - state.bit_count()


def lcs_positions(reference: list[str], candidate: list[str], where: dict[str, int]) -> set[int]:
    """Places in the reference of one longest common subsequence, traced from the end.

    A tie between leaving out a token of either side leaves out the one of the reference, so
    reference tokens the candidate lacks never matter and are skipped from the start.
    """
    kept = [i for i, token in enumerate(reference) if token in where]
    if len(kept) < 2:
        return set(kept)
    tokens = [reference[i] for i in kept]
    rows = [0, *lcs_rows(tokens, candidate, where)]
    found: set[int] = set()
    i, j = len(tokens), len(candidate)
    while i and j:
        if tokens[i - 1] == candidate[j - 1]:
            i, j = i - 1, j - 1
            found.add(kept[i])
        elif rows[i] >> (j - 1) & 1:
            i -= 1
        else:
            mask = (1 << j) - 1
            if (rows[i] & mask).bit_count() > (rows[i - 1] & mask).bit_count():
                j -= 1
            else:
                i -= 1
    return found


def lcs_sum_hits(reference: list[list[str]], candidate: list[list[str]]) -> int:
    """Union over candidate sentences of the subsequence hits of each reference sentence.

    A token counts at most as often as it occurs in each of the two texts: its places in the reference are distinct,
    those in the candidate are counted off. Equal sentences are compared once.
    """
    free = Counter(chain.from_iterable(candidate))
    others = [(sentence, places(sentence)) for sentence in {tuple(s): s for s in candidate if s}.values()]
    found: dict[tuple[str, ...], list[int]] = {}
    hits = 0
    for sentence in reference:
        key = tuple(sentence)
        if key not in found:
            union: set[int] = set()
            for other, where in others:
                if len(union) < len(sentence):
                    union |= lcs_positions(sentence, other, where)
            found[key] = sorted(union)
        for place in found[key]:
            token = sentence[place]
            if free[token] > 0:
                free[token] -= 1
                hits += 1
    return hits


def hits_of(keys: Sequence[str]) -> Callable[[Column, Column], Column]:
    """The function that counts, in token lines (see ``token_lines``) of two texts, tokens and the hits of some keys.

    Sums are over sentences for ``rougeLsum`` and over whole texts for the others. Other keys cost nothing.
    """
    asked = [k in keys for k in KEYS]

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for references, candidates in batches:
            found = np.zeros((len(references), len(HITS)), np.int32)
            # Rows without texts, such as those of other kinds, are passed over.
            for i in np.flatnonzero((references != "") | (candidates != "")):
                found[i] = _hits(references.iat[i], candidates.iat[i], *asked)
            yield pd.DataFrame(found, columns=HITS.names)

    return hits


def _hits(reference: str, candidate: str, one: bool, two: bool, whole: bool, lines: bool) -> tuple[int, ...]:
    a, b = reference.split(), candidate.split()
    if not a or not b:
        return len(a), len(b), 0, 0, 0, 0
    single = "\n" not in reference and "\n" not in candidate
    lcs = lcs_length(a, b) if whole or lines and single else 0
    of_lines = lcs
    if lines and not single:
        of_lines = lcs_sum_hits(*([line.split() for line in text.split("\n")] for text in (reference, candidate)))
    return (
        len(a), len(b), overlap(a, b) if one else 0, overlap(zip(a, a[1:]), zip(b, b[1:])) if two else 0, lcs, of_lines,
    )
