"""Language identification of whole texts and of the spans in mixed ones."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import mixed, release, released, slices
from taskmill.scale import lookup, settle

# About this many documents of each language are enough to learn its n-grams; a hash of the text picks them.
FIT_ROWS = 2000
BINS = 1 << 15
GRAMS = (1, 2, 3, 4)
# A word cannot speak for or against a language with more than this many nats.
CLIP = 3.0
# What a change of language inside a text costs, in nats.
SWITCH = 15.0
# A script belongs to a language if this share of its words is written in it.
SCRIPT_SHARE = 0.01
# The words of about so much text, and always whole texts, are scored together.
CHARS_AT_ONCE = 512 * 1024

# Where blocks of scripts begin and what they are (fixed values, from the Unicode charts).
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2E80, "han"), (0x3000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [start for start, _ in SCRIPT_STARTS]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT = [SCRIPTS.index(name) for _, name in SCRIPT_STARTS]
_OTHER, _LATIN = SCRIPTS.index("other"), SCRIPTS.index("latin")

# ASCII characters that are no letters end a word.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """The languages, the log-probability of every n-gram bin in each, and the scripts each is written in."""

    languages: tuple[str, ...]
    grams: np.ndarray
    scripts: np.ndarray


def letter_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split() if text else []


def script_of(word: bytes) -> int:
    """The script of the first letter that tells one."""
    if word[0] < 128:
        return _LATIN
    for character in word.decode("utf-8", "replace"):
        script = _SCRIPT[bisect_right(_STARTS, ord(character)) - 1]
        if script != _OTHER:
            return script
    return _OTHER


def gram_bins(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all n-grams of the words, spaces around them, and the place of each gram's word.

    The whole word is one gram more.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    word = np.searchsorted(ends, np.arange(len(data)) - 1, side="right")
    place = np.minimum(word, len(words) - 1)
    bins, owner = [], []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            # The space before a word belongs to the word before it, except as the start of a gram.
            first = np.arange(len(code)) + (data[: len(code)] == 32)
            last = np.arange(len(code)) + n - 1
            at = place[np.minimum(first, len(data) - 1)]
            good = (at == place[last]) & (first <= last)
            bins.append(mixed(code[good] ^ np.uint64(n << 56)) % np.uint64(BINS))
            owner.append(at[good])
    column = np.empty(len(words), dtype=object)
    column[:] = words
    bins.append(mixed(pd.util.hash_array(column, categorize=False)) % np.uint64(BINS))
    owner.append(np.arange(len(words)))
    return np.concatenate(bins).astype(np.int64), np.concatenate(owner)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS,
) -> LanguageModel:
    """Learn from the documents with a language and text: about ``fit_rows`` of each language.

    Which rows these are follows from a hash of the text; a language with fewer rows is used whole. What
    comes to the driver is one vector of counts per language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    sizes = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    picked = lookup(rows, sizes, ["lang"], "inner").where(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) * F.col("rows") < fit_rows * 1_000_000
    ).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = letter_words(value)
                if words:
                    total = totals.setdefault(name, np.zeros(BINS + len(SCRIPTS), np.int64))
                    total += np.bincount(gram_bins(words)[0], minlength=len(total))
                    total += np.bincount([BINS + script_of(w) for w in words], minlength=len(total))
        for name, total in totals.items():
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(place)), pa.array(place, pa.int32()), pa.array(total[place], pa.int64())],
                names=["lang", "bin", "n"],
            )

    counts = picked.mapInArrow(released(count), "lang string, bin int, n bigint").groupBy("lang", "bin").agg(
        F.sum("n").alias("n")
    ).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).orderBy("lang").collect()
    vectors = []
    for row in counts:
        vector = np.zeros(BINS + len(SCRIPTS))
        vector[[x["bin"] for x in row["bins"]]] = [x["n"] for x in row["bins"]]
        vectors.append(vector)
    table = np.array(vectors).reshape(len(vectors), BINS + len(SCRIPTS))
    grams, scripts = table[:, :BINS] + 0.5, table[:, BINS:]
    grams = np.log(grams / grams.sum(axis=1, keepdims=True)) if len(grams) else grams
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(
        tuple(row["lang"] for row in counts), grams.T.astype(np.float32), (share >= SCRIPT_SHARE).T
    )


def word_scores(words: list[bytes], model: LanguageModel) -> np.ndarray:
    """What every word says for every language, in nats against the mean of the candidates.

    The script of a word narrows the candidates; a word in a script that no language has says nothing.
    """
    bins, owner = gram_bins(words)
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(words)))
    total = np.add.reduceat(model.grams[bins[order]], begins, axis=0)
    candidates = model.scripts[[script_of(w) for w in words]]
    any_left = candidates.any(axis=1, keepdims=True)
    mean = np.where(candidates, total, 0).sum(axis=1, keepdims=True) / np.maximum(1, candidates.sum(axis=1, keepdims=True))
    score = np.clip(total - mean, -CLIP, CLIP)
    return np.where(any_left, np.where(candidates, score, -CLIP), 0).astype(np.float64)


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word in order, where each change costs ``switch``.

    If no language gains more than half a switch over the best one on any stretch, no way through several
    languages can pay, and the stretches need not be searched.
    """
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    least = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - least).max() <= switch / 2:
        return np.full(len(scores), best)
    rows, came = scores.tolist(), []
    value = rows[0]
    for row in rows[1:]:
        top = max(value)
        leader, entry = value.index(top), top - switch
        came.append([i if v >= entry else leader for i, v in enumerate(value)])
        value = [(v if v >= entry else entry) + r for v, r in zip(value, row)]
    state = value.index(max(value))
    out = [state]
    for step in reversed(came):
        state = step[state]
        out.append(state)
    return np.array(out[::-1])


def _judged(texts: list[str | None], model: LanguageModel, switch: float) -> Iterator[tuple[str, float, list[dict]]]:
    words = [letter_words(t) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=object)
    flat[:] = [w for ws in words for w in ws]
    if not len(flat) or not model.languages:
        for _ in texts:
            yield "und", 0.0, []
        return
    codes, distinct = pd.factorize(flat)
    scores = word_scores(list(distinct), model)
    for ws, end in zip(words, ends):
        if not ws:
            yield "und", 0.0, []
            continue
        here = scores[codes[end - len(ws) : end]]
        labels = label_words(here, switch)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        counts = np.bincount(labels, minlength=len(model.languages))
        # Ties between languages go to the one that scores higher over the whole text, then by name.
        total = here.sum(axis=0)
        best = max(range(len(counts)), key=lambda i: (counts[i], total[i], -i))
        others = np.delete(total, best)
        margin = total[best] - others.max() if len(others) else CLIP
        sure = 1 / (1 + np.exp(-np.clip(margin / CLIP, -30, 30)))
        spans = [
            {"begin": int(a), "len": int(b - a), "lang": model.languages[labels[a]]}
            for a, b in zip(edges[:-1], edges[1:])
        ]
        yield model.languages[best], float(counts[best] / len(ws) * sure), spans


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Add ``lang_pred, score`` and ``spans`` (stretches of letter words with their language).

    A text is given the language of most of its words; the score is their share times the certainty that
    this language beats the next over the whole text. Texts that are null or have no letter get ``und``,
    score 0 and no spans, and so does everything if the model knows no language. Repeated rows are judged
    alike; other columns stay, old ones of the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, spans array<struct<begin:int,len:int,lang:string>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = sent.value
        try:
            for texts in batches:
                for a, b in slices([len(t or "") for t in texts], CHARS_AT_ONCE):
                    rows = list(_judged(texts.iloc[a:b].tolist(), fitted, switch))
                    yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])
        finally:
            release()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    # Not to be moved: a filter on the outcome would otherwise judge every text a second time.
    return docs.withColumn("__judged", judge.asNondeterministic()(lettered)).select(
        *kept, "__judged.lang_pred", "__judged.score", "__judged.spans"
    )
