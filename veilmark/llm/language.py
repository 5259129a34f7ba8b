"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A model holds log probabilities of hashed letter trigrams for each language (a fixed-size table, whatever the corpus)
and the scripts each language was seen in.  A word's score for a language is the sum over its trigrams.  The best path
pays SWITCH for each change of language.  If, for the best single language a and every other b, no stretch of words
favours b over a by more than SWITCH, then a alone is the best path, so the dynamic program runs on mixed texts only.

fit is the share of letters that some learned language accounts for: in words of a script that one was seen in, and in
spans whose trigrams are on average no less likely than chance (FLOOR).  Without a learned language every letter fits.

Results by case: null text, empty text and text without a letter give `und` with score 0, fit 0 and no spans; ties go to the
language that sorts first; equal texts, so repeated rows, give equal results; texts are read whole; an empty table gives no rows, and one without a language to
learn `und` everywhere; other columns are not looked at, and a key named like an output is replaced by it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

BUCKETS, SWITCH = 1 << 15, 25.0
#: Languages that a task counts at once.
HELD = 64
#: Mean log probability of a trigram by chance, less what smoothing takes from small training tables.
FLOOR = -float(np.log(BUCKETS)) - 0.25
#: First and last code points of scripts; letters outside count as "other".
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of each letter's script."""
    out = np.full(len(points), len(SCRIPTS))
    for i, (_, low, high) in enumerate(SCRIPTS):
        out[(points >= low) & (points <= high)] = i
    return out


def analysed(text: str | None):
    """(trigram bucket of each letter, where words begin among the letters, letters' places, words' scripts); None without letters."""
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[c]
    at = np.flatnonzero(alpha)
    if not len(at):
        return None
    a = np.zeros(len(c) + 2, np.uint64)
    a[1:-1] = np.where(alpha, c, 0)
    h = (a[at] * np.uint64(1000003) + a[at + 1]) * np.uint64(1000003) + a[at + 2]
    h = (h ^ h >> np.uint64(15)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), starts, at, scripts_of(c[at[starts]])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Trigram and script counts over all training rows in one pass, summed by task before the shuffle.

    Only buckets x languages numbers reach the driver.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 5) != 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        made: dict[str, np.ndarray] = {}

        def rows_of():
            for lang, n in made.items():
                at = np.flatnonzero(n)
                # -1 says that there is such a language, though it may have no letters.
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([-1, *at.tolist()], pa.int32()), pa.array([0, *n[at].tolist()], pa.int64())], names=["lang", "bucket", "n"])
            made.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in made and len(made) >= HELD:
                    yield from rows_of()
                n = made.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                if (found := analysed(text)) is not None:
                    n[:BUCKETS] += np.bincount(found[0], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(found[3], minlength=len(SCRIPTS) + 1)
        yield from rows_of()

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total: dict[str, np.ndarray] = {}
    for lang, bucket, n in zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), counted.column(2).to_pylist(), strict=True):
        own = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1))
        if bucket >= 0:
            own[bucket] = n
    langs = sorted(total)
    grams = {k: v[:BUCKETS] for k, v in total.items()}
    table = np.stack([np.log((grams[k] + 0.5) / (grams[k].sum() + 0.5 * BUCKETS)) for k in langs], axis=1).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
    seen = np.stack([total[k][BUCKETS:] > 0.001 * max(1, total[k][BUCKETS:].sum()) for k in langs], axis=1) if langs else np.zeros((len(SCRIPTS) + 1, 0), bool)
    return {"langs": langs, "table": table, "seen": seen}


def best_path(scores: np.ndarray) -> np.ndarray:
    """Language number of each word."""
    a = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, a : a + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)
    if (gain - low).max() <= SWITCH:
        return np.full(len(scores), a)
    v, back = scores[0].astype(np.float64), np.zeros(scores.shape, np.int32)
    own = np.arange(scores.shape[1])
    for i in range(1, len(scores)):
        top = int(v.argmax())
        stay = v >= v[top] - SWITCH
        back[i] = np.where(stay, own, top)
        v = np.where(stay, v, v[top] - SWITCH) + scores[i]
    path = np.empty(len(scores), np.int64)
    path[-1] = v.argmax()
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def labeller(model: dict):
    langs, table, seen = model["langs"], model["table"], model["seen"]

    def label(text):
        found = analysed(text)
        if found is None or not langs:
            return "und", 0.0, [], float(found is not None)
        buckets, starts, at, scripts = found
        scores = plain = np.add.reduceat(table[buckets], starts, axis=0)
        fits = seen[scripts]
        narrow = fits.any(axis=1, keepdims=True) & ~fits
        scores = np.where(narrow, scores.min(axis=1, keepdims=True) - 10, scores)
        path = best_path(scores)
        sizes = np.diff(starts, append=len(at))
        weight = np.bincount(path, weights=sizes, minlength=len(langs))
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        ends = [*starts[1:].tolist(), len(at)]
        spans = [{"start": int(at[starts[i]]), "end": int(at[ends[j - 1] - 1]) + 1, "lang": langs[path[i]]} for i, j in zip(cuts, cuts[1:])]
        # By span: letters, those in a known script, and how likely the span's trigrams are in its language.
        known, total, likely = (np.add.reduceat(x, cuts[:-1]) for x in (sizes * fits.any(axis=1), sizes, plain[np.arange(len(path)), path].astype(np.float64)))
        fit = known[likely >= FLOOR * total].sum() / len(at)
        return langs[int(weight.argmax())], float(weight.max() / weight.sum()), spans, float(fit)

    return label


def identify(docs: DataFrame, model: dict, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, lang_pred, score (share of letters in that language's spans), the spans of mixed-language text, and fit."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        label = labeller(held.value)

        def batch(texts):
            out = [label(t) for t in texts]
            return {"lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "lang_spans": [o[2] for o in out], "fit": [o[3] for o in out]}

        return batch

    return map_texts(docs, keys, "lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>, fit double", setup, text_col)


__all__ = ["best_path", "identify", "labeller", "train"]
