"""Phrase collocations by pivot partitioning.

A first pass counts words by language.  Words of LEAST or more occurrences go into a table of hashed cells (CELLS at most,
the largest count in each), which every task gets: it tells, never too low, how frequent a word is, and so orders all words
from rare to frequent, the hash deciding among equals.  A word of an empty cell is in no candidate and is blanked.  The
second pass rewrites texts into fragments: round each word, its pivot, the neighbours that are no rarer, as far as a phrase
reaches.  Every n-gram lies in just one of its occurrences' fragments, that of its rarest word (the first, if it comes
twice).  Equal fragments of a block of text are counted together and routed by pivot in packed rows; words that are
frequent enough for the bounded head travel as numbers.  Each part mines its fragments, and emits only n-grams with its pivots.
Pivots of more than HOT occurrences are dealt to several parts, whose counts are then added.  Phrases, their parts' counts
and scores are joined as tables, and ranks are places in a range-partitioned order, so no task gets a language.

Results by case: null counts as empty, null languages are `und`; repeated rows count each time; texts are counted whole; ties
follow the order given (score, count, phrase in UTF-8 order); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.tokens import with_numbers

from .bpe import packed, unpacked
from .common import keep

LEAST, LONGEST, PERCENT, TOP = 10, 3, 50, 2000
#: Cells and words that every task gets at most; bytes of text in a block; words that a task keeps; words a part.
CELLS, HEAD, BLOCK, MEMO, PART, HOT = 1 << 22, 1 << 16, 1 << 22, 1 << 20, 1 << 18, 1 << 20
CUT = b"\xff"
#: A-Z in lower case, and a byte that no text holds for each sign at which pieces end.
PLAIN = bytes(255 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def blocks(batches, size: int):
    """(language, bytes): texts of one language in lower case with CUT between pieces, in blocks of about size bytes."""
    held: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}

    def cut(lang: str):
        data = CUT.join(held.pop(lang)).translate(PLAIN)
        room.pop(lang)
        while len(data) > 2 * size:
            at = data.rfind(CUT, 0, size)
            at = data.find(CUT, size) if at <= 0 else at
            if at < 0:
                break
            yield lang, data[:at]
            data = data[at:]
        yield lang, data

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                room[lang] = room.get(lang, 0) + len(text)
                if room[lang] >= size:
                    yield from cut(lang)
        if sum(room.values()) > 4 * size:
            for lang in list(held):
                yield from cut(lang)
    for lang in list(held):
        yield from cut(lang)


def words_of(data: bytes) -> list[bytes]:
    """Words and, between pieces, CUT."""
    return data.replace(CUT, b" \xff ").split()


def hashed(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def counted(texts: DataFrame) -> DataFrame:
    """lang, word, n of each task's words; a null word has the number of all."""

    def run(batches):
        seen: dict[str, dict[bytes, int]] = {}
        tallies: dict[str, np.ndarray] = {}

        def out():
            for lang, memo in seen.items():
                n = tallies[lang]
                words = [w.decode("utf-8", "replace") for w in memo]
                n[0] = 0  # the cuts
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words))), pa.array([None, *words[1:]], pa.string()), pa.array([int(n.sum()), *n[1 : len(words)].tolist()], pa.int64())], names=["lang", "word", "n"])
            seen.clear()
            tallies.clear()

        for lang, data in blocks(batches, BLOCK):
            memo = seen.setdefault(lang, {CUT: 0})
            words = words_of(data)
            ids = list(map(memo.get, words))
            if None in ids:
                for i, k in enumerate(ids):
                    if k is None:
                        ids[i] = memo.setdefault(words[i], len(memo))
            n = np.bincount(np.array(ids, np.int64), minlength=len(memo))
            old = tallies.get(lang, n[:0])
            n[: len(old)] += old
            tallies[lang] = n
            if sum(map(len, seen.values())) > MEMO:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word string, n bigint")


def cells_of(words: DataFrame, most: int) -> np.ndarray:
    """The largest count in each cell; at most `most` cells, which the driver gathers as two columns."""
    size = 1 << 10
    while size < most and size < 4 * words.count():
        size *= 2

    def place(batches):
        for b in batches:
            at = [hashed(lang, w.encode()) & (size - 1) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(2)], names=["cell", "n"])

    found = words.select("lang", "word", "n").mapInArrow(place, "cell int, n bigint").groupBy("cell").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(size, np.uint32)
    out[found.column(0).to_numpy()] = np.minimum(found.column(1).to_numpy(), 0xFFFFFFFF)
    return out


def grouped(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns (whole numbers from 0), and the sum of their weights."""
    if not len(weight):
        return columns, weight
    bits = max(1, max(int(c.max()) for c in columns).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for i in range(0, len(columns), each):
        key = np.zeros(len(weight), np.int64)
        for c in columns[i : i + each]:
            key = (key << bits) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(weight), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(weight[order], first)


def windows(x: np.ndarray, rarity: np.ndarray, longest: int) -> list[np.ndarray]:
    """Columns of fragments: 2 * longest - 1 numbers round each pivot, 0 beyond its reach; x is 0 where blank, with rarity 0."""
    n, r = len(x), longest - 1
    wide, rare = np.pad(x, r), np.pad(rarity, r)
    at = lambda a, d: a[r + d : r + d + n]
    left, right, some = [], [], np.zeros(n, bool)
    for side, near in ((left, -1), (right, 1)):
        reach = x > 0
        for d in range(1, longest):
            other = at(rare, near * d)
            reach = reach & ((other > rarity) if near < 0 else (other >= rarity))
            side.append(np.where(reach, at(wide, near * d), 0))
            if d == 1:
                some |= reach
    return [c[some] for c in [*left[::-1], x, *right]]


FRAGMENTS = "part bigint, lang string, shared boolean, n int, names binary, data binary"


def fragments(texts: DataFrame, cells: np.ndarray, head: list[tuple[str, str]], parts: int, longest: int, hot: int) -> DataFrame:
    """Packed fragments with their counts, a row for each block and part; shared: other parts have fragments of these pivots."""
    held = texts.sparkSession.sparkContext.broadcast((cells, head))

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        cells, head = held.value
        size, heads = len(head), {}
        for i, (lang, w) in enumerate(head):
            heads.setdefault(lang, {})[w.encode()] = i + 1
        state, turn = {}, TaskContext.get().partitionId()

        def fresh(lang: str):
            """word -> number, rarity by number, hash by number, names after the head."""
            own = {CUT: 0}
            rarity, hashes = np.zeros(size + 1, np.uint64), np.zeros(size + 1, np.uint64)
            for w, i in heads.get(lang, {}).items():
                h = hashed(lang, w)
                rarity[i], hashes[i] = (int(cells[h & (len(cells) - 1)]) << 32) | (h >> 32), h
            return own | heads.get(lang, {}), array("Q", rarity.tobytes()), array("Q", hashes.tobytes()), []

        for lang, data in blocks(batches, BLOCK):
            turn += 1
            if lang not in state or len(state[lang][0]) > MEMO:
                state[lang] = fresh(lang)
            if sum(len(s[0]) for s in state.values()) > 2 * MEMO:
                state = {lang: state[lang]}
            memo, rarity, hashes, names = state[lang]
            words = words_of(data)
            ids = list(map(memo.get, words))
            if None in ids:
                for i, k in enumerate(ids):
                    if k is None:
                        w = words[i]
                        if w not in memo:
                            h = hashed(lang, w)
                            n = int(cells[h & (len(cells) - 1)])
                            memo[w] = len(rarity) if n else 0
                            if n:
                                rarity.append((n << 32) | (h >> 32))
                                hashes.append(h)
                                names.append(w)
                        ids[i] = memo[w]
            rare = np.array(rarity, np.uint64)
            x = np.array(ids, np.int64)
            found, count = grouped(columns := windows(x, rare[x], longest), np.ones(len(columns[0]), np.int64))
            if not len(count):
                continue
            pivot = found[longest - 1]
            deals = 1 + (rare[pivot] >> np.uint64(32)) // np.uint64(hot)
            part = ((np.array(hashes, np.uint64)[pivot] >> np.uint64(8)) + np.uint64(turn) % deals * np.uint64(0x9E3779B1)) % np.uint64(parts)
            shared = deals > 1
            key = part.astype(np.int64) * 2 + shared
            order = np.argsort(key, kind="stable")
            key = key[order]
            table = np.stack([*found, count])[:, order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                own = table[:, a:b].copy()
                late = own[:-1] > size
                used = np.unique(own[:-1][late])
                own[:-1][late] = size + 1 + np.searchsorted(used, own[:-1][late])
                out.append((int(key[a]) >> 1, lang, bool(key[a] & 1), b - a, squeeze.compress(b" ".join(names[i - size - 1] for i in used.tolist())), packed(own.ravel(), squeeze)))
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "lang", "shared", "n", "names", "data"])

    return texts.mapInArrow(run, FRAGMENTS)


def mined(packs: DataFrame, head: list[tuple[str, str]], longest: int, least: int) -> DataFrame:
    """lang, phrase, size, n of the n-grams in each part; where the part has all of a pivot, only those of `least` or more."""
    held = packs.sparkSession.sparkContext.broadcast([w.encode() for _, w in head])

    def run(batches):
        import zstandard

        widen, head = zstandard.ZstdDecompressor(), held.value
        base = len(head) + 1

        def mine(key, rows):
            number: dict[bytes, int] = {}
            tables = []
            for n, names, data in rows:
                own = unpacked(data, widen).reshape(-1, n)
                words = widen.decompress(names).split(b" ")
                to = np.array([number.setdefault(w, base + len(number)) for w in words] if words != [b""] else [0], np.int64)
                late = own[:-1] >= base
                own[:-1][late] = to[own[:-1][late] - base]
                tables.append(own)
            *columns, count = np.concatenate(tables, axis=1)
            word = [b"", *head, *number]
            for size in range(2, longest + 1):
                spans = [columns[s : s + size] for s in range(longest - size, longest)]
                met = [(s[0] > 0) & (s[-1] > 0) for s in spans]
                rows, n = grouped([np.concatenate([s[i][m] for s, m in zip(spans, met)]) for i in range(size)], np.concatenate([count[m] for m in met]))
                if not key[2]:
                    rows, n = [r[n >= least] for r in rows], n[n >= least]
                phrases = [b" ".join(map(word.__getitem__, p)).decode("utf-8", "replace") for p in zip(*(r.tolist() for r in rows))]
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array([size] * len(phrases), pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "size", "n"])

        last, rows = None, []
        for b in batches:
            for part, lang, shared, n, names, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, lang, shared) != last:
                    if rows:
                        yield from mine(last, rows)
                    last, rows = (part, lang, shared), []
                rows.append((n, names, data))
        if rows:
            yield from mine(last, rows)

    dealt = packs.repartition("part").sortWithinPartitions("part", "lang", "shared")
    return dealt.mapInArrow(run, "lang string, phrase string, size int, n bigint")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(phrases of 1 to longest words with n >= least: lang, phrase, size, n; all words: lang, total)."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    all_words = counted(texts).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = keep(all_words.filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = words.filter(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    words = words.filter(F.col("word").isNotNull())
    cells = cells_of(words, CELLS)
    head = [(r["lang"], r["word"]) for r in words.orderBy(F.desc("n"), "lang", "word").limit(HEAD).select("lang", "word").toArrow().to_pylist()]
    parts = 1 + (totals.agg(F.sum("total")).first()[0] or 0) // PART
    found = mined(fragments(texts, cells, head, parts, longest, hot), head, longest, least)
    grams = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return keep(words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n").unionByName(grams), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP, hot: int = HOT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    known, totals = frequent(docs, least, longest, text_col, lang_col, hot)
    phrases = known.filter(F.col("size") > 1).select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = known.filter(F.col("size") < longest)
    # Cuts after k words, and both parts' counts.
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("1000000bd * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # The most frequent longer phrase round each shorter one.
    longer = phrases.filter(F.col("size") > 2).withColumn("w", F.split("phrase", " ")).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("i", F.explode(F.expr("sequence(1, size - m + 1)"))).select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), F.col("a").alias("round"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("round").alias("round"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("round").isNull() | (100 * F.col("round") < percent * F.col("a")))
    ranked = with_numbers(left.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.struct((-F.col("m.score")).alias("s"), (-F.col("a")).alias("c"), "phrase").alias("place")), "lang", "place")
    return ranked.filter(F.col("num") <= top).join(totals, "lang").select("lang", F.col("num").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP) -> str:
    return f"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as t from documents),
w as materialized (select lang, regexp_extract_all(t, '[^\\x20\\x09]+') as w from t),
u as (select lang, count(*) as n from (select lang, unnest(w) from w) group by 1),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as p from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, {longest + 1}) s(m))),
f as materialized (select lang, m, p, count(*) as n from g group by all having count(*) >= {least}),
c as (select lang, m, p, n as a, string_split(p, ' ') as w, k from f, range(1, {longest}) s(k) where m > 1 and k < m),
s as (select c.lang, c.m, c.p, a, k, x.n as l, y.n as r, cast(cast(1000000 as hugeint) * a * a // (cast(x.n as hugeint) * y.n) as bigint) as score
  from c join f x on x.lang = c.lang and x.p = array_to_string(w[1:k], ' ') join f y on y.lang = c.lang and y.p = array_to_string(w[k + 1:], ' ')),
b as (select lang, m, p, a, min_by(l, (score, k)) as l, min_by(r, (score, k)) as r, min(score) as score from s group by all),
o as (select lang, p, max(n) as longer from (select lang, n, unnest(list_distinct(flatten(list_transform(range(2, m), lambda z: list_transform(range(1, m - z + 2), lambda i: array_to_string(string_split(p, ' ')[i:i + z - 1], ' ')))))) as p from f where m > 2) group by all),
d as (select b.lang, p, a, l, r, score from b left join o using (lang, p) where longer is null or 100 * longer < {percent} * a),
k as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from d)
select lang, rank, p as phrase, a, l, r, n, score from k join u using (lang) where rank <= {top}
"""
