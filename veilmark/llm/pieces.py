"""SentencePiece BPE by vectorised merge rounds.

The model's pieces become one table of pairs: left symbol, right symbol -> merged piece and its rank by score.  Texts are
cut where no piece reaches across (before a run of space marks, round control characters that are in no longer piece, and
between letters and signs if no piece holds both side by side); each part that a task has not met before is encoded together with all other new parts of its batch: their symbols lie in one flat
array, each round finds the least rank in every part and merges its leftmost pairs of that rank at once, and finished
parts leave the arrays.  A part whose merge makes a pair that comes before the next merge of the round stops there, so
rounds make the same merges in the same order as one by one.  What ROUNDS leave (parts whose merges keep stopping the
round) is finished from where it stands by a heap, so long parts take n log n.  No rows shuffle; the memo of parts is bounded.
Symbols that are no pieces become bytes.  Decoding looks up the pieces' bytes, as the library does: the space mark is a
blank, the first one is dropped, control pieces print nothing, each byte that is no UTF-8 prints U+FFFD.

Results by case: null counts as empty and stays null, and empty texts have no ids; a null list decodes to an empty text;
repeated rows are all returned; pairs of one score merge leftmost first; texts are encoded whole; an empty table gives
none; extra columns pass through, but for one named like the output, which the output replaces.  Models with a
normalisation, other than BPE, without bytes, or with user-defined or unused pieces raise ValueError.
"""

from __future__ import annotations

import heapq
import re
from functools import cached_property, lru_cache
from itertools import chain, pairwise
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
#: Letters and digits; where no piece holds one of them beside a sign, texts are cut between the two.
WORDY = ascii_letters + digits + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
#: Parts that a task keeps with their ids; a part of more than LONG characters is not kept.
MEMO, LONG, ROUNDS = 1 << 19, 64, 256
NONE = np.iinfo(np.int32).max


class Model:
    """The tables of a model file's bytes."""

    def __init__(self, source: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=source)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.array([sp.is_byte(i) for i in range(n)])
        self.quiet = np.array([sp.is_control(i) for i in range(n)])
        self.controls = set(np.flatnonzero(self.quiet).tolist())
        self.unknown = sp.unk_id()
        normal = [i for i in range(n) if not (self.byte[i] or self.quiet[i] or i == self.unknown)]
        probe = "ﬁ  É\t x "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK) or self.byte.sum() != 256 or any(sp.is_unused(i) for i in normal):
            raise ValueError("only models with all bytes, a space before each text, and no other normalisation or unused pieces")
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal):
            raise ValueError("a piece holds a space mark after another sign")
        self.bytes_at = {b: next(i for i in range(n) if self.byte[i] and int(self.pieces[i][1:-1], 16) == b) for b in range(256)}
        # Characters that are in a piece but no piece themselves are symbols after the last piece.
        symbols = {self.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in self.pieces[i]} - symbols.keys()):
            symbols[c] = n + len(symbols) - len(normal)
        self.n, self.extra = n, {i: c for c, i in symbols.items() if i >= n}
        self.size = n + len(self.extra)
        score = {i: sp.get_score(i) for i in normal}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[score[i]], i)
        keys = sorted(pairs)
        # The last entry is that of all pairs that merge to nothing.
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.rank = np.array([*(pairs[k][0] for k in keys), NONE], np.int32)
        self.made = np.array([*(pairs[k][1] for k in keys), -1], np.int32)
        #: Symbol by code point; a sign that is none has its own negative number.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        long = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        lone = re.escape("".join(chr(c) for c in range(32) if chr(c) not in long))
        beside = {f for i in normal for a, b in pairwise(self.pieces[i]) for f in ((a, b), (b, a))}
        signs = re.escape("".join(c for c in punctuation if not any((c, w) in beside for w in WORDY)))
        wordy, other = re.escape(WORDY), f"[^{MARK}{lone}{signs}{re.escape(WORDY)}]"
        run = f"(?:[{wordy}]+|[{signs}]+)" if signs else f"[{wordy}]+"
        self.parts = re.compile((f"[{lone}]|" if lone else "") + f"{MARK}*{run}(?:{other}[^{MARK}{lone}]*)?|{MARK}*{other}[^{MARK}{lone}]*|{MARK}+")
        self.printed = [b"" if self.quiet[i] else b"" if self.byte[i] else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes_at.items():
            self.printed[i] = bytes([b])
        self.opens = [p.startswith(MARK) and not (self.byte[i] or self.quiet[i] or i == self.unknown) for i, p in enumerate(self.pieces)]

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        """Rank and merged piece by pair."""
        return {int(k): (int(r), int(i)) for k, r, i in zip(self.keys[:-1], self.rank, self.made)}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair table."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)


@lru_cache(maxsize=1)
def model(source: bytes) -> Model:
    return Model(source)


def by_heap(m: Model, symbols: list[int]) -> list[int]:
    """Merges one by one, by rank, then the leftmost."""
    n = len(symbols)
    left, right, gone = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(n)
    heap: list = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else -1
        if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (p := m.table.get(symbols[i] * m.size + symbols[j])):
            heapq.heappush(heap, (p[0], i, j, symbols[i], symbols[j], p[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], gone[j], right[i] = made, 1, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [s for s, x in zip(symbols, gone) if not x]


def rounds(m: Model, symbols: np.ndarray, part: np.ndarray, most: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their parts' numbers after all merges, by part; part ascends."""
    done_symbols, done_parts = [symbols[:0]], [part[:0]]
    pair = np.full(len(symbols), len(m.keys) - 1, np.int32)
    same = part[:-1] == part[1:]
    pair[:-1][same] = m.pair(symbols[:-1][same], symbols[1:][same])
    for _ in range(most):
        if not len(symbols):
            break
        rank = m.rank[pair]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(starts, append=len(part))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        open_ = least != NONE
        if not open_.all():
            done_symbols.append(symbols[~open_])
            done_parts.append(part[~open_])
            symbols, part, pair, rank, least = symbols[open_], part[open_], pair[open_], rank[open_], least[open_]
            if not len(symbols):
                break
        # Of pairs side by side every second one merges, from the left.
        at = np.flatnonzero(rank == least)
        head = np.diff(at, prepend=-2) != 1
        at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
        new, of, own = m.made[pair[at]], rank[at], part[at]
        beside = np.zeros(len(at), bool)
        beside[1:] = (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])
        before = np.where(beside, np.roll(new, 1), symbols[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (part[np.maximum(at - 1, 0)] == own)
        after = np.minimum(at + 2, len(symbols) - 1)
        has_right = (at + 2 < len(symbols)) & (part[after] == own)
        to_left = m.pair(np.where(has_left, before, -1), new)
        to_right = m.pair(new, np.where(has_right, symbols[after], -1))
        # A merge after which a pair comes first that was not there stops its part for this round.
        stops = (m.rank[to_left] <= of) | (m.rank[to_right] <= of)
        if stops.any():
            earlier = np.cumsum(stops) - stops
            first = np.diff(own, prepend=-1) != 0
            kept = earlier == earlier[first][np.cumsum(first) - 1]
            at, new, beside, has_left, to_left, to_right = (x[kept] for x in (at, new, beside, has_left, to_left, to_right))
        symbols[at] = new
        pair[at] = to_right
        pair[np.where(beside, at - 2, at - 1)[has_left]] = to_left[has_left]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, part, pair = symbols[stay], part[stay], pair[stay]
    for p in np.unique(part):
        merged = by_heap(m, symbols[part == p].tolist())
        done_symbols.append(np.array(merged, np.int32))
        done_parts.append(np.full(len(merged), p, part.dtype))
    symbols, part = np.concatenate(done_symbols), np.concatenate(done_parts)
    order = np.argsort(part, kind="stable")
    return symbols[order], part[order]


def encoded(m: Model, parts: list[str]) -> list[bytes]:
    """Ids (four bytes each) of parts, none of them empty."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(p) for p in parts])
    symbols, part = rounds(m, m.symbol[points], np.repeat(np.arange(len(parts), dtype=np.int32), sizes))
    ends = np.searchsorted(part, np.arange(len(parts) + 1))
    odd = (symbols < 0) | (symbols >= m.n)
    data = symbols.astype("<i4").tobytes()
    out = [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    for k in np.unique(part[odd]).tolist():
        ids = [i for s in symbols[ends[k] : ends[k + 1]].tolist() for i in ([s] if 0 <= s < m.n else [m.bytes_at[x] for x in (chr(-1 - s) if s < 0 else m.extra[s]).encode("utf-8", "surrogatepass")])]
        out[k] = np.array(ids, "<i4").tobytes()
    return out


def encoder(source: bytes):
    """texts -> the bytes of each one's ids; parts met before are not encoded again."""
    m, memo = model(source), {}

    def batch(texts: list[str | None]) -> list[bytes]:
        cut = [m.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)) - memo.keys())
        if new:
            memo.update(zip(new, encoded(m, new), strict=True))
        out = [b"".join(map(memo.__getitem__, c)) for c in cut]
        if len(memo) > MEMO:
            memo.clear()
        for w in new:
            if len(w) > LONG:
                memo.pop(w, None)
        return out

    return batch


def _passed(df: DataFrame, drop: set[str]) -> list[str]:
    return [c for c in df.columns if c not in drop]


def encode(docs: DataFrame, source: bytes, text_col: str = "text", out_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """docs (without the text if drop_text) plus out_col array<int>; source is the model file's content."""
    held = docs.sparkSession.sparkContext.broadcast(source)
    cols = _passed(docs, {out_col} | ({text_col} if drop_text else set()))
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").cast("string").alias("__text"))
    target = StructType([given.schema[c] for c in cols] + [StructField(out_col, ArrayType(IntegerType(), False))])

    def run(batches):
        work = encoder(held.value)
        for b in batches:
            made = work(b.column(len(cols)).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], ids], names=[*cols, out_col])

    return given.mapInArrow(run, target)


def text_of(m: Model, ids: list[int]) -> str:
    """As the library decodes; ids outside the model raise IndexError."""
    first = next((i for i, x in enumerate(ids) if not m.quiet[x]), None)
    if first is None:
        return ""
    data = list(map(m.printed.__getitem__, ids))
    if m.opens[ids[first]]:
        data[first] = data[first][1:]
    if m.controls.isdisjoint(ids):
        try:
            return b"".join(data).decode("utf-8")
        except UnicodeDecodeError:
            pass
    out, run = [], b""
    for i, d in zip([*ids, None], [*data, b""], strict=True):
        if i is not None and m.byte[i]:
            run += d
            continue
        out.append(lenient(run))
        out.append(d.decode("utf-8"))
        run = b""
    return "".join(out)


def lenient(data: bytes) -> str:
    """UTF-8 in which each byte that starts no whole character prints U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def decode(df: DataFrame, source: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df plus out_col, the text of ids_col."""
    held = df.sparkSession.sparkContext.broadcast(source)
    cols = _passed(df, {out_col})
    given = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    target = StructType([given.schema[c] for c in cols] + [StructField(out_col, StringType())])

    def run(batches):
        m = model(held.value)
        for b in batches:
            texts = [text_of(m, [i for i in ids if i is not None]) if ids else "" for ids in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(texts, pa.string())], names=[*cols, out_col])

    return given.mapInArrow(run, target)


def digest(df: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
