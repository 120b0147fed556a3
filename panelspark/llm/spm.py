"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into words that no piece of the vocabulary crosses.  The distinct
words of a batch are one flat array of symbols.  In each round every word finds the
least rank of its adjacent pairs (a segmented minimum) and merges that pair wherever
it occurs, leftmost first, all words at once; words without a pair leave the array,
and the rest is compacted until no pair remains.

The library always merges the best pair of a text, leftmost of equals, and looks
again.  A round does several such steps at once.  It gives the same result as long as
no merge makes a pair of the same or a better rank; where one does, the round ends
behind it, or, with many places left in one word, goes on through that word from left
to right.  Nothing is approximated, and a word of n symbols needs no more rounds than
it has ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Rank of a pair that no piece spells.
NONE = np.iinfo(np.int64).max
#: Symbols whose ids a task keeps for later batches, and characters encoded at once.
KEPT_IDS = 2_000_000
CHUNK_CHARS = 250_000
#: Places of a word that a round may leave to later ones.
LEFT_OVER = 32
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Tables:
    """What encoding and decoding need of a model; its size is that of the vocabulary."""

    code_points: np.ndarray  # of the characters that occur in pieces, ascending
    symbols: np.ndarray  # of those characters: their piece, else a number past the pieces
    neighbours: np.ndarray  # pairs of characters that stand together in a piece, ascending
    pairs: np.ndarray  # left symbol * base + right symbol, ascending
    merged: np.ndarray  # symbol that a pair becomes
    ranks: np.ndarray  # of a pair, 0 is merged first
    base: int
    byte_ids: np.ndarray  # piece of each byte
    spelled: np.ndarray  # bytes of all pieces as decoded, one after the other
    ends: np.ndarray  # where each piece ends there
    spaced: np.ndarray  # pieces that begin with a space
    control: np.ndarray
    begin: int
    end: int


def read_model(path: str) -> Tables:
    """Tables of a BPE model with byte fallback, a space put before each text and no
    normalisation of characters; any other model is refused with ValueError."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if sp.normalize("ﬁ  x　") != f"{SPACE}ﬁ{SPACE}{SPACE}x　":
        raise ValueError("only models that keep all characters and put a space before the text")
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(sp.is_byte(i) for i in byte_ids):
        raise ValueError("only models with byte fallback")
    plain = {
        sp.id_to_piece(i): i
        for i in range(n)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    }
    chars = sorted({c for piece in plain for c in piece})
    symbol = plain | {c: n + k for k, c in enumerate(chars) if c not in plain}
    scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
    rank = {s: k for k, s in enumerate(scores)}
    base = n + len(chars)
    rows = sorted(
        (symbol[p[:k]] * base + symbol[p[k:]], i, rank[sp.get_score(i)])
        for p, i in plain.items()
        for k in range(1, len(p))
        if p[:k] in symbol and p[k:] in symbol
    )
    pairs, merged, ranks = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    together = sorted({ord(a) << 32 | ord(b) for p in plain for a, b in zip(p, p[1:], strict=False)})
    own_byte = {i: bytes([b]) for b, i in enumerate(byte_ids)}
    spelled = [
        own_byte.get(i)
        or (b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode())
        for i in range(n)
    ]
    spelled[sp.unk_id()] = " ⁇ ".encode()
    tables = Tables(
        np.array([ord(c) for c in chars], dtype=np.uint32),
        np.array([symbol[c] for c in chars], dtype=np.int64),
        np.array(together, dtype=np.uint64),
        pairs,
        merged,
        ranks,
        base,
        np.array(byte_ids, dtype=np.int64),
        np.frombuffer(b"".join(spelled), dtype=np.uint8),
        np.cumsum([len(s) for s in spelled]),
        np.array([sp.id_to_piece(i).startswith(SPACE) for i in range(n)]),
        np.array([sp.is_control(i) for i in range(n)]),
        sp.bos_id(),
        sp.eos_id(),
    )
    probe = "The quick  brown fox, evolution 1234 é中\u0000" + " " * 20 + "x" * 50
    if encode_words([SPACE + probe.replace(" ", SPACE)], tables)[0].tolist() != sp.encode(probe):
        raise ValueError("the model does not merge by the scores of its pieces")
    return tables


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in ``sorted_keys``, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def pair_ranks(left: np.ndarray, right: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each pair; symbol -1 is in no pair."""
    at, there = found(t.pairs, left * t.base + right)
    there &= (left >= 0) & (right >= 0)
    return np.where(there, t.ranks[at], NONE), t.merged[at]


def scan(symbols: list[int], rank: int, known: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """All merges of one word up to ``rank``, the least one of its pairs, in one pass.

    Left of the current symbol all pairs are worse than ``rank``, so the next merge
    takes it with a neighbour, or is the next place of ``rank`` to the right.
    """
    none = (NONE, -1)
    done: list[int] = []
    k, n = 0, len(symbols)
    while k < n:
        current = symbols[k]
        k += 1
        while True:
            before = known.get((done[-1], current), none) if done else none
            after = known.get((current, symbols[k]), none) if k < n else none
            if min(before[0], after[0]) > rank:
                break
            if before[0] <= after[0]:
                done.pop()
                current = before[1]
            else:
                k += 1
                current = after[1]
        done.append(current)
    return done


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of words that begin at ``starts``, and the place where each began."""
    place = np.arange(len(symbols))
    word = np.zeros(len(symbols), dtype=np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    known: dict[tuple[int, int], tuple[int, int]] = {}
    out = []
    rank, into = np.full(len(symbols), NONE), np.full(len(symbols), -1)
    if len(symbols) > 1:
        rank[:-1], into[:-1] = pair_ranks(symbols[:-1], symbols[1:], t)
        rank[:-1][word[:-1] != word[1:]] = NONE
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(symbols)])
        least = np.minimum.reduceat(rank, first)
        if (least == NONE).any():
            over = np.repeat(least == NONE, size)
            out.append((place[over], symbols[over]))
            stay = ~over
            symbols, place, word, rank, into = (x[stay] for x in (symbols, place, word, rank, into))
            continue
        # Of overlapping places of the same rank every other one, from the left.
        hit = rank == np.repeat(least, size)
        run = np.flatnonzero(hit)
        begins = np.r_[True, run[1:] != run[:-1] + 1]
        offset = run - np.maximum.accumulate(np.where(begins, run, 0))
        chosen = run[offset % 2 == 0]
        new = into[chosen]
        # A merge after which a neighbour is as good or better ends the round of its word.
        beside = np.maximum(chosen - 1, 0)
        left = np.where((chosen > 0) & (word[beside] == word[chosen]), symbols[beside], -1)
        after = chosen[:-1] + 2 == chosen[1:]
        left[1:] = np.where(after & (word[chosen[1:]] == word[chosen[:-1]]), new[:-1], left[1:])
        beside = np.minimum(chosen + 2, len(symbols) - 1)
        right = np.where((chosen + 2 < len(symbols)) & (word[beside] == word[chosen]), symbols[beside], -1)
        opens = np.minimum(pair_ranks(left, new, t)[0], pair_ranks(new, right, t)[0]) <= rank[chosen]
        scanned = False
        if opens.any():
            of = word[chosen]
            earlier = np.cumsum(opens) - opens
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            n_of = np.diff(np.r_[head, len(of)])
            keep = earlier == np.repeat(earlier[head], n_of)
            late = np.add.reduceat((~keep).astype(np.int64), head)
            for w in of[head[late > LEFT_OVER]]:
                a, b = np.searchsorted(word, [w, w + 1])
                if not known:
                    known = {
                        divmod(int(p), t.base): (int(r), int(m))
                        for p, r, m in zip(t.pairs, t.ranks, t.merged, strict=True)
                    }
                rest = scan(symbols[a:b].tolist(), int(rank[a:b].min()), known)
                symbols[a : a + len(rest)] = rest
                symbols[a + len(rest) : b] = -2
                keep &= of != w
                scanned = True
            chosen, new = chosen[keep], new[keep]
        symbols[chosen] = new
        stay = symbols != -2
        stay[chosen + 1] = False
        renewed = np.full(len(symbols), scanned)
        renewed[chosen] = True
        symbols, place, word, rank, into, renewed = (
            x[stay] for x in (symbols, place, word, rank, into, renewed)
        )
        renewed[:-1] |= renewed[1:]
        at = np.flatnonzero(renewed[:-1])
        rank[at], into[at] = pair_ranks(symbols[at], symbols[at + 1], t)
        rank[at[word[at] != word[at + 1]]] = NONE
        rank[-1] = NONE
    if not out:
        return symbols, place
    places, found_symbols = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(places, kind="stable")
    return found_symbols[order], places[order]


def encode_words(words: list[str], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, none of them empty, one after the other, and the number of ids
    of each; spaces are written as they are in pieces."""
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(w) for w in words])
    at, there = found(t.code_points, points)
    symbols = np.where(there, t.symbols[at], -1)
    # Characters that stand together in no piece are never merged: cut there too.
    apart = ~found(t.neighbours, points[:-1].astype(np.uint64) << np.uint64(32) | points[1:])[1]
    cuts = np.r_[True, apart]
    cuts[np.cumsum(lengths) - lengths] = True
    left, place = merge_rounds(symbols, np.flatnonzero(cuts), t)
    # Characters without a piece become their bytes.
    raw = (left < 0) | (left >= len(t.ends))
    spelled = [t.byte_ids[list(chr(p).encode())] for p in points[place[raw]]]
    n_out = np.ones(len(left), dtype=np.int64)
    n_out[raw] = [len(s) for s in spelled]
    ids = np.repeat(left, n_out)
    if spelled:
        ids[np.repeat(raw, n_out)] = np.concatenate(spelled)
    ends = np.r_[0, np.cumsum(n_out)][np.searchsorted(place, np.cumsum(lengths))]
    return ids, np.diff(ends, prepend=0)


class Slots(dict):
    """Numbers of words in the order of their first use; new ones are listed."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self.fresh.append(word)
        return slot


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def words_of(text: str) -> list[str]:
    """The words of a text, each without the space that every word begins with."""
    if "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ") if text else []


class Encoder:
    """Texts to ids; the ids of words are kept for the next texts, up to a bound."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)
        self.held = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their begin and end ids, one text after the other, and
        the number of ids of each."""
        t, slots = self.tables, self.slots
        if self.held > KEPT_IDS:
            self.clear()
            slots = self.slots
        words = [words_of(text) for text in texts]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        used = np.fromiter(map(slots.__getitem__, chain.from_iterable(words)), np.int64, n_words.sum())
        if slots.fresh:
            ids, sizes = encode_words([SPACE + w for w in slots.fresh], t)
            # A long word counts by its characters: they are held as well.
            self.held += sum(len(w) for w in slots.fresh)
            slots.fresh.clear()
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = ranges(self.starts[used], self.sizes[used])
        before = np.r_[0, np.cumsum(self.sizes[used])]
        last = np.cumsum(n_words)
        bare = before[last] - before[last - n_words]
        out = np.empty(len(at) + 2 * len(texts), dtype=np.int32)
        sizes = bare + 2
        first = np.cumsum(sizes) - sizes
        out[first], out[first + sizes - 1] = t.begin, t.end
        out[ranges(first + 1, bare)] = self.ids[at]
        return out, sizes


def decode_flat(ids: np.ndarray, sizes: np.ndarray, t: Tables) -> list[str]:
    """The texts of ids that lie one text after the other: control ids are left out,
    bytes are joined to characters, and the space put before a text is taken away."""
    plain = ~t.control[ids]
    kept = np.r_[0, np.cumsum(plain)]
    last = np.cumsum(sizes)
    n_plain = kept[last] - kept[last - sizes]
    ids = ids[plain]
    n_bytes = np.diff(t.ends, prepend=0)[ids]
    spelled = t.spelled[ranges(t.ends[ids] - n_bytes, n_bytes)].tobytes()
    ends = np.r_[0, np.cumsum(n_bytes)][np.r_[0, np.cumsum(n_plain)]]
    out = []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        own = spelled[a:b].decode("utf-8", errors="replace")
        first = int(kept[last[k] - sizes[k]])
        out.append(own[1:] if n_plain[k] and t.spaced[ids[first]] else own)
    return out


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in their order, a bounded number of characters at a time; null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row.

    ``ids`` are those of the whole text with begin and end ids, as the sentencepiece
    library gives them, stored as little-endian unsigned 32-bit integers (``id_array``
    unpacks them); ``decoded`` is the text that they decode to.  A null text counts as
    empty and gives the begin and end ids alone; its decoded text is empty.  Null and
    repeated ids are kept, one row out per row in.  Very long texts are encoded whole,
    in time in proportion to their length.  Other columns are not read; an empty table
    gives no rows.  No row is shuffled.  The model file is read on the driver; tables
    of the size of its vocabulary go to the tasks.
    """
    tables = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            first = 0
            for texts in chunks(batch.column("text")):
                ids, sizes = encoder.encode(texts)
                packed = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(sizes),
                        pa.array([packed[b - 4 * n : b] for b, n in zip(ends, sizes, strict=True)], type=pa.binary()),
                        pa.array(decode_flat(ids, sizes, tables.value), type=pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                first += len(texts)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def id_array(ids: Column) -> Column:
    """``ids`` as an array of integers."""

    @F.pandas_udf("array<int>")
    def unpack(values):
        return values.map(lambda x: np.frombuffer(x, dtype="<u4").astype(np.int32))

    return unpack(ids)
