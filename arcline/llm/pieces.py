"""Encoding and decoding with the vocabulary of a merge-type (BPE) SentencePiece model, by a table of last tokens.

The encoding of a text's prefix ends in exactly one token, and what stands before that token is the encoding of the shorter prefix.  So one
token a prefix is enough: an automaton gives the tokens that end at a place, and the one that is *compatible* with the last token of
the prefix before it is that place's last token.  Ids are then read off backwards.  This takes time in proportion to the text, however long
a run without spaces is.

Two neighbouring tokens are compatible if merging never joins across them.  While merges go by, from the best score down, the right edge of the
left token grows through its right spine and the left edge of the right token through its left spine; the pair fails if, while two of
these pieces face each other, the vocabulary merges them before either of them grows.

Where every token is space marks with letters alone, or with other characters alone, after them, merges never cross the edges of such runs, and
texts are cut there; equal words are encoded once a task, within a bound.  Short cuts that are new to a task are merged side by side: each round
makes the best merge of every cut, all rounds of numpy calls over what is left of them.
"""

from __future__ import annotations

import array
import codecs
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import INT, STRING, carried, list_array, read, struct

MARK = "▁"
#: A task remembers the ids of so many words and cuts of at most so many characters, of twice as many at times, and so many pairs of tokens.
REMEMBERED, SHORT, PAIRS = 1 << 17, 48, 1 << 19
#: Characters, or ids, of a text that are worked on at a time, characters of texts whose words are looked up together, and cuts that merge side by side.
RUN, TOGETHER, ABREAST = 1 << 18, 1 << 20, 1 << 15
NEVER = 1 << 62

codecs.register_error("arcline.each", lambda e: ("�", e.start + 1))


def merged(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short text, always the best pair and the leftmost of several: what is left, and the last two that were merged."""
    out, last = list(text), None
    while len(out) > 1:
        best = min(range(len(out) - 1), key=lambda i: rank.get(out[i] + out[i + 1], NEVER))
        if out[best] + out[best + 1] not in rank:
            break
        last = out[best], out[best + 1]
        out[best : best + 2] = ["".join(last)]
    return out, last


class Pieces:
    """The tokens of a model: spines, pairs, and the bytes that each id stands for.  Of the vocabulary's size, and sent to tasks whole."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        library = self.library()
        n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        values = {i: int(names[i][1:-1], 16) for i in range(n) if library.is_byte(i)}
        self.byte = [i for i, _ in sorted(values.items(), key=lambda x: x[1])]
        if len(self.byte) != 256 or any(library.is_unused(i) for i in range(n)):
            raise ValueError("a model has to have a token for each byte and no unused ones")
        if library.normalize("  a  b ").lstrip(MARK) != f"a{MARK}{MARK}b{MARK}":
            raise ValueError("a model has to keep spaces")
        self.dummy, self.end = library.normalize("a").startswith(MARK), library.eos_id()
        ids = {names[i]: i for i in range(n) if i not in values and not library.is_control(i) and not library.is_unknown(i)}
        self._merges(ids, {name: library.get_score(i) for name, i in ids.items()})
        self.pattern, self.runs = _pattern(ids), not any(MARK in name.lstrip(MARK) for name in ids)
        surface = [b"" if library.is_control(i) else bytes([values[i]]) if i in values else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        for i in (i for i in range(n) if library.is_unknown(i)):
            surface[i] = library.decode([i]).encode()
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([name in ids and name.startswith(MARK) for name in names])

    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def _merges(self, ids: dict[str, int], scores: dict[str, float]) -> None:
        """Which two tokens each is merged from, last; tokens that merging doesn't give are left out, characters without an id are put in."""
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {name: order[s] for name, s in scores.items() if len(name) > 1}
        tied: dict[int, list[str]] = {}
        for name, r in rank.items():
            tied.setdefault(r, []).append(name)
        if any(len(names) > 1 and len(set("".join(names))) > 1 for names in tied.values()):
            raise ValueError("tokens of equal score have to be runs of one character")
        parts = {}
        for name in rank:
            left, last = merged(name, rank)
            if left == [name]:
                if max(rank.get(x, -1) for x in last) > rank[name]:
                    raise ValueError("a token's score has to be below those of its parts")
                parts[name] = last
        self.names = sorted({c for name in ids for c in name}) + sorted(parts, key=len)
        at = {name: k for k, name in enumerate(self.names)}
        self.ids = [ids.get(name, -1) for name in self.names]
        self.joins = {at[a] * len(at) + at[b]: rank[name] for name, (a, b) in parts.items()}
        split = [(at[name[:i]], at[name[i:]], at[name], rank[name]) for name in parts for i in range(1, len(name)) if name[:i] in at and name[i:] in at]
        #: Every two tokens that make up a third, that one, and its rank.
        self.pairs = tuple(np.array(split, np.int32).reshape(-1, 4).T.copy())
        self.right: list[list[tuple[int, int]]] = []
        self.left: list[list[tuple[int, int]]] = []
        for k, name in enumerate(self.names):
            for spines, side in ((self.right, 1), (self.left, 0)):
                inner = spines[at[parts[name][side]]] if name in parts else []
                spines.append([*inner[:-1], (inner[-1][0], rank[name]), (k, NEVER)] if inner else [(k, NEVER)])


class _Known:
    """What ``make`` gives for many keys at once.  When it is full it becomes the older half, from which what is met again comes back."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.make, self.newer, self.older, self.long = make, {}, {}, []

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A dictionary that has all ``keys``, until the next call."""
        for key in self.long:
            del self.newer[key]
        if len(self.newer) >= REMEMBERED:
            self.newer, self.older = {}, self.newer
        missing = keys - self.newer.keys()
        again = missing & self.older.keys()
        self.newer.update((key, self.older[key]) for key in again)
        fresh = list(missing - again)
        self.newer.update(zip(fresh, self.make(fresh), strict=True))
        self.long = [key for key in fresh if len(key) > SHORT]
        return self.newer


class Merges:
    """Merging of many short cuts side by side, always the best pair of each and the leftmost of several."""

    NONE = 1 << 30

    def __init__(self, pieces: Pieces) -> None:
        self.base = len(pieces.names) + 1
        self.ids = np.array([*pieces.ids, -1], np.int32)
        self.symbol = np.full(0x110000, self.base - 1, np.int32)  # characters that no token has never merge
        for k, name in enumerate(pieces.names):
            if len(name) == 1:
                self.symbol[ord(name)] = k
        a, b, name, rank = pieces.pairs
        keys = a.astype(np.int64) * self.base + b
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        at, left = self._hash(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free]
            left = left[self.slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.rank, self.name = np.full(len(self.slots), self.NONE, np.int64), np.zeros(len(self.slots), np.int32)
        self.rank[at], self.name[at] = rank, name

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table, or an empty place."""
        keys = a.astype(np.int64) * self.base + b
        at = self._hash(keys)
        there = self.slots[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            there = self.slots[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return at

    def merged(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``cuts``, none of them empty, one after another, and how many each has; -1 for a character without an id."""
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        symbols = self.symbol[np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(cuts)), counts)
        slot = np.append(self._slot(symbols[:-1], symbols[1:]), 0)
        rank = self.rank[slot]
        rank[np.cumsum(counts) - 1] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            open_ = best < self.NONE << 32
            at = best[open_] & 0xFFFFFFFF
            symbols[at] = self.name[slot[at]]
            keep = np.repeat(open_, np.diff(np.append(starts, len(symbols))))
            if not open_.all():
                done.append((owner[~keep], symbols[~keep]))
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, owner, slot, rank = symbols[keep], owner[keep], slot[keep], rank[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            slot[touched] = self._slot(symbols[touched], symbols[touched + 1])
            rank[touched] = self.rank[slot[touched]]
            rank[np.append(owner[1:] != owner[:-1], True)[: len(rank)]] = self.NONE  # the last of a cut has no pair
        owners, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return self.ids[found[order]], np.bincount(owners, minlength=len(cuts))


class Encoder:
    """A task's working state: the automaton and what is remembered of cuts and pairs."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.library = pieces, pieces.library()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(pieces.names):
            self.automaton.add_word(name, k)
        self.automaton.make_automaton()
        self.length = [len(name) for name in pieces.names]
        self.pairs: dict[int, bool] = {}
        self.merges = Merges(pieces)
        self.cuts, self.words = _Known(self.of_cuts), _Known(self.of_words)

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge joins the edges of two tokens while they grow.  Of merges of one rank the leftmost comes first."""
        right, left, n, i, j = self.pieces.right[a], self.pieces.left[b], len(self.length), 0, 0
        while True:
            (r, r_grows), (l, l_grows) = right[i], left[j]
            joined = self.pieces.joins.get(r * n + l, NEVER)
            if joined < r_grows and joined <= l_grows:
                return False
            if r_grows == l_grows == NEVER:
                return True
            if r_grows <= l_grows:
                i += 1
            else:
                j += 1

    def cut(self, text: str) -> list[int]:
        """The ids of a normalised text, or of a cut of one."""
        last, length, pairs, n = [-1] * len(text), self.length, self.pairs, len(self.length)
        for at, token in self.automaton.iter(text):
            if last[at] < 0:
                before = at - length[token]
                if before < 0 or (left := last[before]) < 0:
                    last[at] = token
                    continue
                fits = pairs.get(left * n + token)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[left * n + token] = self.compatible(left, token)
                if fits:
                    last[at] = token
        out: list[int] = []
        ids, at = self.pieces.ids, len(text) - 1
        while at >= 0:  # backwards
            token = last[at]
            if token >= 0 and ids[token] >= 0:
                out.append(ids[token])
                at -= length[token]
            else:
                out += [self.pieces.byte[b] for b in reversed(text[at].encode())]
                at -= 1
        out.reverse()
        return out

    def of_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut as 32-bit numbers: short ones side by side, long ones and those with characters to spell in bytes by themselves."""
        out: list[bytes | None] = [None] * len(cuts)
        short = [k for k, cut in enumerate(cuts) if len(cut) <= SHORT]
        for b in range(0, len(short), ABREAST):
            some = short[b : b + ABREAST]
            ids, counts = self.merges.merged([cuts[k] for k in some])
            ends = np.cumsum(counts)
            spelt = set(np.searchsorted(ends, np.flatnonzero(ids < 0), "right").tolist())
            data, begin = ids.tobytes(), 0
            for i, (k, end) in enumerate(zip(some, (4 * ends).tolist(), strict=True)):
                if i not in spelt:
                    out[k] = data[begin:end]
                begin = end
        return [array.array("i", self.cut(cut)).tobytes() if found is None else found for cut, found in zip(cuts, out, strict=True)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a mark before it; words have no marks, and one may be empty."""
        if "" in words:
            k = words.index("")
            return [*self.of_words(words[:k]), *self.of_cuts([MARK]), *self.of_words(words[k + 1 :])]
        if not words:
            return []
        cuts = self.pieces.pattern.findall(MARK + MARK.join(words))
        starts = [k for k, cut in enumerate(cuts) if cut[0] == MARK]
        distinct = list(dict.fromkeys(cuts))
        known = dict(zip(distinct, self.of_cuts(distinct), strict=True))
        parts = [known[cut] for cut in cuts]
        return [parts[b] if e - b == 1 else b"".join(parts[b:e]) for b, e in zip(starts, [*starts[1:], len(cuts)], strict=True)]

    def text(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit numbers."""
        return self.texts([text])[0]

    def texts(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each whole text as 32-bit numbers; words and cuts that are new are worked out together."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, _Known, list[str]]] = []

        def settle() -> None:
            known = {memory: memory.of(set().union(*(keys for _, m, keys in waiting if m is memory))) for memory in (self.cuts, self.words)}
            for k, memory, keys in waiting:
                out[k].append(b"".join(map(known[memory].__getitem__, keys)))
            waiting.clear()

        held = 0
        for text in texts:
            out.append([])
            normal = self.library.normalize(text)
            for run in _runs(normal) if self.pieces.runs else [normal]:
                plain = self.pieces.runs and run.startswith(MARK) and MARK * 2 not in run
                waiting.append((len(out) - 1, *((self.words, run[1:].split(MARK)) if plain else (self.cuts, self.pieces.pattern.findall(run)))))
                held += len(run)
                if held > TOGETHER:
                    settle()
                    held = 0
        settle()
        return [b"".join(x) for x in out]


EDGE = re.compile(f"[^{MARK}](?={MARK})")


def _pattern(names: Iterable[str]) -> re.Pattern:
    """The finest of three ways to cut a text that leaves each token in one cut: marks with the letters, or with what else is, after them;
    marks with all after them; whole texts."""
    letter = re.compile(r"[^\W\d_]")
    kinds = lambda name: {bool(letter.match(c)) for c in name.lstrip(MARK)}
    mixed = "".join(sorted({c for name in names if len(kinds(name)) > 1 for c in name if letter.match(c)}))
    one, other = (rf"[^\W\d_{mixed}]", rf"[^\w{MARK}]|[\d_{mixed}]")
    for pattern in (rf"{MARK}*(?:{one})+|{MARK}*(?:{other})+|{MARK}+", f"{MARK}*[^{MARK}]+|{MARK}+"):
        if all(re.fullmatch(pattern, name) for name in names):
            return re.compile(pattern)
    return re.compile("(?s:.+)")


def _runs(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > RUN:
        edge = EDGE.search(text, begin + RUN)
        if not edge:
            break
        yield text[begin : edge.end()]
        begin = edge.end()
    yield text[begin:]


def load(path: str) -> Pieces:
    """The model file at ``path``, which the driver reads; tasks get what was made of it."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def _fresh(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    return name + "_" * max([0, *(len(c) for c in columns)])


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", ids: str = "ids", end: bool = True, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``ids`` array<int>: what the library's encode gives for each whole text, and the end id if ``end``.

    Null texts count as empty; an empty text has the end id alone, or none.  Bytes that aren't UTF-8 count as U+FFFD.  Rows stay apart, repeated
    ones and very long texts too; a column named as ``ids`` is replaced.  An empty table gives no rows.
    """
    kept, schema = carried(docs, struct(**{ids: T.ArrayType(INT)}), columns)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        stop = np.array([shared.value.end], np.int32).tobytes() if end else b""
        for batch in batches:
            texts, held, lo = [], 0, 0
            column = batch.column(0).cast(pa.large_binary())
            for k in range(batch.num_rows):
                texts.append((column[k].as_py() or b"").decode("utf-8", "replace"))
                held += len(texts[-1])
                if held > TOGETHER or k == batch.num_rows - 1:
                    out = [x + stop for x in encoder.texts(texts)]
                    counts = np.array([len(x) // 4 for x in out])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(lo, len(out)) for i in range(len(kept))), list_array(pa.array(np.frombuffer(b"".join(out), np.int32)), counts)], names=schema.fieldNames())
                    texts, held, lo = [], 0, k + 1

    return docs.select(F.col(text).alias(_fresh("_text", kept)), *kept).mapInArrow(run, schema)


def text_of(pieces: Pieces, ids: np.ndarray) -> str:
    """What the library's decode gives.  Ids that the vocabulary doesn't have stand for nothing."""
    ids = ids[(ids >= 0) & (ids < len(pieces.sizes))]
    out = []
    for b in range(0, len(ids), RUN):
        run = ids[b : b + RUN]
        sizes = pieces.sizes[run]
        ends = np.cumsum(sizes)
        out.append(pieces.surface[np.repeat(pieces.offsets[run] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
    said = np.flatnonzero(pieces.sizes[ids[:RUN]])
    data = b"".join(out)
    if pieces.dummy and len(said) and pieces.marked[ids[said[0]]]:
        data = data[1:]
    return data.decode("utf-8", "arcline.each")


def decode(rows: DataFrame, pieces: Pieces, *, ids: str = "ids", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``rows`` (or ``columns`` of it) with ``text``, the text that ``ids`` array<int> stand for; null ids give null.

    A column named as ``text`` is replaced.  Null elements and ids beyond the vocabulary stand for nothing.  An empty table gives no rows.
    """
    kept, schema = carried(rows, struct(**{text: STRING}), columns)
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0)
            texts = [text_of(shared.value, pc.fill_null(x.values, -1).to_numpy(zero_copy_only=False)) if x.is_valid else None for x in held]
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(kept))), pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.select(F.col(ids).alias(_fresh("_ids", kept)), *kept).mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode(read(spark, sf_dir, "documents"), pieces, columns=["doc_id"])
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    hashed = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), "ids")
    return decode(hashed, pieces, columns=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", sha(F.col("text")).alias("decoded_sha256"))
