"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A rank table fixes one token sequence for every byte string, and a sequence is that one exactly
when each pair of neighbours, merged alone, stays as it is. So a nondeterministic transducer that
guesses token ends and checks neighbours reads any piece. It is determinised while it reads:
a state is the set of live guesses with what each has yet to emit, and what all guesses agree on
is emitted at once, so the lookahead is at most the longest token.

Defined cases: a null or empty text gives no tokens; every row is encoded, repeated ones alike; a
null doc_id stays null; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import packed_arcs, pieces, worker_tables

#: states kept by a transducer; contexts met later are read without making states
MOST_STATES = 30_000
#: places for remembered checks of neighbours, 8 bytes each; a later check takes an earlier one's place
PAIRS = 1 << 19
#: words whose result is remembered (the ones met first, so nearly all frequent ones)
MOST_WORDS = 150_000
#: longer pieces are read alone, not side by side
LONGEST_PIECE = 64
#: longer pieces are read byte by byte each time
LONGEST_WORD = 48


#: guesses above at most this many tokens are dropped once none of those can follow
FEW = 12
#: bytes of text encoded at once; a longer text is encoded alone
PIECE = 1_000_000
#: code points of a long text that are cut into words at once
BLOCK = 1 << 18
#: white space followed by a space: such a text is cut by the pattern alone
RUN = re.compile(r"\s ")
#: above every rank
UNKNOWN = 1 << 60


class Remembered:
    """Yes or no per pair of numbers in a flat table of fixed size: a pair stands in the place that its hash names."""

    __slots__ = ("cells", "flat")

    def __init__(self) -> None:
        self.cells = array("q", [-1]) * PAIRS
        self.flat = np.frombuffer(self.cells, np.int64)

    def get(self, a: int, b: int) -> bool | None:
        pair = (a + 1) << 24 | b
        cell = self.cells[(pair * 0x9E3779B1 >> 12) & (PAIRS - 1)]
        return bool(cell & 1) if cell >> 1 == pair else None

    def put(self, a: int, b: int, yes: bool) -> bool:
        pair = (a + 1) << 24 | b
        self.cells[(pair * 0x9E3779B1 >> 12) & (PAIRS - 1)] = pair << 1 | yes
        return yes


class State:
    """Live guesses: (token before, node in the token tree, tokens not yet emitted)."""

    __slots__ = ("final", "guesses", "next")

    def __init__(self, guesses: tuple, final: tuple | None):
        self.guesses, self.final, self.next = guesses, final, {}


class Transducer:
    """Compiled from ranks; ``encode`` reads one piece of pre-split text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.fits, self.hopes = Remembered(), Remembered()
        self.edges: dict[tuple[int, bool], list | None] = {}
        children: list[dict[int, int]] = [{}]
        token = array("i", [-1])
        for word, rank in ranks.items():
            node = 0
            for b in word:
                to = children[node].get(b)
                if to is None:
                    to = children[node][b] = len(children)
                    children.append({})
                    token.append(-1)
                node = to
            token[node] = rank
        # the token tree in flat arrays, each twice: read one by one, and side by side
        base, cells = packed_arcs(children, 256)
        self.token, self.base, self.cells = token, array("q", base.tobytes()), array("q", cells.tobytes())
        self.flat = np.frombuffer(token, np.int32), np.frombuffer(self.base, np.int64), np.frombuffer(self.cells, np.int64)
        self.below: list[tuple | None] = self.few_below(children)
        # every two tokens whose bytes together are a token, with its rank; edges of tokens met so far
        pairs = sorted((ranks[t[:i]] << 24 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.joined = np.array([p for p, _ in pairs] or [-1], np.int64), np.array([r for _, r in pairs] or [UNKNOWN], np.int64)
        self.rows = [self.no_edges() for _ in (False, True)]
        self.states: dict[tuple, State] = {}
        self.start = self.state(((-1, 0, ()),))

    def no_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row per token, parts, ranks): row 0 is the start of a piece, -1, which has no parts and forbids nothing."""
        rows, parts, until = np.full(max(self.ranks.values()) + 2, -1, np.int32), np.full((256, 4), -1), np.full((256, 4), -1)
        rows[-1], until[0, 0] = 0, UNKNOWN
        return rows, parts, until

    def child(self, node: int, byte: int) -> int:
        cell = self.cells[self.base[node] + byte]
        return cell & 0xFFFFFFFF if cell >> 32 == node else -1

    def few_below(self, children: list[dict[int, int]]) -> list[tuple | None]:
        """Tokens strictly below each node of the tree, None where they are more than ``FEW``."""
        below: list[tuple | None] = [()] * len(children)
        for node in range(len(children) - 1, -1, -1):
            found: tuple | None = ()
            for to in children[node].values():
                deeper = below[to]
                if found is not None and deeper is not None:
                    found += deeper if self.token[to] < 0 else (self.token[to], *deeper)
                    found = found if len(found) <= FEW else None
                else:
                    found = None
            below[node] = found
        return below

    def hope(self, before: int, node: int) -> bool:
        """Whether a guess that stands inside a token may still end in one that fits."""
        below = self.below[node]
        if below is None:
            return True
        known = self.hopes.get(before, node)
        return self.hopes.put(before, node, any(self.fit(before, token) for token in below)) if known is None else known

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge inside a token; None if the merges don't give the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, UNKNOWN), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == UNKNOWN:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[-1])

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """What stands at one edge of a token while it is built, each with the rank that replaces it."""
        known = self.edges.get((token, right), 0)
        if known == 0:
            part, until, known = self.bytes[token], UNKNOWN, []
            while known is not None:
                known.append((part, until))
                if len(part) == 1:
                    break
                two = self.halves(part)
                if two is None:
                    known = None
                else:
                    part, until = two[right], self.ranks[part]
            self.edges[token, right] = known
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens may stand next to each other; a = -1 is the start of a piece.

        They may not if, while both are built, some pair across the border has a rank below those
        that replace its halves (at equal ranks the pair further left is joined first).
        """
        known = self.fits.get(a, b)
        if known is None:
            first = self.edge(b, False)
            last = [] if a < 0 else self.edge(a, True)
            known = first is not None and last is not None
            for x, x_until in (last or ()) if known else ():
                for y, y_until in first:
                    rank = self.ranks.get(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
                        break
                if not known:
                    break
            self.fits.put(a, b, known)
        return known

    def state(self, guesses: tuple) -> State:
        known = self.states.get(guesses)
        if known is None:
            ended = [out for _, node, out in guesses if node == 0]
            known = self.states[guesses] = State(guesses, ended[0] if ended else None)
        return known

    def step(self, state: State, byte: int) -> tuple[tuple, State]:
        """Advance all guesses by a byte and emit what they agree on."""
        live = []
        for before, node, out in state.guesses:
            to = self.child(node, byte)
            if to >= 0:
                token = self.token[to]
                if self.hope(before, to):
                    live.append((before, to, out))
                if token >= 0 and self.fit(before, token):
                    live.append((token, 0, (*out, token)))
        if not live:
            raise ValueError("a byte that is no token")
        agreed = live[0][2]
        for _, _, out in live[1:]:
            n = 0
            while n < len(agreed) and n < len(out) and agreed[n] == out[n]:
                n += 1
            agreed = agreed[:n]
        n = len(agreed)
        arc = agreed, self.state(tuple(sorted((before, node, out[n:]) for before, node, out in live)))
        state.next[byte] = arc
        return arc

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece. Where a context is not kept as a state, the same transducer is read without making states."""
        known: list = list(map(self.by_states, pieces))
        rare = [k for k, ids in enumerate(known) if ids is None]
        short = [k for k in rare if len(pieces[k]) <= LONGEST_PIECE]
        for k, ids in zip(short, self.side_by_side([pieces[k] for k in short])):
            known[k] = ids
        return [self.walk(piece) if ids is None else ids for piece, ids in zip(pieces, known)]

    def by_states(self, piece: bytes) -> list[int] | None:
        """The determinised transducer, a new arc at a time; None if it would need more states than are kept."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids = self.start, []
        for byte in piece:
            arc = state.next.get(byte)
            if arc is None:
                if len(self.states) >= MOST_STATES:
                    return None
                arc = self.step(state, byte)
            emitted, state = arc
            if emitted:
                ids += emitted
        ids += state.final
        return ids

    def walk(self, piece: bytes) -> list[int]:
        """Read without states, one piece: of the guesses that end at a byte, one alone fits what is before it."""
        ends, begins, live = [-1], [0], [(-1, 0, 0)]
        for i, byte in enumerate(piece, 1):
            onward, found, begun = [], -1, -1
            for before, begin, node in live:
                to = self.child(node, byte)
                if to >= 0:
                    if self.hope(before, to):
                        onward.append((before, begin, to))
                    token = self.token[to]
                    if token >= 0 and found < 0 and self.fit(before, token):
                        found, begun = token, begin
            ends.append(found)
            begins.append(begun)
            if found >= 0:
                onward.append((found, i, 0))
            live = onward
        return _back(ends, begins, len(piece))

    def side_by_side(self, pieces: list[bytes]) -> list[list[int]]:
        """Read without states, many short pieces a byte at a time: a guess is a piece, where its token begins, and a node."""
        if not pieces:
            return []
        token, base, cells = self.flat
        size = np.array([len(p) for p in pieces])
        longest = int(size.max())
        data = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(len(pieces), longest)
        ends, begins = np.full((len(pieces), longest + 1), -1, np.int32), np.zeros((len(pieces), longest + 1), np.int16)
        piece, begin, node = np.arange(len(pieces)), np.zeros(len(pieces), np.int16), np.zeros(len(pieces), np.int64)
        for i in range(longest):
            cell = cells[base[node] + data[piece, i]]
            on = (cell >> 32 == node) & (size[piece] > i)
            piece, begin, node = piece[on], begin[on], cell[on] & 0xFFFFFFFF
            found = token[node]
            at = np.flatnonzero(found >= 0)
            at = at[self.fit_all(ends[piece[at], begin[at]], found[at])]
            ends[piece[at], i + 1], begins[piece[at], i + 1] = found[at], begin[at]
            piece = np.concatenate([piece, piece[at]])
            begin, node = np.concatenate([begin, np.full(len(at), i + 1, np.int16)]), np.concatenate([node, np.zeros(len(at), np.int64)])
        return [_back(e, b, n) for e, b, n in zip(ends.tolist(), begins.tolist(), size.tolist())]

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs: remembered ones side by side, each new one once."""
        pair = (a.astype(np.int64) + 1) << 24 | b
        cell = self.fits.flat[(pair * 0x9E3779B1 >> 12) & (PAIRS - 1)]
        yes = (cell & 1).astype(bool)
        new = np.flatnonzero(cell >> 1 != pair)
        if len(new):
            one, of = np.unique(pair[new], return_inverse=True)
            fits = self.fit_new((one >> 24) - 1, one & 0xFFFFFF)
            self.fits.flat[(one * 0x9E3779B1 >> 12) & (PAIRS - 1)] = one << 1 | fits
            yes[new] = fits[of]
        return yes

    def fit_new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fit`` of different pairs side by side, from the edges of their tokens as rows of numbers."""
        last, first = self.edges_of(a, True), self.edges_of(b, False)
        good = (last[1][:, 0] >= 0) & (first[1][:, 0] >= 0)
        for i in range(last[0].shape[1]):
            for j in range(first[0].shape[1]):
                at = np.flatnonzero(good & (last[0][:, i] >= 0) & (first[0][:, j] >= 0))
                if not len(at):
                    break
                key = last[0][at, i].astype(np.int64) << 24 | first[0][at, j]
                spot = np.minimum(np.searchsorted(self.joined[0], key), len(self.joined[0]) - 1)
                rank = np.where(self.joined[0][spot] == key, self.joined[1][spot], UNKNOWN)
                good[at[(rank < last[1][at, i]) & (rank <= first[1][at, j])]] = False
        return good

    def edges_of(self, tokens: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(parts, the ranks that replace them) of each token at one edge; parts end with -1, and a token
        that its merges don't give has rank -1. The start of a piece (-1) has no parts."""
        rows, parts, until = self.rows[right]
        used = int(rows.max()) + 1
        for token in np.unique(tokens[rows[tokens] < 0]).tolist():
            known = self.edge(token, right) or []
            width = max(parts.shape[1], len(known) + 1)
            if used == len(parts) or width > parts.shape[1]:
                grown = ((0, len(parts) * (used == len(parts))), (0, width - parts.shape[1]))
                parts, until = np.pad(parts, grown, constant_values=-1), np.pad(until, grown, constant_values=-1)
            parts[used, : len(known)], until[used, : len(known)] = [self.ranks[p] for p, _ in known], [r for _, r in known]
            rows[token], used = used, used + 1
        self.rows[right] = rows, parts, until
        return parts[rows[tokens]], until[rows[tokens]]


def _back(ends: list[int], begins: list[int], at: int) -> list[int]:
    """Token ids from the end of a piece to its start, put in order."""
    ids = []
    while at:
        ids.append(ends[at])
        at = begins[at]
    return ids[::-1]


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cut and returns the text that is complete so far.

    The state is the unfinished sequence at the end, at most three bytes. ``close`` says whether
    the stream ended between characters.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if needs > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self.unfinished(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8")

    def close(self) -> bool:
        return not self.rest


class Words(dict):
    """What stands between two single spaces -> the ids of it and of the space in front, as text.

    ``read`` takes the texts of one batch: what is not remembered is encoded once for all of them.
    """

    def __init__(self, split: Callable[[str], list[str]], transducer: Transducer):
        super().__init__()
        self.split, self.transducer = split, transducer
        self.names = [str(i) for i in range(max(transducer.bytes) + 1)]
        #: ids of pieces, and of words that are not remembered, of this batch
        self.pieces: dict[str, str] = {}
        self.rare: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        return self.rare[word]

    def learn(self, words: set[str], pieces: set[str]) -> None:
        """Encode words and pieces that are not known yet."""
        parts = dict(self.parted(words))
        pieces = list(pieces.union(*parts.values()))
        ids = self.transducer.encode_all([p.encode("utf-8") for p in pieces])
        name = self.names.__getitem__
        self.pieces = {p: " ".join(map(name, i)) for p, i in zip(pieces, ids)}
        for word, of in parts.items():
            known = self.pieces[of[0]] if len(of) == 1 else " ".join(map(self.pieces.__getitem__, of))
            if len(word) <= LONGEST_WORD and len(self) < MOST_WORDS:
                self[word] = known
            else:
                self.rare[word] = known

    def parted(self, words: set[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of every word behind a space: words without white space are split in one pass, cut where a piece has a space."""
        plain = [word for word in words if word.split() == [word]]
        of: list[str] = []
        at = -1
        for piece in self.split(" ".join(["", *plain])):
            if piece[0] == " ":
                if of:
                    yield plain[at], of
                at, of = at + 1, []
            of.append(piece)
        if of:
            yield plain[at], of
        for word in words.difference(plain):
            yield word, self.split(" " + word)

    def blocks(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """(pieces, words) of a text, cut in blocks. A piece has a space only at its start or in a run
        of white space, so every single space after other text begins a new piece, and texts can be cut there."""
        if not text or RUN.search(text):
            yield self.split(text), []
            return
        at = 0
        while at >= 0:
            cut = text.find(" ", at + BLOCK)
            words = text[at : cut if cut >= 0 else len(text)].split(" ")
            yield ([], words) if at else (self.split(words[0]), words[1:])
            at = cut + 1 if cut >= 0 else -1

    def read(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        for group in _groups(texts):
            pieces, words = set(), set()
            for text in group:
                for some, more in self.blocks(text):
                    pieces.update(some)
                    words.update(more)
            self.learn(words - self.keys(), pieces)
            for text in group:
                ids: list[str] = []
                for some, more in self.blocks(text):
                    ids += map(self.pieces.__getitem__, some)
                    ids += map(self.__getitem__, more)
                out.append(" ".join(ids))
            self.pieces, self.rare = {}, {}
        return out

    def encode(self, text: str) -> str:
        return self.read([text])[0]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``PIECE`` code points together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _compiled(data: bytes, pattern: str) -> tuple:
    """One compiled transducer per worker process and vocabulary, whatever the number of tasks."""
    import regex

    def make() -> tuple:
        transducer = Transducer(read_ranks(data))
        tokens = pa.array([transducer.bytes.get(i, b"") for i in range(max(transducer.bytes) + 1)], pa.binary())
        return Words(regex.compile(pattern).findall, transducer), tokens

    return worker_tables("bpe", (hashlib.sha256(data).hexdigest(), pattern), make)


def token_bytes(ids: pa.Array, tokens: pa.Array) -> list[memoryview]:
    """The bytes that each row's space-joined ids stand for."""
    lists = pc.split_pattern(ids, " ")
    numbers = lists.flatten()
    blank = pc.equal(numbers, "")
    numbers = pc.cast(pc.if_else(blank, None, numbers), pa.int32())
    data = tokens.take(numbers)
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset :][: len(data) + 1]
    rows = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    cuts = ends[rows].tolist()
    whole = memoryview(data.buffers()[2] or b"")
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def streamed(data: memoryview, chunk: int = 1 << 16) -> Iterator[str]:
    """Text of token bytes, chunk by chunk."""
    stream = Utf8Stream()
    for at in range(0, len(data), chunk):
        yield stream.feed(bytes(data[at : at + chunk]))
    if not stream.close():
        raise ValueError("the ids end inside a character")


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text and their decoding back: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    ``vocabulary`` is the path of a rank file on the driver (its size is that of the vocabulary,
    about 1 MB); tasks get its bytes once. ``keep_ids`` adds the ids as an array.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * keep_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens = _compiled(shared.value, pattern)
        for batch in pieces(batches, "text", PIECE):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = words.read(texts)
            out: list[tuple] = []
            for text, row, data in zip(texts, ids, token_bytes(pa.array(ids, pa.string()), tokens)):
                same, at, decoded = True, 0, hashlib.sha256()
                for part in streamed(data):
                    decoded.update(part.encode())
                    same, at = same and text.startswith(part, at), at + len(part)
                sha = hashlib.sha256(row.encode()).hexdigest()
                one = (row.count(" ") + 1 if row else 0, sha, decoded.hexdigest(), same and at == len(text))
                out.append((*one, [int(x) for x in row.split()]) if keep_ids else one)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
