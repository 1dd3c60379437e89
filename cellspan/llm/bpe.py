"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

Each pre-token is encoded by a finite-state transducer that reads one byte at a time. Two facts of BPE vocabularies in
which every token encodes to itself make it finite: a token sequence is the encoding of its bytes iff every adjacent
pair is the encoding of its own bytes, and each prefix of a text has exactly one encoding. A state is a node of the trie
of tokens (the longest suffix read that still begins some token), with the last id before each place where such a suffix
starts; it fixes the token that ends at the byte just read. A state is made when a move comes to it for the second time;
until then the nodes of the trie alone are followed. A token is emitted once all encodings that can still go on agree
on it: at the end of a piece, or within long pieces after each block. The short pieces of some texts that a worker does
not remember go through it side by side (``transduce.py``).
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .transduce import SideBySide

#: Pieces in a worker's table. A full table becomes the old one, from which the new one takes over what is used again:
#: so memory is bounded and what is frequent stays.
REMEMBERED = 100_000

#: Characters of texts whose pieces are encoded together, and the least number of pieces that go side by side.
TOGETHER, FEW = 1 << 20, 48

#: Moves, jumps and tested pairs of the transducer: each table starts anew when it is full.
MOVES, JUMPS, PAIRS = 100_000, 50_000, 200_000

#: Bytes of ids after which a worker hands its rows on, and of the batches of texts that it is given.
FLUSH, BATCH = 2 << 20, 8 << 20

#: White space as the tokenizer library's engine has it (Unicode White_Space), for engines that have it otherwise.
WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encoder of pre-tokens. ``encode(piece)`` gives the ids that merging by rank gives.

    All tables are flat: arrays by token or by node, and dictionaries from whole numbers to whole numbers.
    """

    def __init__(self, ranks: dict[bytes, int], moves: int = MOVES):
        self.ranks, self.most = ranks, moves
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size  # what the last merge of a token joins
        self.whole = {t for t in ranks if len(t) > 1 and not self._split(t)}  # no merge makes them: whole pieces only
        self._trie()
        self.jumps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self._renew()
        self.side_by_side: SideBySide | None = None

    def _split(self, token: bytes) -> bool:
        """Note the halves of the last merge that makes ``token``; false if merging by rank does not make it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        r = self.ranks[token]
        self.left[r], self.right[r] = self.ranks.get(parts[0], -1), self.ranks.get(parts[1], -1)
        return self.left[r] >= 0 and self.right[r] >= 0

    def _trie(self):
        """Nodes for all beginnings of tokens: ``child``, the ``depth`` of each, the node of its longest proper suffix
        (``suffix``), and the nearest node on that chain, itself included, that is a token (``ends_here``)."""
        self.child: dict[int, int] = {}
        self.depth, self.of_token = array("i", [0]), array("i", [-1])
        for t, r in self.ranks.items():
            if t in self.whole:
                continue
            node = 0
            for byte in t:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.of_token.append(-1)
                node = to
            self.of_token[node] = r
        n = len(self.depth)
        self.suffix, self.ends_here = array("i", [0]) * n, array("i", [0]) * n
        for key, node in sorted(self.child.items(), key=lambda kv: self.depth[kv[1]]):
            up, byte = key >> 8, key & 255
            if up:
                s = self.suffix[up]
                while s and (s << 8 | byte) not in self.child:
                    s = self.suffix[s]
                self.suffix[node] = self.child.get(s << 8 | byte, 0)
            self.ends_here[node] = node if self.of_token[node] >= 0 else self.ends_here[self.suffix[node]]

    def _renew(self):
        """Start new tables of states and moves."""
        self.states: dict[tuple, int] = {}
        self.node, self.last = array("i"), array("i")  # of each state: its node, and the id that ends there
        self.moves: dict[int, int] = {}  # state and byte to state; -1: came by once
        self._state(0, [-1])

    def _state(self, node: int, ends: list[int]) -> int:
        """The state of ``node`` after the bytes of ``ends``."""
        n, key, s = len(ends) - 1, [node], node
        while s:
            key.append(ends[n - self.depth[s]])
            s = self.suffix[s]
        key = (*key, ends[n])
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = len(self.node)
            self.node.append(node)
            self.last.append(ends[n])
        return state

    def _jump(self, node: int, byte: int) -> int:
        """The node of the longest suffix that still begins a token, where ``node`` itself has no such child."""
        s = node
        while s and (s << 8 | byte) not in self.child:
            s = self.suffix[s]
        to = self.child.get(s << 8 | byte, 0)
        if len(self.jumps) >= JUMPS:
            self.jumps.clear()
        self.jumps[node << 8 | byte] = to
        return to

    def _fits(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``: merging their bytes together never joins across the boundary.

        Undoes the merges of both in reverse order. While ``x`` and ``y`` touch at the boundary, the next merge that
        changes one of them has rank ``until``; a merge of ``x`` with ``y`` that comes before it would have happened.
        Of equal ranks the leftmost merge comes first, so one in ``b`` does not forestall it, but one in ``a`` does.
        """
        x, y, until, fits = a, b, 1 << 60, True
        ranks, token, left, right = self.ranks, self.token, self.left, self.right
        while True:
            if ranks.get(token[x] + token[y], 1 << 60) < until:
                fits = False
                break
            inner_x, inner_y = right[x], left[y]
            if inner_x >= 0 and (inner_y < 0 or x > y):
                x, until = inner_x, x
            elif inner_y >= 0:
                y, until = inner_y, y + 1
            else:
                break
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = fits
        return fits

    def _follow(self, node: int, data: bytes, ends: list[int]) -> int:
        """Follow the trie from ``node`` over ``data``, adding the id that ends at each byte to ``ends``: of the suffixes
        that are tokens the longest that fits what comes before it. Returns the node reached."""
        child, jumps, pairs = self.child, self.jumps, self.pairs
        here, suffix, of_token, depth = self.ends_here, self.suffix, self.of_token, self.depth
        n = len(ends)
        for byte in data:
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                node = jumps.get(key)
                if node is None:
                    node = self._jump(key >> 8, byte)
            s = here[node]
            while s:
                t, x = of_token[s], ends[n - depth[s]]
                if x < 0:
                    break
                fits = pairs.get(x << 32 | t)
                if fits is None:
                    fits = self._fits(x, t)
                if fits:
                    break
                s = here[suffix[s]]
            else:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
            ends.append(t)
            n += 1
        return node

    def _path(self, ends: list[int], at: int) -> list[int]:
        """The ids that encode the first ``at`` bytes: each byte has the id that ends there."""
        ids, token = [], self.token
        while at > 0:
            ids.append(ends[at])
            at -= len(token[ends[at]])
        ids.reverse()
        return ids

    def _block(self, state: int, data: bytes, ends: list[int]) -> int:
        """Read ``data`` from ``state``; returns the node reached."""
        get, last, begin = self.moves.get, self.last, len(ends)
        for byte in data:
            key = state << 8 | byte
            to = get(key, -2)
            if to >= 0:
                state = to
                ends.append(last[to])
                continue
            at, node = len(ends) - begin, self.node[state]
            if to == -2:  # comes by for the first time: no states for what may never come again
                if len(self.moves) >= self.most:
                    self._renew()
                else:
                    self.moves[key] = -1
                return self._follow(node, data[at:], ends)
            state = self.moves[key] = self._state(self._follow(node, data[at : at + 1], ends), ends)
        return self.node[state]

    def encode(self, piece: bytes, block: int = 4096) -> list[int]:
        if piece in self.whole:
            return [self.ranks[piece]]
        ends = [-1]  # the id before what has not been emitted, then the id that ends at each byte since
        if len(piece) <= block:
            self._block(0, piece, ends)
            return self._path(ends, len(piece))
        ids: list[int] = []
        state = 0
        for begin in range(0, len(piece), block):
            node = self._block(state, piece[begin : begin + block], ends)
            paths, s = [self._path(ends, len(ends) - 1)], node
            while s:
                paths.append(self._path(ends, len(ends) - 1 - self.depth[s]))
                s = self.suffix[s]
            shared = 0
            while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
                shared += 1
            ids += paths[0][:shared]
            del ends[: sum(len(self.token[t]) for t in paths[0][:shared])]
            if len(self.states) > self.most:
                self._renew()
            state = self._state(node, ends)
        return ids + self._path(ends, len(ends) - 1)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of many short pieces."""
        if self.side_by_side is None:
            self.side_by_side = SideBySide(self)
        codes = self.side_by_side.encode(pieces)
        if self.whole:
            codes = [packed([self.ranks[p]]) if p in self.whole else c for p, c in zip(pieces, codes)]
        return codes


class Utf8Stream:
    """Incremental UTF-8 decoder: ``feed`` gives the characters that are complete and keeps at most three bytes.

    The state is what an unfinished character has so far: its lead byte fixes how many bytes must follow.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.rest + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, cut) + 1):
                b = data[cut - back]
                if b >= 0xC0:
                    need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                    cut -= back if need > back else 0
                    break
                if b < 0x80:
                    break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Tokenizer:
    """Splits texts by ``pattern``, encodes each match separately and decodes ids in a stream."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, moves: int = MOVES):
        import regex

        split = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.split = regex.compile(split)
        self.transducer, self.remembered = Transducer(ranks, moves), remembered
        self.memo: dict[str, bytes] = {}  # packed ids of pieces
        self.old_memo: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_parts(text) for i in unpacked(part)]

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Packed ids of ``text`` in blocks of about a million characters that end where a match ends."""
        at, n = 0, len(text)
        while at < n:
            if n - at <= TOGETHER:
                pieces, at = self.split.findall(text, at), n
            else:
                pieces = []
                for m in self.split.finditer(text, at):
                    pieces.append(m[0])
                    if m.end() - at > TOGETHER:
                        break
                at = m.end() if pieces else n
            yield from self._together([pieces])

    def encode_texts(self, texts: Iterable[str]) -> Iterator[list[bytes]]:
        """The parts of each text; texts are taken together up to ``TOGETHER`` characters."""
        group, size = [], 0
        for text in texts:
            if size + len(text) > TOGETHER:
                yield from ([part] for part in self._together(group))
                group, size = [], 0
            if len(text) > TOGETHER:
                yield list(self.encode_parts(text))
            else:
                group.append(self.split.findall(text))
                size += len(text)
        yield from ([part] for part in self._together(group))

    def _together(self, group: list[list[str]]) -> Iterator[bytes]:
        """Packed ids of each list of pieces."""
        codes = self._codes(set().union(*group))
        for pieces in group:
            yield b"".join(map(codes.__getitem__, pieces))

    def _codes(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of each piece: remembered, or made and remembered if it is short."""
        codes, short = {}, []
        memo, old = self.memo, self.old_memo
        for p in pieces:
            got = memo.get(p)
            if got is None:
                got = old.get(p)
                if got is not None:
                    self._remember(p, got)
                elif len(p) < 64:
                    short.append(p)
                    continue
                else:
                    got = packed(self.transducer.encode(p.encode()))
            codes[p] = got
        if len(short) < FEW:
            new = [packed(self.transducer.encode(p.encode())) for p in short]
        else:
            new = self.transducer.encode_many([p.encode() for p in short])
        for p, got in zip(short, new):
            codes[p] = got
            self._remember(p, got)
        return codes

    def _remember(self, p: str, got: bytes):
        if len(self.memo) >= self.remembered:
            self.old_memo, self.memo = self.memo, {}
        self.memo[p] = got

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.token.__getitem__, ids))

    def decode_parts(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of id blocks, each block giving the characters complete so far."""
        stream = Utf8Stream()
        for ids in parts:
            yield stream.feed(self.decode_bytes(ids))
        yield stream.feed(b"", final=True)


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpacked(data: bytes) -> array:
    """The ids that ``packed`` packed."""
    a = array("I")
    a.frombytes(data)
    if sys.byteorder == "big":
        a.byteswap()
    return a


_made: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary file that every machine has."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Tokenizer(read_ranks(path), pattern)
    return _made[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, the ``keep`` columns, ``ids binary`` (little-endian unsigned 32-bit), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` (of the bytes that the ids decode to, by the stream decoder).

    Null and empty texts have no tokens. Texts of any length are encoded whole, in blocks. No shuffle. Unless the session
    sets ``spark.sql.execution.arrow.maxBytesPerBatch`` itself, workers are given batches of ``BATCH`` bytes.
    """
    small_batches(docs.sparkSession, BATCH)
    fields = [docs.schema[id_col], *[docs.schema[c] for c in keep]]
    head = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    schema = f"{head}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import pyarrow as pa

        tok = tokenizer(path, pattern)
        names = [*[f"c{i}" for i in range(len(fields))], "ids", "n_tokens", "ids_sha256", "decoded_sha256"]

        def one(parts):
            sha, decoded, stream = hashlib.sha256(), hashlib.sha256(), Utf8Stream()
            for part in parts:
                sha.update(part)
                decoded.update(stream.feed(tok.decode_bytes(unpacked(part))).encode())
            decoded.update(stream.feed(b"", final=True).encode())
            raw = b"".join(parts)
            return raw, len(raw) // 4, sha.hexdigest(), decoded.hexdigest()

        for b in batches:
            texts, begin, rows, size = b.column(b.num_columns - 1), 0, [], 0
            for end, parts in enumerate(tok.encode_texts(t.as_py() or "" for t in texts), 1):
                rows.append(one(parts))
                size += len(rows[-1][0])
                if size >= FLUSH or end == b.num_rows:
                    head = [c.slice(begin, end - begin) for c in b.columns[:-1]]
                    ids, n, sha, back = zip(*rows)
                    out = [pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                    yield pa.RecordBatch.from_arrays([*head, *out], names)
                    begin, rows, size = end, [], 0

    names = [id_col, *keep]
    flat = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    out = flat.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "ids", "n_tokens", "ids_sha256", "decoded_sha256"
    )
