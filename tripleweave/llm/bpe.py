"""Byte-level BPE as a lazily determinised transducer, and streaming decoding with a UTF-8 state machine.

The encoding of a prefix is the encoding of a shorter prefix plus one last token, and the last token is the only candidate
whose pair with the token before it would not be merged otherwise (Berglund, Martens and van der Merwe, "Constructing a BPE
tokenization DFA", 2024).  So a left-to-right machine needs, for each start from which a vocabulary entry may still grow, its
place in the vocabulary's trie and the last token before it.  That tuple is the state, and an arc's output is the last token of
the text read so far.  States and arcs are made when a text first needs them.  Tokens are emitted at the end of a match of the
splitting pattern, or in a long match once the ways back from all live starts share their border.  Arcs, and whole matches,
are kept in tables of bounded size and made anew when these are full, which changes no result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import picked

#: Kept arcs and kept matches; beyond that the tables start anew.
MAX_STATES, MAX_MATCHES = 80_000, 160_000
NEXT = (1 << 40) - 1
#: Bytes of one match after which settled tokens are emitted; over twice the longest entry.
LOOKAHEAD = 4096
#: Characters encoded at a time; texts are cut only where no match can span.
SLICE = 1 << 18
CUT = re.compile(r"(?<=\S)\s")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file (a line of base64 and rank per token): a vocabulary, so bounded."""
    try:
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
    except FileNotFoundError:  # a path that only Spark's file systems know
        lines = [bytes(r[0], "ascii") for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes the bytes of one match; equal to merging the adjacent pair of least rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int], room: int = 1):
        self.ranks, self.room = ranks, room
        self.trie: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.length = {i: len(t) for t, i in ranks.items()}
        self.token_at: list[int | None] = [None]
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: The two entries that an entry is merged from; none for single bytes.
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merged(token, rank)
                if len(parts) != 2:
                    continue  # never the result of merging its own bytes
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            node = 0
            for byte in token:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][byte]
            self.token_at[node] = rank
        self.adjacent = functools.lru_cache(1 << 17)(self._adjacent)
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        #: state * 256 + byte -> next state * 256 and last token, packed
        self.arcs: dict[int, int] = {}
        self.state(((0, -1),))

    def state(self, live: tuple) -> int:
        found = self.number.get(live)
        if found is None:
            found = self.number[live] = len(self.states)
            self.states.append(live)
        return found

    def merged(self, text: bytes, below: int) -> list[bytes]:
        """Merging by definition with the ranks below one; used on the entries when the machine is built."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, best = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the two stay apart: merges at their border are undone from the last one back, and none of the pairs
        that then meet may be merged before the merge that took one of them away."""
        before = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], before) < before:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                before, a = a, left[1]
            else:  # among equal ranks the left pair is merged first
                before, b = b + 1, right[0]

    def _arc(self, key: int) -> int:
        """The arc of a state by a byte.  A live start is (trie node, last token before it or -1)."""
        trie, token_at, live, last, byte = self.trie, self.token_at, [], None, key & 255
        for node, before in self.states[key >> 8]:
            grown = trie[node].get(byte)
            if grown is None:
                continue
            if trie[grown]:
                live.append((grown, before))
            if last is None:
                token = token_at[grown]
                if token is not None and (before < 0 or self.adjacent(before, token)):
                    last = token
        if last is None:
            raise ValueError(f"byte {byte} cannot be encoded by this vocabulary")
        live.append((0, last))
        self.arcs[key] = packed = self.state(tuple(live)) << 8 | last << 40
        return packed

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to a place, from the last token of each prefix."""
        out, length = [], self.length
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= length[token]
        return out[::-1]

    def _settled(self, lasts: list[int], live: tuple) -> int:
        """The last token border that lies on the way back from every live start: what is before it is final."""
        depth, ways = self.depth, None
        for node, _ in live:
            at, way = len(lasts) - depth[node], set()
            while at > 0:
                way.add(at)
                at -= self.length[lasts[at - 1]]
            ways = way if ways is None else ways & way
        return max(ways, default=0)

    def encode(self, match: bytes) -> list[int]:
        if len(self.states) > MAX_STATES * self.room:
            self.restart()
        at, arcs, out, lasts = 0, self.arcs, [], []
        for byte in match:
            arc = arcs.get(at | byte)
            if arc is None:
                arc = self._arc(at | byte)
            at = arc & NEXT
            lasts.append(arc >> 40)
            if len(lasts) >= LOOKAHEAD:
                done = self._settled(lasts, self.states[at >> 8])
                out += self._back(lasts, done)
                del lasts[:done]
        return out + self._back(lasts, len(lasts)) if out else self._back(lasts, len(lasts))


class Matches(dict):
    """Ids of a match as little-endian 32-bit integers."""

    def __init__(self, machine: Transducer):
        self.machine, self.most = machine, MAX_MATCHES * machine.room

    def __missing__(self, match: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.machine.encode(match.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(match) <= 64:
            self[match] = ids
        return ids


def slices(text: str) -> Iterator[str]:
    """Consecutive parts of a text, cut before white space that follows other characters: no match crosses that."""
    at = 0
    while len(text) - at > SLICE:
        cut = CUT.search(text, at + SLICE)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Utf8Stream:
    """Incremental UTF-8: bytes in pieces of any length, whole characters out.

    Its state is the started character: the bytes seen of it and how many it still needs."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        back = 0  # bytes of an unfinished character at the end
        for i in range(1, min(4, len(data)) + 1):
            byte = data[-i]
            if byte & 0xC0 == 0x80:
                continue
            need = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            back = i if i < need else 0
            break
        whole, self.held = (data[:-back], data[-back:]) if back else (data, b"")
        return whole.decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """Encoder and decoder over one vocabulary; holds no text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 1):
        self.find = regex.compile(pattern).findall
        self.matches = Matches(Transducer(ranks, room))
        self.bytes_of = {i: t for t, i in ranks.items()}

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        lookup = self.matches.__getitem__
        for part in slices(text):
            yield b"".join(map(lookup, self.find(part)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_chunks(text)), "<u4").tolist()

    def decode_chunks(self, chunks: Iterable[bytes]) -> Iterator[str]:
        stream, lookup = Utf8Stream(), self.bytes_of.__getitem__
        for chunk in chunks:
            yield stream.feed(b"".join(map(lookup, np.frombuffer(chunk, "<u4").tolist())))
        yield stream.end()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_chunks([np.array(list(ids), "<u4").tobytes()]))


_codecs: dict[tuple, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, room: int = 1) -> Codec:
    """One codec per worker process and vocabulary, so that its tables serve all batches."""
    key = (pattern, room, len(ranks), hashlib.md5(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).digest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, room)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "token_ids",
                     digests: bool = False) -> DataFrame:
    """``docs`` with an array column of token ids, and with ``digests`` also n_tokens, ids_sha256 and decoded_sha256.

    Null text counts as empty; all other columns and repeated rows stay.  New columns must not clash with those of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType()))
    if digests:
        schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # ids are several times the size of a text's share of a batch
                part = batch.slice(at, 64)
                chunks = [b"".join(own.encode_chunks(t or "")) for t in part[text].to_pylist()]
                size = np.cumsum([0, *(len(c) // 4 for c in chunks)])
                values = pa.array(np.frombuffer(b"".join(chunks), "<i4"))
                new = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), values)]
                if digests:
                    new += [pa.array(np.diff(size)), pa.array([hashlib.sha256(c).hexdigest() for c in chunks], pa.string()),
                            pa.array([digest_text(own.decode_chunks([c])) for c in chunks], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def digest_text(parts: Iterable[str]) -> str:
    whole = hashlib.sha256()
    for part in parts:
        whole.update(part.encode())
    return whole.hexdigest()


def decode_documents(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array column of token ids; null ids give an empty text."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        own = codec(shipped.value, "")
        for batch in batches:
            out = pa.array(["" if i is None else own.decode(i) for i in batch[ids].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(text, "string"))


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text",
                  room: int = 3) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids decoded again, slice by slice.

    Null text counts as empty; null ids are passed on; repeated rows stay.  A narrow pass: no shuffle; the ids of a long
    text are never held whole.  ``room`` scales the tables that a worker keeps (3 took some 300 MB a worker more than 1 on
    0.5 GB of texts); it changes speed and memory, no result."""
    rows = picked(docs, doc_id=doc_id, text=text)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def digest(own: Codec, value: str) -> tuple[int, str, str]:
        ids, n = hashlib.sha256(), 0

        def seen():
            nonlocal n
            for chunk in own.encode_chunks(value):
                n += len(chunk) // 4
                ids.update(chunk)
                yield chunk

        back = digest_text(own.decode_chunks(seen()))
        return n, ids.hexdigest(), back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern, room)
        for batch in batches:
            out = [digest(own, t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
