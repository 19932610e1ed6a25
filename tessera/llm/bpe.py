"""Byte-level BPE by longest matches, backtracking and memoised adjacent-token compatibility.

Bytes are mapped to Latin-1 so that a ``pyahocorasick`` automaton over all tokens reports, in one
pass, every token that starts at each byte. A token sequence is the result of the ranked merges
exactly when every adjacent pair is compatible, that is, when merging the two tokens' bytes gives
back that pair. So the encoder takes the longest token at each position, steps to the next shorter
one where the pair with the token before is not compatible, and backs up where none is left; a
position from which it backed up is never tried again, which keeps the work linear. Compatibility of a pair is
computed once and remembered.

Defined results: null text counts as empty and gives no ids; empty text gives no ids; any length of
text is encoded whole; rows keep their other columns; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces and pairs a worker remembers before it starts afresh; bounds its memory, not its results.
MEMO_PIECES, MEMO_PAIRS = 400_000, 400_000
#: Bytes of text that are decoded in one vectorised pass.
DECODE = 1 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class _Pieces(dict):
    """Piece of text -> its ids as little-endian uint32 bytes; computed at the first lookup."""

    def __init__(self, bpe: BytePairEncoder):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_bytes(piece.encode("utf-8")), "<u4").tobytes()
        if len(self) >= MEMO_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        size = max(self.tokens, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merged(self, raw: bytes) -> list[int]:
        """Ids of ``raw`` by repeated merging of the pair of lowest rank; for the short strings of pair tests."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives back just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token; a rank file may list others."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        n = len(raw)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            starts[end - length + 1].append((length, token))  # ends ascend, so lengths do
        ids: list[int] = []
        at: list[int] = []  # where each id starts
        pos, dead = 0, bytearray(n + 1)
        left: list[list[tuple[int, int]]] = []  # choices still open for each id
        choices = list(starts[0]) if n else []
        while pos < n:
            took = False
            while choices:
                length, token = choices.pop()
                if dead[pos + length] or not self.reachable(token):
                    continue
                if ids and not self.compatible(ids[-1], token):
                    continue
                ids.append(token)
                at.append(pos)
                left.append(choices)
                pos += length
                choices = list(starts[pos]) if pos < n else []
                took = True
                break
            if not took:
                if not ids:
                    raise ValueError("the rank file lacks a single byte")
                dead[pos] = 1
                ids.pop()
                pos, choices = at.pop(), left.pop()
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a whole text, as little-endian uint32."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        out = []
        step = DECODE // 4
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            total = int(ends[-1])
            at = np.arange(total, dtype=np.int64) + np.repeat(self.starts[part] - (ends - lengths), lengths)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


_LOADED: dict[tuple[str, str], BytePairEncoder] = {}


def load(raw: bytes, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file, built once in each process."""
    key = hashlib.md5(raw).hexdigest(), pattern
    if key not in _LOADED:
        _LOADED[key] = BytePairEncoder(read_ranks(raw), pattern)
    return _LOADED[key]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out``, the ids of each whole text as binary little-endian uint32.

    An existing column ``out`` is replaced. ``keep_text=False`` drops the text after use.
    """
    shared = docs.sparkContext.broadcast(ranks) if hasattr(docs, "sparkContext") else docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in docs.schema.fields if f.name != out and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in _texts(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], [*names, out])

    schema = type(docs.schema)(kept).add(out, "binary")
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: bytes, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, the last from decoding the ids again."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value, pattern)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for t in _texts(batch.column(1)):
                ids = bpe.encode(t)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
