"""Token ids in a content-addressed store.

Each document's ids are cut into chunks where a rolling hash of the last ids ends in zeros, so equal
passages cut alike wherever they stand. A chunk's name is the digest of its bytes; each distinct chunk is
stored once. A document is a recipe, the list of its chunks' names, and the recipes lie in
ascending document order with the position of each document in the whole id stream. A manifest holds
Merkle roots: of each document over its chunks, of each recipe file over its documents, and of the store.

Layout under the store's folder, all Parquet (so a lost task leaves nothing half-written)::

    chunks/    digest binary, n_ids int, payload binary   ids as little-endian uint16 (uint32 if the vocabulary needs it)
    recipes/   part int, doc_id, start long, n_tokens long, digests binary, root binary   sorted by doc_id
    manifest/  part int, documents long, tokens long, root binary; part -1 is the whole store

Defined results: null text counts as empty and holds only the end id; null doc_ids come first; rows with
one doc_id each keep their own recipe, ordered by content; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._text import Sequences, Texts, mix, slices, spans, word_hashes
from tessera.plans.scratch import Scratch, delete_path

#: Ids that the rolling hash covers, mean, least and greatest chunk length in ids.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 4096
#: Bytes of a digest.
DIGEST = 16
#: Words that a worker remembers before it keeps only those that came again; longer words (in bytes) are not remembered.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 256
#: Marks that the joint encoding of words may cut off.
_MARKS = tuple(".,;:!?")
_MARK_NUMBER = np.zeros(256, np.int64)
_MARK_NUMBER[[ord(c) for c in _MARKS]] = np.arange(1, len(_MARKS) + 1)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_TABLE = mix(np.arange(1 << 16, dtype=np.uint64))


class _Memo:
    """Ids of words by two 64-bit hashes of their bytes: sorted keys in two levels, and one flat array of ids."""

    def __init__(self, fixed: list[list[int]]):
        """``fixed``: ids of the first slots, which have no key."""
        self.fixed = fixed
        self._clear()

    def _clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.check, self.again = np.zeros(len(self.fixed), np.uint64), np.zeros(len(self.fixed), bool)
        self.size = np.array([len(x) for x in self.fixed], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.array([i for x in self.fixed for i in x], np.uint32)

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        out = np.full(len(keys), -1)
        for known, slots in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = (known[at] == keys) & (self.check[slots[at]] == check)
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of new words."""
        slots = np.arange(len(self.first), len(self.first) + len(keys))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.check = np.concatenate([self.check, check])
        self.again = np.concatenate([self.again, np.zeros(len(keys), bool)])
        self.levels[1] = self._merged(self.levels[1], (keys, slots))
        if 4 * len(self.levels[1][0]) > len(self.levels[0][0]):
            self.levels = [self._merged(*self.levels), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        return slots

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], slots[order]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots in order, and where those of each begin (one more at the end)."""
        sizes = self.size[slots]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.first[slots] - at[:-1], sizes) + np.arange(at[-1])], at

    def shrink(self) -> None:
        """Beyond ``MEMO_WORDS``, forget words that came in one batch only."""
        if len(self.first) <= MEMO_WORDS:
            return
        keys, slots = self._merged(*self.levels)
        keep = self.again[slots]
        keys, slots = keys[keep], slots[keep]
        if 2 * len(keys) > MEMO_WORDS:
            return self._clear()
        check, sizes, ids = self.check[slots], self.size[slots], self.gather(slots)[0]
        self._clear()
        self.add(keys, check, sizes, ids)


class TextEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    If the tokenizer drops white space before it splits and no token can span it (``by_words``), a text's ids are those of
    its words in order: words are hashed and looked up in Arrow buffers, and only unknown ones become strings. Where it also
    marks the last token of a run of letters (``</w>``) and splits letters from punctuation (``joint``), a mark after ASCII letters is a
    word by itself, and unknown words of letters alone are encoded together in one text, and parted at those marks.
    """

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(spec)
        self.size = self.tokenizer.get_vocab_size()
        pre = self.tokenizer.pre_tokenizer
        pieces = [p for p, _ in pre.pre_tokenize_str("a  b\n\tc d\re\x0bf\x0cg")] if pre else []
        self.by_words = pieces == list("abcdefg") and self.tokenizer.post_processor is None
        pieces = [p for p, _ in pre.pre_tokenize_str("ab. cd, e; f: g! h?")] if pre else []
        apart = pieces == ["ab", ".", "cd", ",", "e", ";", "f", ":", "g", "!", "h", "?"]
        self.joint = self.by_words and apart and json.loads(spec)["model"].get("end_of_word_suffix") == "</w>"
        # the same model for words that need no normalising and no splitting but at spaces
        self.plain = Tokenizer.from_str(spec)
        if self.joint:
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("aBZ") == "abz"
        self.last = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.memo = _Memo([[end_id], *(self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS)])

    def _each(self, words: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids; words of letters alone, in the form that normalising gives."""
        sizes, parts = [], []
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # some letter is none to the library
                size, ids = _flat(self._each(some))
            else:
                size = np.diff(ends, prepend=0)
            sizes.append(size)
            parts.append(ids.astype(np.uint32))
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *parts])

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids; any words."""
        if not self.joint:
            return _flat(self._each(words))
        # what each word is made of: a stem of letters that needs no normalising, and a mark after it
        stems, made, other = {}, [], []
        for word in words:
            mark = word[-1] if word[-1] in _MARKS else ""
            stem = word[:-1] if mark else word
            # two letters are lower-cased by context in Python, but not in the library
            if not stem.isalpha() or not (stem.isascii() or (is_normalized("NFC", stem) and "\u03a3" not in stem and "\u0130" not in stem)):
                made.append((None, len(other)))
                other.append(word)
                continue
            made.append((mark, stems.setdefault(stem.lower() if self.lowers else stem, len(stems))))
        sizes, ids = self._letters(list(stems))
        ends = np.cumsum(sizes)
        of_stem = [ids[a:b].tolist() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        of_other, of_mark = self._each(other), {m: list(x) for m, x in zip(_MARKS, self.memo.fixed[1:], strict=True)}
        return _flat([of_other[i] if mark is None else of_stem[i] + of_mark[mark] if mark else of_stem[i] for mark, i in made])

    def _slots(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The memo's slots of the words, marks and end ids in order, and where those of each text begin; None if two words share a hash."""
        data, marks = texts.data, np.zeros(len(starts), np.int64)
        if self.joint:
            other = np.concatenate([[0], np.cumsum(~_LETTER[data])])
            marks = _MARK_NUMBER[data[ends - 1]] * (ends - starts > 1)
            cut = ends - (marks > 0)
            plain = other[cut] == other[starts]
            marks = marks * plain
            ends = np.where(plain, cut, ends)
            if self.lowers:
                within = np.zeros(len(data) + 1, np.int8)
                within[starts[plain]] = 1
                within[ends[plain]] -= 1
                data = np.where(_UPPER[data] & (np.cumsum(within[:-1], dtype=np.int8) > 0), data + np.uint8(32), data)
        key, check = (word_hashes(data, starts, ends, check=c) for c in (False, True))
        keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        checks = check[at]
        if not np.array_equal(checks[inverse], check):
            return None
        slots = self.memo.find(keys, checks)
        new = np.flatnonzero(slots < 0)
        self.memo.again[slots[slots >= 0]] = True
        raw = data.tobytes()
        letters = plain[at[new]] if self.joint else np.zeros(len(new), bool)
        for some, learn in ((new[letters], self._letters), (new[~letters], self._others)):
            if len(some):
                words = [raw[a:b].decode() for a, b in zip(starts[at[some]].tolist(), ends[at[some]].tolist(), strict=True)]
                slots[some] = self.memo.add(keys[some], checks[some], *learn(words))
        marked = np.flatnonzero(marks)
        out = np.insert(slots[inverse], np.concatenate([marked + 1, first[1:]]), np.concatenate([marks[marked], np.zeros(len(first) - 1, np.int64)]))
        return out, first + np.searchsorted(marked, first) + np.arange(len(first))

    def _rows(self, texts: list[str]) -> Iterator[np.ndarray]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array([*found.ids, self.memo.fixed[0][0]], np.uint32)

    def __call__(self, column: pa.Array, at_once: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of each text with the end id, encoded in runs of about ``at_once`` bytes of text."""
        for texts in slices(column, at_once):
            rows = column.slice(texts.lo, texts.hi - texts.lo)
            starts, ends, first = spans(texts)
            # very long words are left to the library with their whole text: their hashes could be made to meet
            if not self.by_words or (len(starts) and int((ends - starts).max()) > MEMO_BYTES):
                for i in range(len(rows)):
                    plain = self.by_words and not (ends[first[i] : first[i + 1]] - starts[first[i] : first[i + 1]] > MEMO_BYTES).any()
                    yield from self(rows.slice(i, 1)) if plain else self._rows([rows[i].as_py() or ""])
                continue
            found = self._slots(texts, starts, ends, first)
            if found is None:
                yield from self._rows([x or "" for x in rows.to_pylist()])
                continue
            ids, at = self.memo.gather(found[0])
            bounds = at[found[1]].tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[lo:hi]
            self.memo.shrink()


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return sizes, np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum()))


_LOADED: dict[tuple[str, int], TextEncoder] = {}


def load(spec: str, end_id: int) -> TextEncoder:
    key = hashlib.md5(spec.encode()).hexdigest(), end_id
    if key not in _LOADED:
        _LOADED[key] = TextEncoder(spec, end_id)
    return _LOADED[key]


def cuts(ids: np.ndarray, *, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Chunk ends of one document's ids: content-defined, within ``least`` and ``most`` (the last may be shorter)."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    seq = Sequences(_TABLE[ids & 0xFFFF] + (ids >> 16).astype(np.uint64))
    end = np.arange(WINDOW, n + 1)
    marks = end[seq(end - WINDOW, end) >> np.uint64(40) & np.uint64(mean - 1) == 0]
    out, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > most:
            last += most
            out.append(last)
        if mark - last >= least and mark < n:
            out.append(mark)
            last = mark
    if last < n:
        out.append(n)
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests in order; pairs are hashed level by level, an odd last one moves up."""
    if not leaves:
        return _digest(b"empty")
    level = leaves
    while len(level) > 1:
        level = [_digest(b"node" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return _digest(b"root" + level[0])


def _store_part(pieces: list[tuple[bytes, int, bytes]], recipes: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Chunk rows (kind 0) and recipe rows (kind 1) of a batch in one record batch."""
    a, b = len(pieces), len(recipes)
    columns = [
        pa.array([0] * a + [1] * b, pa.int32()),
        pa.array([x[0] for x in pieces] + [None] * b, pa.binary()),
        pa.array([x[1] for x in pieces] + [None] * b, pa.int32()),
        pa.array([x[2] for x in pieces] + [None] * b, pa.binary()),
        pa.array([None] * a + [x[0] for x in recipes], kind),
        pa.array([None] * a + [x[1] for x in recipes], pa.int64()),
        pa.array([None] * a + [x[2] for x in recipes], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "digest", "n_ids", "payload", "doc_id", "n_tokens", "digests"])


def write_store(docs: DataFrame, path: str, spec: str, *, end_id: int, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode every whole text and write the store to ``path`` (a folder any executor can reach)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(shared.value, end_id)
        store = np.dtype("<u2") if encoder.size <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            kind, held = batch.column(0).type, set()
            pieces, recipes, size = [], [], 0
            for key, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                names, last = [], 0
                narrow = ids.astype(store)
                for end in cuts(ids):
                    payload = narrow[last:end].tobytes()
                    name = _digest(payload)
                    names.append(name)
                    if name not in held:
                        held.add(name)
                        pieces.append((name, end - last, payload))
                        size += len(payload)
                    last = end
                recipes.append((key, len(ids), b"".join(names)))
                if size > 8 << 20:
                    yield _store_part(pieces, recipes, kind)
                    pieces, recipes, size = [], [], 0
            yield _store_part(pieces, recipes, kind)

    scratch = Scratch(spark, "id-store")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"kind int, digest binary, n_ids int, payload binary, doc_id {id_type}, n_tokens long, digests binary"
    )
    encoded = scratch.table(rows, "encoded", ("kind",), "snappy")  # read once and dropped
    # one copy of each chunk, named by content; any copy is as good as another
    chunks = encoded.where("kind = 0").select("digest", "n_ids", "payload").dropDuplicates(["digest"])
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = encoded.where("kind = 1").select("doc_id", "n_tokens", "digests").repartitionByRange(F.col("doc_id").asc_nulls_first())
    recipes = recipes.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digests").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0  # tokens before, within this part
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            roots = [merkle(_split(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), pa.array(start), batch.column(1), batch.column(2), pa.array(roots, pa.binary())], ["part", "doc_id", "local_start", "n_tokens", "digests", "root"])

    numbered = scratch.table(recipes.mapInArrow(number, f"part int, doc_id {id_type}, local_start long, n_tokens long, digests binary, root binary"), "numbered")
    # one row for each part: their number follows from the partitioning, not from the documents
    parts = numbered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    parts = parts.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered.join(F.broadcast(parts.select("part", "before")), "part")
    placed.select("part", "doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "digests", "root").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")
    _write_manifest(spark, path, parts)
    delete_path(spark, scratch.path)
    return path


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]


def _part_roots(recipes: DataFrame) -> DataFrame:
    """The Merkle root of each recipe part, over its documents in order, in streaming form: each one's place, key and chunk list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, hashlib.blake2b] = {}
        for batch in batches:
            for part, start, n_tokens, key, digests, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if merkle(_split(digests)) != root:
                    raise ValueError("a document's root does not follow from its recipe")
                if part not in state:
                    state[part] = hashlib.blake2b(b"part", digest_size=DIGEST)
                name = b"" if key is None else b"key" + key.encode()
                state[part].update(start.to_bytes(8, "little") + n_tokens.to_bytes(8, "little") + len(name).to_bytes(8, "little") + name + root)
        yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([h.digest() for h in state.values()], pa.binary())], ["part", "root"])

    spread = recipes.select("part", "start", "n_tokens", F.col("doc_id").cast("string").alias("key"), "digests", "root").repartition("part").sortWithinPartitions("part", "start", "root")
    return spread.mapInArrow(run, "part int, root binary")


def _bad_roots(spark: SparkSession, path: str, recipes: DataFrame) -> tuple[int, int]:
    """Recipe parts whose root is not the manifest's, and whether the store's root does not follow from those of its parts."""
    said = spark.read.parquet(f"{path}/manifest")
    parts = said.where("part >= 0").alias("a").join(_part_roots(recipes).alias("b"), "part", "full").where("a.root is null or b.root is null or a.root <> b.root").count()
    roots = [bytes(r[0]) for r in said.orderBy("part").select("root").collect()]  # one for each recipe file, and the store's
    return parts, int(not roots or roots[0] != merkle(roots[1:]))


def _write_manifest(spark: SparkSession, path: str, parts: DataFrame) -> None:
    roots = _part_roots(spark.read.parquet(f"{path}/recipes"))
    table = parts.join(roots, "part").select("part", "documents", "tokens", "root").orderBy("part").toPandas()
    whole = merkle([bytes(x) for x in table["root"]])
    total = pd.DataFrame({"part": [-1], "documents": [int(table["documents"].sum())], "tokens": [int(table["tokens"].sum())], "root": [whole]})
    table = pd.concat([total, table]) if len(table) else total
    table["root"] = [bytes(x) for x in table["root"]]
    spark.createDataFrame(table.astype({"part": "int32", "documents": "int64", "tokens": "int64"}), "part int, documents long, tokens long, root binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def verify_store(spark: SparkSession, path: str) -> dict[str, int]:
    """Recompute all Merkle roots and chunk names; counts of what does not agree (all 0 for a sound store)."""
    recipes = spark.read.parquet(f"{path}/recipes")
    bad_parts, bad_store = _bad_roots(spark, path, recipes)
    chunks = read_chunks(spark, path)
    bad_chunks = chunks.where(~F.col("sound")).count()
    names = recipes.select(F.explode(_digest_list()).alias("digest"))
    missing = names.join(chunks.select("digest"), "digest", "left_anti").count()
    return {"parts": bad_parts, "store": bad_store, "chunks": bad_chunks, "missing": missing}


def _digest_list():
    return F.when(F.length("digests") == 0, F.array().cast("array<binary>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1), lambda i: F.substring(F.col("digests"), i * DIGEST + 1, F.lit(DIGEST)))
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Per stored chunk: ``digest, n_ids, crc, sound``; ``crc`` is of its ids as uint32, ``sound`` whether its bytes have its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, sound = [], []
            for name, n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(payload, f"<u{len(payload) // n}")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sound.append(_digest(payload) == name and len(ids) == n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], ["digest", "n_ids", "crc", "sound"])

    return spark.read.parquet(f"{path}/chunks").select("digest", "n_ids", "payload").mapInArrow(run, "digest binary, n_ids int, crc long, sound boolean")


def _gf2_tables() -> list[np.ndarray]:
    """For each power of two of ids, the linear map that appends so many zero bytes x 4 to a crc32, as four byte tables."""

    def apply(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    matrix = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(5):  # 32 zero bits: one id
        matrix = [apply(matrix, m) for m in matrix]
    tables = []
    for _ in range(14):
        tables.append(np.array([[apply(matrix, byte << (8 * k)) for byte in range(256)] for k in range(4)], np.uint32))
        matrix = [apply(matrix, m) for m in matrix]
    return tables


_SHIFT: list[np.ndarray] = []


def combine_crc(crc: np.ndarray, next_crc: np.ndarray, next_ids: np.ndarray) -> np.ndarray:
    """crc32 of joined byte strings from those of the two parts and the second one's length in ids of 4 bytes."""
    if not _SHIFT:
        _SHIFT.extend(_gf2_tables())
    out = crc.astype(np.uint32)
    for k, table in enumerate(_SHIFT):
        on = (next_ids >> k) & 1 == 1
        if on.any():
            v = out[on]
            out[on] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out ^ next_crc.astype(np.uint32)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    The recipes are held against the manifest's Merkle roots first; a store that does not agree is refused (ValueError). Each chunk is read, checked against its name and summed once, however many documents share it; documents
    fetch the sums of their chunks and join them, so the ids themselves are not shuffled.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    if any(_bad_roots(spark, path, recipes)):
        raise ValueError("recipes and manifest of the store do not agree")
    uses = recipes.select("start", "doc_id", "n_tokens", F.posexplode(_digest_list()).alias("pos", "digest"))
    chunks = read_chunks(spark, path).select("digest", "n_ids", F.when(F.col("sound"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk's bytes do not have its name")).cast("long")).alias("crc"))
    # a chunk that very many documents share is one key: such joins are split by Spark's skew handling
    placed = uses.join(chunks, "digest").select("start", "doc_id", "n_tokens", F.struct("pos", "crc", "n_ids").alias("piece"))
    # start is unique to each document, for each has at least its end id
    whole = placed.groupBy("start").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            first = lists.offsets.to_numpy()
            flat = lists.values
            crc, n = flat.field("crc").to_numpy(), flat.field("n_ids").to_numpy().astype(np.int64)
            sizes = np.diff(first)
            total, tokens = np.zeros(len(batch), np.uint32), np.zeros(len(batch), np.int64)
            for k in range(int(sizes.max()) if len(sizes) else 0):
                on = np.flatnonzero(sizes > k)
                at = first[on] + k
                total[on] = combine_crc(total[on], crc[at], n[at])
                tokens[on] += n[at]
            if not np.array_equal(tokens, batch.column(2).to_numpy()):
                raise ValueError("a document's chunks do not add up to its recipe")
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(total.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("start", "doc_id", "n_tokens", "pieces").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document its ids again: ``doc_id, start, ids`` (array of int), rebuilt from recipe and chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("start", "doc_id", F.posexplode(_digest_list()).alias("pos", "digest"))
    stored = spark.read.parquet(f"{path}/chunks")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    whole = uses.join(stored, "digest").groupBy("start").agg(F.any_value("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "n_ids", "payload"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column(2).to_pylist():
                out.append(np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n_ids']}").astype(np.int32) for p in pieces]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return whole.select("start", "doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")
