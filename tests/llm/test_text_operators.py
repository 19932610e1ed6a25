"""The operators on texts against brute force, with nulls, empty and long texts, repeats and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, id_store, language_id, ngram_join, packing, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text]


def corpus():
    """Documents with copies, near copies, shared passages and odd texts."""
    rng = random.Random(3)
    out = []
    for _ in range(25):
        text = words(rng, rng.choice([3, 30, 80, 200, 400]))
        out.append(" ".join(text))
        for share in (0.0, 0.01, 0.03, 0.06, 0.1):
            if rng.random() < 0.5:
                out.append(" ".join(edited(rng, text, share)))
    passage = words(rng, 90)
    for _ in range(8):
        out.append("  ".join(words(rng, 40) + passage[: rng.randrange(50, 90)] + words(rng, 20)))
    out += ["", " \n\t ", "One", "one two", "ONE  TWO", "one two three", None, None, "é" * 3, " ".join(words(rng, 6000))]
    order = list(range(len(out)))
    rng.shuffle(order)
    rows = [(i, out[k], None if i % 9 == 0 else "en", "s", None) for i, k in enumerate(order)]
    return rows + [rows[4], (None, "one two three four five six", "en", "s", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = fold(text).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, num, den):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), x), x)
    return sorted(((x is not None, x or 0), len(sets[i]), x if not sets[i] else least.get(root(i))) for i, x in enumerate(ids))


@pytest.mark.parametrize(("n", "threshold", "num", "den"), [(3, 0.9, 90, 100), (5, 0.8, 80, 100), (1, 0.7, 7, 10)])
def test_ngram_join_finds_all_links(docs, rows, n, threshold, num, den):
    got = ngram_join.similar_documents(docs, n=n, threshold=threshold).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == components(rows, n, num, den)


def test_ngram_join_blocks_bound_memory_not_results(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    got = ngram_join.similar_documents(docs, n=3, threshold=0.8).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == components(rows, 3, 8, 10)


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Copies with few or many edits of one text, most of them linked through the text only, and copies of copies."""
    rng = random.Random(11)
    base = words(rng, 120, 10**6)
    texts = [" ".join(base)]
    for i in range(160):
        source = texts[rng.randrange(len(texts))].split() if i % 4 == 0 else base
        texts.append(" ".join(edited(rng, source, rng.choice([0.005, 0.02, 0.03, 0.05]))))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, texts[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("k"), "block": F.lit(1), "n_grams": F.lit(2)}).repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(ngram_join, "PILOTS", 4)
    got = ngram_join.similar_documents(docs, n=5, threshold=0.8).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == components(rows, 5, 8, 10)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_pairs_share_enough_tokens():
    rng = np.random.default_rng(0)
    for t in (0.8, 0.9):
        bands = ngram_join._bands(t)
        for size in (5, 11, 40, 200, 900):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            for _ in range(5):
                drop = rng.random(len(a)) < (1 - t) / 2
                b = np.unique(np.concatenate([a[~drop], rng.integers(0, 2**63, int(drop.sum() * 0.5)).astype(np.uint64)]))
                if len(b) and ngram_join._linked(a, b, bands.t.numerator, bands.t.denominator):
                    (ka, sa, na), (kb, sb, nb) = ngram_join.tokens_of(a, bands), ngram_join.tokens_of(b, bands)
                    ok = [len(set(ka[sa == s]) & set(kb[sb == s])) >= max(na[sa == s][0], nb[sb == s][0]) for s in set(sa) & set(sb)]
                    assert any(ok)


def brute_repeats(rows, k):
    first = {}
    split = [((r[1] or "").encode().split(), r[0]) for r in rows]
    for w, d in split:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for w, d in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(((d is not None, d or 0), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [substring_dedup.MOST_BROADCAST, 0])
def test_substring_dedup(docs, rows, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_BROADCAST", most)
    got = substring_dedup.remove_repeats(docs, digest=True).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 50)


def test_substring_dedup_keeps_columns_and_untouched_texts(docs, rows):
    out = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash")))
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n_words", "n_removed"]
    same = {(r[0], r[1]) for r in rows}
    for r in out.collect():
        assert r.n_removed or (r.doc_id, r.text) in same


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS), digest=True).count() == 0


def test_compact_paths_cover_every_edge_once():
    rng = np.random.default_rng(1)
    sizes = [0, 49, 50, 51, 200, 3]
    w = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner, edge, count, _, _ = substring_dedup.compact_paths(w, first, 50, 10)
    got = sorted((int(o), int(e) + i) for o, e, c in zip(owner, edge, count, strict=True) for i in range(c))
    assert got == [(d, i) for d, n in enumerate(sizes) for i in range(max(0, n - 49))]


RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["<|endoftext|> it's   we'll\r\n x", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "=" * 999, "日本語 ελληνικά \U0001f600́", "don'T 12345 \x00\x01", "abc" * 2000, "\n\n\n \t "]


def test_byte_bpe_equals_the_library(docs, rows, spark):
    ref = encoding()
    table = spark.createDataFrame([*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(ODD))], "doc_id long, text string")
    want = []
    for d, t in [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(ODD))]:
        ids = np.array(ref.encode_ordinary(t or ""), "<u4")
        want.append((str(d), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(table, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_byte_bpe_random_bytes():
    rng = random.Random(5)
    own, ref = bpe.load(RANKS, public_tokenizers.PATTERN), encoding()
    for _ in range(150):
        text = "".join(rng.choice("abehinorst ABéß0123'.\n中") for _ in range(rng.randrange(1, 120)))
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == ref.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_encode_keeps_columns_and_replaces_clashes(spark):
    df = spark.createDataFrame([("a b", "x", 1)], "text string, ids string, n int")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["text", "n", "ids"]
    assert np.frombuffer(bytes(out.first().ids), "<u4").tolist() == encoding().encode_ordinary("a b")
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_id_store_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    table = spark.createDataFrame([*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(ODD))], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    id_store.write_store(table.repartition(3), path, spec, end_id=2)
    got = sorted(id_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    texts = {}
    for d, t in [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(ODD))]:
        texts.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[r.doc_id]}
    assert len(got) == len(rows) + len(ODD)
    assert id_store.verify_store(spark, path) == {"parts": 0, "store": 0, "chunks": 0, "missing": 0}
    for r in id_store.read_ids(spark, path).collect():
        assert list(r.ids) in texts[r.doc_id]
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == stored.select("digest").distinct().count()


def nasty_texts(rng):
    """Texts of letters in all cases, marks, digits, symbols, marks that combine, and all kinds of white space."""
    parts = ["the", "The", "THE", "a.", "B!", "x,y", "...", "don't", "été", "Été,", "e\u0301t", "\u03a3as", "\u0130x", "naïve.", "7", "3.14", "<br/>", "日本語", "\U0001f600", ".", "z" * 300, "q" * 300 + "."]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\u00a0", "\u2003"]
    out = ["", " ", "\n", None, "Word", "end."]
    for _ in range(60):
        out.append("".join(rng.choice(parts + ["".join(rng.choices("abcXYZé.,", k=rng.randrange(1, 9)))]) + rng.choice(gaps) for _ in range(rng.randrange(1, 40))))
    return out


@pytest.mark.parametrize("most", [id_store.MEMO_WORDS, 20])
def test_encoder_equals_the_library(monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_store, "MEMO_WORDS", most)
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(spec), id_store.TextEncoder(spec, 2)
    texts = nasty_texts(random.Random(5))
    for at_once in (1, 300, 1 << 21):
        got = [x.tolist() for x in encoder(pa.array(texts, pa.string()), at_once)]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_id_store_refuses_what_its_manifest_does_not_hold(spark, docs, tmp_path):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    path = f"file://{tmp_path}/store"
    # columns of any name beside those that are read
    id_store.write_store(docs.withColumns({"digest": F.lit(1), "part": F.lit(2), "root": F.lit("x")}), path, spec, end_id=2)
    assert id_store.read_digests(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    recipes = spark.read.parquet(f"{path}/recipes")
    changes = [
        recipes.withColumn("doc_id", F.when(F.col("start") == 0, F.lit(-5).cast("long")).otherwise(F.col("doc_id"))),
        recipes.withColumn("digests", F.concat(F.substring("digests", 17, 1 << 30), F.substring("digests", 1, 16))),
        recipes.where("start > 0"),
    ]
    for i, changed in enumerate(changes):
        other = f"file://{tmp_path}/other{i}"
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{other}/chunks")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
        changed.write.parquet(f"{other}/recipes")
        with pytest.raises(Exception, match="agree|root"):
            id_store.read_digests(spark, other)


def test_id_store_of_nothing(spark, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = f"file://{tmp_path}/store"
    id_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path, spec, end_id=2)
    assert id_store.read_digests(spark, path).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49_000, 40_000).astype(np.uint32)
    a = id_store.cuts(ids)
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= id_store.MOST and min(np.diff([0, *a])[:-1]) >= id_store.LEAST
    moved = id_store.cuts(np.concatenate([rng.integers(0, 49_000, 777).astype(np.uint32), ids]))
    assert len({x - 777 for x in moved} & set(a)) > 0.8 * len(a)
    assert id_store.cuts(ids[:0]) == [] and id_store.cuts(ids[:1]) == [1]


def test_crc_of_joined_parts():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4") for n in (1, 5, 300, 4096)]
    crc = np.zeros(1, np.uint32)
    for p in parts:
        crc = id_store.combine_crc(crc, np.array([zlib.crc32(p.tobytes())]), np.array([len(p)]))
    assert int(crc[0]) == zlib.crc32(np.concatenate(parts).tobytes())


def brute_code_length(model_counts, language, text, order=3, least=language_id.LEAST):
    """PPM by its definition, from raw counts, for texts of known bytes."""
    trees = {}
    weight = {}
    for lang, context, symbol, times in model_counts:
        trees.setdefault(lang, {}).setdefault(context, {})[symbol] = times
    for tree in trees.values():
        for c, row in tree.items():
            weight[c] = max(weight.get(c, 0), sum(row.values()))
    nodes = {c for c in weight if not c or weight[c] >= least}
    nodes = {c for c in nodes if all(c[i:] in nodes for i in range(len(c) + 1))}
    tree = trees[language]
    known = {s for _, _, s, _ in model_counts}

    def chance(context, symbol):
        lower = (lambda s: chance(context[1:], s)) if context else (lambda s: 1 / 256)
        row = tree.get(context, {})
        if sum(row.values()) < (least if context else 1):
            return lower(symbol)
        n, q = sum(row.values()), len(row)
        rest = 1 - sum(lower(s) for s in row) if context else (256 - q) / 256
        if symbol in row:
            return row[symbol] / (n + q)
        return q / (n + q) * lower(symbol) / rest

    total = 0.0
    for i, s in enumerate(text):
        assert s in known
        context = text[max(0, i - order) : i]
        while context not in nodes:
            context = context[1:]
        total -= np.log2(chance(context, s))
    return total


def test_ppm_code_lengths_are_exact():
    import pyarrow as pa

    texts = [("a", "the cat sat on the mat and the hat " * 6), ("b", "le chat est sur le tapis et le toit " * 6)]
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts])], ["language", "text"])
    counts = []
    for out in language_id._count_contexts(iter([batch])):
        for lang, code, times in zip(*(c.to_pylist() for c in out.columns), strict=True):
            order = code >> 40
            counts.append((lang, bytes((code >> (8 * b)) & 255 for b in range(order, 0, -1)), code & 255, times))
    model = language_id.compile_model(counts)
    raw = [b"the mat", b"sur le toit", b"t", b""]
    got = model.code_lengths(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(raw):
        for k, lang in enumerate(["a", "b"]):
            assert got[i, k] == pytest.approx(brute_code_length(counts, lang, t), abs=1e-3)
    every = model.bits.reshape(2, -1, model.width).astype(float)
    copies = np.ones(model.width)
    copies[-1] = 256 - (model.width - 1)
    assert np.allclose((np.exp2(-every) * copies).sum(2), 1, atol=1e-5)


def test_language_id_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_id_odd_rows(spark):
    rows = [(1, "the cat and the dog and the bird", "en"), (2, "le chat et le chien et la maison", "fr"), (3, None, "en"), (4, "", None), (5, "1234 ...", "en"), (6, "ώ", None), (6, "ώ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumnRenamed("score", "lang").withColumn("score", F.lit("clash"))
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0
    assert got[6].lang_pred in ("en", "fr") and got[1].lang_pred == "en" and got[2].lang_pred == "fr"
    empty = docs.limit(0)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # some hundred labels; the smallest tables have a handful of toxic ones
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = toxicity.predict(docs, toxicity.fit(docs, half)).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").collect()
    # the half that is learned from has 16 toxic rows; other languages' words occur in one or two of them
    bad = [r for r in got if r.y and r.lang == "en"]
    assert len(bad) > 10
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad)  # 3 of the 26 hold no word that occurs in a toxic row of the other half
    assert sum(r.toxic for r in got if not r.y) <= 0.02 * sum(not r.y for r in got)


def test_ordinal_model_orders_grades_and_cuts():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        bad = rng.choice(8, g * 2, replace=False)
        rows.append(np.unique(np.concatenate([bad, 8 + rng.choice(40, 12, replace=False)])))
        grades.append(g)
    model = toxicity.fit_ordinal(rows, np.array(grades), np.arange(48))
    assert (np.diff(model.cuts) >= 0).all()
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    score = np.array([toxicity._sigmoid(sum(weight.get(int(w), 0) for w in r) - model.cuts).sum() for r in rows])
    assert np.corrcoef(score, grades)[0, 1] > 0.95


def test_toxicity_drops_only_equal_word_sets(spark, monkeypatch):
    """Texts that share all words but one are rows of their own; equal word sets count once."""
    common = " ".join(f"w{i}" for i in range(200))
    texts = [f"{common} x{i}" for i in range(40)] + [f"x0 {common} X0"] + [f"plain y{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i <= 40)) for i in range(81)], "doc_id long, toxic int")
    seen = []
    screen = toxicity.screen
    monkeypatch.setattr(toxicity, "screen", lambda sample, n1, n0: seen.append((n1, n0)) or screen(sample, n1, n0))
    toxicity.fit(docs, labels)
    assert seen == [(40, 40)]


def test_screen_prefers_words_of_positive_rows(spark):
    rows = [(1, [1, 2]), (1, [1]), (1, [1, 3]), (1, [3])] * 5 + [(0, [4, 5, 2]), (0, [4, 5]), (0, [4, 5]), (0, [4, 5, 3])] * 5
    got = toxicity.screen(spark.createDataFrame(rows, "grade long, words array<long>"), 20, 20, features=2).collect()
    assert [r.word for r in got] == [1, 3]


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 7, 100, 100, 100, 500, 1023, 1024, 1025, 3000, 5000]) for _ in range(700)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(5000, None)], "doc_id long, n long").repartition(4)
    got = packing.pack(df, "n", capacities=(512, 1024, 2048)).collect()
    total, bins = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.piece_length
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert total == {**dict(enumerate(sizes)), 5000: 0}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.piece_length
        assert {(r.bin_fill, r.bin_capacity) for r in held} == {(at, min(c for c in (512, 1024, 2048) if c >= at))}
    assert sum(total.values()) / sum(h[0].bin_capacity for h in bins.values()) > 0.97
    assert packing.pack(df.limit(0), "n").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "n", capacities=())


def test_plan_is_best_fit():
    plan = packing.plan_bins({7: 1, 6: 1, 3: 1, 4: 1}, (10,), lambda c: float(c))
    fills = sorted(plan.bin_fill.tolist())
    assert fills == [10, 10]


def test_new_bins_are_judged_by_all_lengths_to_come():
    """One piece of each length up to 100 fills a bin of 4,096 almost whole; at little cost a token it must not look empty."""
    lengths, counts = np.arange(1, 101), np.ones(100, np.int64)
    counts[-1] = 0
    cost = {512: 1.05 * 512, 4096: 1.02 * 4096}.get
    assert packing._open_size(100, [512, 4096], cost, lengths, counts) == 4096
    plan = packing.plan_bins(dict.fromkeys(range(1, 101), 1), (512, 4096), cost)
    assert plan.bin_capacity.max() == 4096 and plan.bin_fill.sum() == 5050


def test_warc_round_trip(spark, sf_dir, tmp_path):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "http://é", "é" * 5000), (9, "v", "<p>x</p>"), (9, "v", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    index = spark.read.parquet(warc.write_archives(pages, path))
    got = sorted(warc.read_records(spark, path, index, payloads=True).collect(), key=lambda r: r.page_id)
    keeper = {"<p>x</p>": 9, "": 4, "é" * 5000: 5}
    for r, (page, _, html) in zip(got, rows, strict=True):
        data = (html or "").encode()
        best = keeper[html or ""]
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == best else ("revisit", best))
        assert bytes(r.payload) == (data if page == best else b"")
    some = warc.read_records(spark, path, index.where("page_id in (2, 5)"))
    assert sorted(r.page_id for r in some.collect()) == [2, 5]
    ranges = warc.coalesce_ranges(index.where("page_id <> 5"), gap=0).groupBy("archive", "range").count()
    assert ranges.count() <= index.count()
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0
