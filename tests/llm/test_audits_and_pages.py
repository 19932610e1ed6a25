"""The two audits by brute force, and page texts on held-out labelled pages and on odd markup."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from tessera.llm import divergence_audit, filter_audit, html_text

DOCS = "doc_id long, text string, lang string, source string, quality string, rank int, n long"
LABELS = "doc_id long, quality int, toxic int"


# -- filter audit ---------------------------------------------------------------------------------------------------------


def brute_filters(docs, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, t in ((r[0], r[1] or "") for r in docs) if t == text and j is not None and i is not None and j < i]
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": bool(same),
        }

    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    rows = [(r[3] or "", r[0], fails(r[0], r[1] or "")) for r in docs]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in rows}:
        own = [(i, f) for p, i, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                kept = [(i, f) for i, f in left if not f[x]]
                out[part, order, step] = (
                    len(kept), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
                shapley[part, x] += len(gone)
                left = kept
    return {(k, v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(set(got))
    return {((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost), r.shapley) for r in got}


def test_filter_audit_is_the_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long, long + " #", long.upper(), "same " * 300, "", None, "Short TEXT", "a|b", long + " é", "x" * 30_000, " ".join(f"Aé{i}" for i in range(220)), long]
    docs = [(i, t, "en", ["s", "t", None, ""][i % 4], "q", 1, 2) for i, t in enumerate(texts)]
    docs += [(None, long, "en", "s", "q", 1, 2), (None, long, "en", "t", "q", 1, 2), (0, long, "en", "s", "q", 1, 2), (0, "other", "en", "s", "q", 1, 2), (20, "", "de", "only", "q", 1, 2), docs[3], docs[3]]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, None, 0), (3, 1, None), (None, 1, 1), (7, 1, 0), (99, 1, 1), (20, 1, 1), (0, 0, 0)]
    assert audited(spark, docs, labels) == brute_filters(docs, labels)
    assert audited(spark, docs, []) == brute_filters(docs, [])


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == set()


def test_all_steps_of_an_order_add_up(spark):
    docs = [(i, "Word " * (i % 300), "en", "s", "q", 1, 2) for i in range(40)]
    rows = audited(spark, docs, [])
    assert len(rows) == 600
    for order in map("".join, permutations("ABCDE")):
        steps = sorted(((k[2], v) for k, v, _ in rows if k[1] == order))
        assert sum(v[1] for _, v in steps) + steps[-1][1][0] == 40


# -- divergence audit -----------------------------------------------------------------------------------------------------


def brute_divergence(docs, least=30, k=50):
    rows = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in docs]
    out = set()
    for lang in {x[0] for x in rows}:
        held, total = Counter(), Counter()
        groups = {s: Counter() for l, s, _ in rows if l == lang}
        for _, s, ts in (x for x in rows if x[0] == lang):
            held.update(set(ts))
            total.update(ts)
            groups[s].update(ts)
        kept = sorted(t for t, n in held.items() if n >= least)

        def probabilities(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        q, p = probabilities(total), {s: probabilities(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in groups if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, r) for r, (item, v) in enumerate(found[:most], 1)}
    return out


def diverged(spark, docs, **more):
    model = divergence_audit.audit(spark.createDataFrame(docs, DOCS), **more)
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in model.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(n=400):
    """Sources of one language with their own words, a shared stop word, ties, nulls and a very long term."""
    words = [f"Word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    docs = []
    for i in range(n):
        source = [None, "", "a", "b", "hot", "hot", "hot", "é"][i % 8]
        lang = ["en", "en", None, "de"][i % 4]
        text = " ".join(["the"] * (i % 7) + [words[(i * j + j) % 150] for j in range(1, 60)] + ["über", "x1y", "l'été"] * (i % 3))
        docs.append((i, text if i % 37 else None, lang, source, "q", 1, 2))
    docs += [(1, "", "en", "empty", "q", 1, 2), (2, "12 34 --", "en", "no letters", "q", 1, 2), (3, "Z" * 40_000, "en", "long", "q", 1, 2), (4, "rare", "xx", "lone", "q", 1, 2), (5, "rare", "xx", "other", "q", 1, 2)]
    return docs + docs[:5]


def test_divergence_audit_is_the_brute_force(spark):
    docs = corpus()
    assert diverged(spark, docs) == brute_divergence(docs)


@pytest.mark.parametrize("k", [1, 3, 400])
def test_search_opens_enough_buckets(spark, k):
    docs = corpus(300)
    got = {r for r in diverged(spark, docs, k=k) if r[2] == "term"}
    assert got == {r for r in brute_divergence(docs, k=k) if r[2] == "term"}


def test_divergence_of_nothing(spark):
    assert diverged(spark, []) == set()
    assert diverged(spark, [(1, None, None, None, None, None, None)]) == set()  # one group, no other source, no kept term


# -- page texts -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_text.fit(html_text.labelled_pages())


def test_held_out_pages(model):
    """Blocks of pages that were not learned from: nearly all of the main text, and nearly nothing else."""
    right = found = wanted = 0
    for page in html_text.labelled_pages(150, seed=77):
        blocks, tags = html_text.leaf_blocks(page)
        parts = model.decode(html_text.features(blocks, tags))
        for b, p in zip(blocks, parts, strict=True):
            right += p == 0 and b.part == "article"
            found += p == 0
            wanted += b.part == "article"
    assert right >= 0.98 * found and right >= 0.98 * wanted


def test_viterbi_is_the_best_of_all_sequences(model):
    from itertools import product

    blocks, tags = html_text.leaf_blocks("<nav><a>Home</a></nav><article><h1>T</h1><p>Some text here.</p></article><footer>©</footer>")
    said = html_text.features(blocks, tags)
    scores = model.scores(said)

    def value(path):
        return model.start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False))

    assert value(model.decode(said)) == pytest.approx(max(map(value, product(range(len(html_text.PARTS)), repeat=len(said)))))


def test_parts_around_and_inside_an_article(model):
    page = """<html><body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><header><h1>Site name</h1></header>
    <nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><h1>The &eacute;t&eacute;</h1><p>First  line<br>and &lt;more&gt;.</p><div class="ad">Buy this now.</div>
    <p>Second&nbsp;paragraph.</p><script>var x = "<p>no</p>";</script><style>p{}</style><form><label>Mail</label><button>Subscribe</button></form></article>
    <section id="comments"><div class="comment"><p>Someone says:</p><p>I liked it a lot.</p></div></section><aside class="sidebar"><h3>Related</h3><ul><li><a>Other story</a></ul></aside>
    <footer>&copy; 2024 Site</footer></body></html>"""
    assert html_text.main_text(page, model) == "The été\nFirst line and <more>.\nSecond paragraph."


def test_odd_markup(model):
    text = html_text.main_text
    assert text(None, model) == text("", model) == text("<script>x", model) == ""
    assert text("<nav><a>Home</a></nav>", model) == ""
    assert text("<article><p>One<p>Two <b>bold<p>Three</article><footer>&copy; x</footer>", model) == "One\nTwo bold\nThree"
    assert text("<article><p>Cut off he", model) == "Cut off he"
    assert text("<article><p>A &amp b &quot;c&quot; &#233; &unknown; &am</p></article>", model) == 'A & b "c" é &unknown; &am'
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", model) == "a\nb\nc\nd"
    assert text("<article><p>x</p><!-- <p>no</p> --><p>y</p></div></span></article>", model) == "x\ny"
    deep = "<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p>after</p></article>"
    assert text(deep, model).startswith("deep")
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a long page.</p>" for i in range(3000)) + "</article>"
    assert text(long, model).count("\n") == 2999


def test_extract_keeps_columns_and_rows(spark, model):
    rows = [(1, "u", "<article><p>Text.</p></article>", "clash", 5), (1, "u", "<article><p>Text.</p></article>", "clash", 5), (None, None, None, None, None), (3, "v", "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, other int")
    got = [tuple(r) for r in html_text.extract(pages, model).select("page_id", "url", "text", "n_chars", "other").collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "Text.", 5, 5), (1, "u", "Text.", 5, 5), (None, None, "", 0, None), (3, "v", "", 0, 1)], key=str)
    assert html_text.extract(pages.limit(0), model).count() == 0


def test_given_pages(spark, sf_dir, model):
    """The tables' pages: all of the article element, nothing from outside of it."""
    from html import unescape

    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        return "\n".join(x for x in blocks if x)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_text.extract(pages, model).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


# -- columns of any name --------------------------------------------------------------------------------------------------


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    """Columns named as those that stages use within come out as they went in."""
    import corpus_pipeline

    odd = ["__id", "__key", "__spans", "__toxic", "__severity", "__grade", "__lang", "__score", "__bits", "n_words", "n_removed"]
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [f"{passage} first tail of the text", f"another start {passage}", "the cat sat on the mat and slept", "the dog ran to the park and barked", None]
    rows = [(i, t, "en", "s", len(t or ""), *([f"own{i}"] * len(odd))) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in odd)
    spark.createDataFrame([(i, 1, i % 2) for i in range(2, 4)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        assert all(r[c] == f"own{r.doc_id}" for r in out.collect() for c in odd), name
    deduped = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert deduped[1] == "another start" and deduped[0] == texts[0]
