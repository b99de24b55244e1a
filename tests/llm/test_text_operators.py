"""Whitening, spelling variants and main text against brute force on small tables with awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.htmltext import LEAST_PAGES, Walk, extract_text, main_text, templates
from tessera.llm.spelling import edited, group_variants, near_words, neighbourhood, word_hashes
from tessera.llm.whitening import exact_deviation, find_components, whiten
from tests.llm.conftest import rows

# --- 11 whitening


def vectors(n=60, d=6):
    r = random.Random(3)
    good = [[r.gauss(0, 1) * (1 + j) for j in range(d)] for _ in range(n)]
    return [(i, v, "x") for i, v in enumerate(good)] + [(7, good[7], "y"), (None, good[3], None), (100, None, "z"), (101, [], "z"), (102, [1.0] * (d - 1) + [None], "z"), (103, [1.0] * (d - 1) + [float("nan")], "z"), (104, [1.0] * (d - 1) + [float("inf")], "z"), (105, [1.0] * (d + 3), "z")]


SCHEMA = "vec_id long, embedding array<float>, component string"


def fitted(rows, d=6):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, e[::-1], u[:, ::-1]


def test_whitening(spark):
    data = vectors()
    got = whiten(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    x, n, s, c, e, u = fitted(data)
    assert {r["n"] for r in got} == {n == 62 and 62} and len(got) == 62 * 6
    assert Counter(r["vec_id"] for r in got)[7] == 12 and Counter(r["vec_id"] for r in got)[None] == 6
    w = c @ u / np.sqrt(e)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(6):
        sign = np.sign(by[(0, j + 1)]["whitened"] * w[0, j])
        assert all(abs(by[(i, j + 1)]["whitened"] - sign * w[i, j]) < 1e-9 for i in range(60))
        assert abs(by[(0, j + 1)]["explained"] - e[j] / e.sum()) < 1e-12
    assert all(by[(i, 1)]["deviation"] == sum(int(v) ** 2 for v in n * x[i] - s) for i in range(60))
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_little(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], SCHEMA)).collect() == []
    few = whiten(spark.createDataFrame([(1, [1.0, 2.0, 5.0], None), (2, [3.0, 2.0, 1.0], None), (3, [0.0, 9.0, 1.0], None)], SCHEMA)).collect()
    assert {r["component"] for r in few} == {1, 2}


def spectrum(values, seed=5):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [np.array([2.0**-i for i in range(80)]), np.linspace(2, 1, 80), np.array([5.0] * 3 + [1.0] * 77)])
def test_components(values):
    """A steep spectrum is found in a narrow range; flat ones and ties make the range grow to all dimensions."""
    v, sizes = spectrum(values), []

    def apply(q):
        sizes.append(q.shape[1])
        return v @ q

    got, u = find_components(apply, 80, 5)
    assert np.allclose(got, np.sort(values)[::-1][:5], rtol=1e-12)
    assert np.abs(v @ u - u * got).max() < 1e-11 and np.abs(u.T @ u - np.eye(5)).max() < 1e-12
    assert (max(sizes) == 80) == (values[40] > 1e-3)


def test_deviation_is_exact():
    x = np.array([[3_000_000_000, 1], [0, 0], [5, 9]])
    s = x.sum(axis=0)
    want = [sum((3 * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]
    assert exact_deviation(x, 3, s) == [w if w < 2**63 else None for w in want] and want[0] > 2**63


# --- 12 spelling variants


def variants(texts):
    """The contract again, by comparing all pairs of words."""
    c = Counter()
    for doc, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    v = {w: n for w, n in c.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: sorted((x for x in v if near(w, x)), key=lambda x: (-v[x], x)) for w in v}
    form = {w: f[0] if f and v[f[0]] >= 2 * v[w] else None for w, f in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), v[w], len(found[w]), v[form[w]] if form[w] else None) for w in v}


def spelling_texts():
    r = random.Random(8)
    base = ["colour", "straße", "élèves", "aaaaaa", "receive", "Mississippi", "ÀÉÎÕÜ"]
    out = []
    for i in range(120):
        w = r.choice(base[: 1 + i % 7])
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeiousé") + w[k:], w[:k] + r.choice("aeiousé") + w[k + 1 :], w, w])
        out.append((i % 40 if i % 11 else None, f"{w} {w}, {w.upper()} and {w}-x"))
    return out + [(1, None), (2, ""), (3, "12 34"), (4, "word " * 30_000), (4, "word " * 30_000)] + [(200 + i, "colour colours colou kolour " * (5 - i)) for i in range(4)]


def test_spelling(spark):
    texts = spelling_texts()
    df = spark.createDataFrame([(*t, "w", 1) for t in texts], "doc_id long, text string, word string, n int").repartition(3)
    want = variants(texts)
    assert len(want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    assert {tuple(r) for r in group_variants(df).collect()} == want


def test_spelling_of_common_rows(spark, docs, empty):
    assert {tuple(r) for r in group_variants(docs).collect()} == variants([(r[0], r[1]) for r in rows()])
    assert group_variants(empty).collect() == []
    with pytest.raises(ValueError):
        group_variants(docs, ratio=1)


def test_neighbourhoods_are_full_and_distinct():
    alphabet = "abé"
    codes = np.array([ord(c) for c in alphabet], np.uint32)
    for word in ("aab", "ééé", "abéab"):
        made = []
        for kind, at, hashes, out in neighbourhood(np.array([[ord(c) for c in word]], np.uint32), codes):
            for letter in range(hashes.shape[1]):
                if not out[0, letter]:
                    made.append(edited(word, kind, at, alphabet[letter]))
                    assert word_hashes(np.array([[ord(c) for c in made[-1]]], np.uint32))[0] == hashes[0, letter]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
        assert len(made) == len(set(made)) and set(made) == want - {word}


def test_vocabulary_in_slices(spark):
    """A filter that is too small for all words changes nothing: they are dealt into slices."""
    words = spark.createDataFrame([(f"{a}{b}lmn{c}",) for a in "abcdef" for b in "abcdef" for c in "abcdef"], "word string")
    one, many = ({tuple(r) for r in near_words(words, bits).collect()} for bits in (1 << 27, 500))
    assert one == many and len(one) == 216 * 15


# --- 13 main text


def page(i, boxes, text):
    """A page of a host whose names tell nothing: a menu of links, a notice, the article, a list of links, a footer."""
    links = "".join(f'<li><a href="/{k}">link {i} {k}</a></li>' for k in range(3 + i % 4))
    body = "".join(f"<p>{t}</p>" for t in text)
    return f'<html><head><title>t{i}</title></head><body><div class="{boxes[0]}"><ul>{links}</ul></div><div class="{boxes[1]}">We value your privacy. Accept all</div><div class="{boxes[2]}"><h2>Head {i}</h2>{body}</div><div class="{boxes[3]}">All rights reserved</div></body></html>'


def article(i):
    r = random.Random(i)
    return [" ".join(f"w{r.randrange(500)}" for _ in range(20)) for _ in range(1 + i % 3)]


def test_template_finds_the_slot_without_names(spark):
    plain = [(i, f"http://plain.example/{i}", page(i, ("x1", "x2", "x3", "x4"), article(i)), "p") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(plain, "page_id long, url string, html string, host string").repartition(3)).collect()}
    assert got == {i: "\n".join([f"Head {i}", *article(i)]) for i in range(12)}


CASES = [
    ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>x</b><i>y</i></article>", "A & B\none two three\nfour xy"),
    ("<nav>n</nav><main><p>in <script>var x='</p>'</script>side</p><aside>no</aside><form>no</form></main><footer>f</footer>", "in side"),
    ('<div class="content"><p>yes</p><div class="cookie-notice">no</div><section id="comments"><article class="comment">no</article></section></div><div id="sidebar">no</div>', "yes"),
    ('<article><div class="entry-header"><h1>h</h1></div><p>t</p><div class="share">no</div></article><header>no</header>', "h\nt"),
    ('<div class="text-center">a headline</div><p>' + "long plain article " * 9 + '</p><span class="main-icon">x</span><div class="header">no</div>', "a headline\n" + ("long plain article " * 9).strip() + "\nx"),
    ('<main><p>yes</p><div hidden>no</div><p style="display: none">no</p><i aria-hidden="true">no</i><p data-hidden="x" title="hidden gems">too</p></main>', "yes\ntoo"),
    ("<p>no end <b>of tags", "no end of tags"),
    ("plain &lt;text&gt; only", "plain <text> only"),
    ("<article>a<!-- no -->b<!-- no", "ab"),
    ("<article><p>x</article", "x"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ('<article><header class="top"><h1>h</h1></header><p>t &nbsp; u</p></article>', "h\nt u"),
    ("", ""), (" \n ", ""), ("< 3 and > 2", "< 3 and > 2"), ("<title>t</title>", ""),
    ("<article><p title=\"a>b\">q</p><p title='x>q2</p></article>", "q\nq2"),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_page_alone(html, want):
    assert main_text(html, None) == want


def awkward_pages():
    rows = [(i, f"http://h.example/{i}", f"<html><body><nav>m {i}</nav><article><h1>T{i}</h1><p>same line</p><p>own {i}</p></article><footer>f</footer></body></html>", "x") for i in range(8)]
    rows += [(8, "http://h.example/8", None, "x"), (9, None, "<p>nine</p>", None), (None, "http://h.example/8", rows[0][2], "x"), (0, *rows[0][1:]), (10, "no url", "", "x"), (11, "http://few.example/", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "x"), (12, "http://H.example:80/", "<div>cut", "x")]
    return rows + [(20 + i, "http://copies.example/", "<article><p>all alike</p></article>", "x") for i in range(30)]


def test_awkward_pages(spark):
    rows = awkward_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = Counter()
    for i, url, html, _ in rows:
        text = "\n".join(re.sub("<[^>]*>", "", b) for b in re.findall(r"<(?:h1|p)>.*?</(?:h1|p)>", html or ""))
        want[(i, url, "cut" if i == 12 else text)] += 1
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert extract_text(df.limit(0)).collect() == []


def test_classes_must_be_ordered_and_nested():
    def broken(classes, *tokens):
        w = Walk(classes)
        for t in tokens:
            w.step(t)
        w.end()
        return w.broken

    assert broken([[1, 2, 3], [4, 5]], 1, 4, 5, 4, 5, 2, 3) == set()
    assert broken([[1, 2, 3], [4, 5]], 1, 3, 2) == {0}
    assert broken([[1, 2, 3], [4, 5]], 1, 4, 2, 5, 3) == {1}
    assert broken([[1, 2, 3], [4, 5]], 1, 4, 5, 2, 4, 5, 3) == {1}
    assert broken([[1, 2]], 1, 1, 2) == {0} and broken([[1, 2]], 2) == {0} and broken([[1, 2]], 1) == {0}


def test_template_needs_pages(spark):
    from tessera.llm.htmltext import _SKELETON, _skeletons

    def hosts(n):
        df = spark.createDataFrame([("h", page(i, "abcd", article(i))) for i in range(n)], "host string, html string")
        return templates(df.mapInArrow(_skeletons, _SKELETON))[0].count()

    assert [hosts(LEAST_PAGES - 1), hosts(LEAST_PAGES)] == [0, 1]


def test_the_shared_folder_is_asked_for():
    from tessera.llm.common import shared_dir

    class cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
