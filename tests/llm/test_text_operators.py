import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orthospark.llm import cotrain, html_extract, lm_score, packing, pii, piece_nbest, quality_rules, word_bpe

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules


def slow_counts(text):
    w = WORDS.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#*\x0b\x1c ", max_size=80))
def test_counts_match_the_definition(text):
    t = quality_rules.Text(text)
    assert (t.n_words, t.word_chars, t.n_symbols, t.dup_lines(), t.repeat_words()) == slow_counts(text)


def test_quality_rules_table(corpus, empty):
    got = quality_rules.quality_rules(corpus, sample_rows=20).collect()
    want = Counter((r.doc_id, *slow_counts(r.text or "")) for r in corpus.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.rejected_by is None)
    assert quality_rules.quality_rules(empty).count() == 0


def test_order_doesnt_change_the_verdict():
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}!!" for i in range(60)), " ".join(f"w{i}###" for i in range(60))]
    assert sorted(quality_rules.estimate_order(texts)) == sorted(quality_rules.RULES) and quality_rules.estimate_order([]) == list(quality_rules.RULES)
    verdicts = [{n for n, r in quality_rules.RULES.items() if r(quality_rules.Text(t), 0)} for t in texts]
    assert verdicts[0] == set() and "exclamation" in verdicts[1] and "symbols" in verdicts[2]


# ---- html


def test_article_is_extracted():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Top</header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><div class=ad>Buy now</div><article><h1>Head &amp; line</h1><p>First <b>para</b>graph\n of   text.<br>More"
        "<p>Second &lt;one&gt; here.</p><div class='advert'>again</div></article><aside>Side</aside><section id=comments><p>I disagree with all of it</p></section>"
        "<form><p>Mail</p><input></form><footer>&copy; x</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & line First paragraph of text. More Second <one> here."


def test_page_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} with enough words to be dense and <a href=x>a link</a> inside.</p>" for i in range(5))
    page = f"<body><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul><div id=content><div>{body}</div><div><h2>Part</h2>{body}</div></div><div class=sidebar>{body}</div></body>"
    one = " ".join(f"Paragraph {i} with enough words to be dense and a link inside." for i in range(5))
    assert html_extract.main_text(page) == f"{one} Part {one}"


def paragraphs(name, n):
    return [f"{name} paragraph {i} has enough words in it to be as dense as any other text of this page." for i in range(n)]


def test_sibling_articles_are_all_extracted():
    for sizes in ((4, 4), (5, 2), (2, 6, 3)):
        texts = [paragraphs(f"Story{k}", n) for k, n in enumerate(sizes)]
        page = "".join(f"<article><h2>Title {k}</h2>" + "".join(f"<p>{t}</p>" for t in ts) + "</article>" for k, ts in enumerate(texts))
        want = " ".join(f"Title {k} " + " ".join(ts) for k, ts in enumerate(texts))
        assert html_extract.main_text(f"<body><nav>Menu</nav><div>{page}</div><footer>x</footer></body>") == want


def test_text_beside_an_article_is_extracted():
    one, two = paragraphs("First", 4), paragraphs("Second", 4)
    ps = ["".join(f"<p>{t}</p>" for t in ts) for ts in (one, two)]
    assert html_extract.main_text(f"<body><article>{ps[0]}</article><section>{ps[1]}</section></body>") == " ".join(one + two)


def test_main_with_extra_blocks():
    one, two = paragraphs("First", 4), paragraphs("Second", 2)
    ps = ["".join(f"<p>{t}</p>" for t in ts) for ts in (one, two)]
    page = f"<body><main><h1>Title</h1><p>Lead.</p><article>{ps[0]}</article><section>{ps[1]}</section></main><footer>x</footer></body>"
    assert html_extract.main_text(page) == " ".join(["Title Lead.", *one, *two])
    cards = "".join(f"<article><a href=x>Story {i}</a><p>Teaser {i}.</p></article>" for i in range(3))
    assert html_extract.main_text(f"<body><article><h1>Title</h1>{ps[0]}</article><div>{cards}</div></body>") == " ".join(["Title", *one])


def slow_main(tree):
    """The text of the selected subtree of (tag, kids) trees in a body, by the definition, each node on its own."""
    nodes = []

    def walk(t, up):
        here = {"tag": t[0], "up": up, "kids": []}
        nodes.append(here)
        here["kids"] = [k if isinstance(k, str) else walk(k, here) for k in t[1]]
        return here

    def below(x):
        return [z for k in x["kids"] if not isinstance(k, str) for z in (k, *below(k))]

    def chars(x):
        return sum(len("".join(k.split())) if isinstance(k, str) else chars(k) for k in x["kids"])

    def linked(x):
        return chars(x) if x["tag"] == "a" else sum(linked(k) for k in x["kids"] if not isinstance(k, str))

    def density(x):
        c, t, lc, lt = chars(x), len(below(x)), linked(x), sum(z["tag"] == "a" for z in below(x))
        lt = t if x["tag"] == "a" else lt
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked(body) / chars(body) * c + math.e)
        inner = math.log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1.0))
        return c / (t or 1) * inner / math.log(max(base, 1 + 1e-9)) if base > 1 else c / (t or 1) * inner / 1e-9

    def total(x):
        return sum(density(k) for k in x["kids"] if not isinstance(k, str))

    def path(x):
        return [x] + (path(x["up"]) if x["up"] else [])

    def raw(x):
        return "".join(k if isinstance(k, str) else f" {raw(k)} " if k["tag"] in html_extract.BLOCK else raw(k) for k in x["kids"])

    def text(x):
        return " ".join(raw(x).split())

    body = walk(("body", tree), None)
    wide = [body]
    for x in wide:
        wide += [k for k in x["kids"] if not isinstance(k, str)]
    best = max(wide, key=total)
    if total(best) <= 0:
        return text(body)
    least = min(density(x) for x in path(best))
    held = [best]
    for x in nodes[1:]:
        if density(x) >= least and x["tag"] in html_extract.BLOCK and chars(x) > 2 * linked(x):
            top = max([x, *below(x)], key=total)
            held.append(top if total(top) > 0 else x)
    return text(next(x for x in path(best) if all(any(z is x for z in path(y)) for y in held)))


def test_selection_matches_a_direct_version():
    rng = random.Random(8)
    words = "river stone cloud walks under light again some words of text".split()

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["div", "p", "a", "section", "span"] if depth else ["p", "a", "text"])
            phrase = " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + " "
            if kind == "text":
                out.append(phrase)
            elif kind in ("p", "a", "span"):
                out.append((kind, [phrase] + ([("a", [" link "])] if kind == "p" and rng.random() < 0.3 else [])))
            else:
                out.append((kind, tree(depth - 1)))
        return out

    def markup(kids):
        return "".join(k if isinstance(k, str) else f"<{k[0]}>{markup(k[1])}</{k[0]}>" for k in kids)

    compared = 0
    for _ in range(300):
        t = tree(3)
        page = f"<html><body>{markup(t)}</body></html>"
        if not any(html_extract._linked(x) for x in linkable(page)):  # lists of links go, which the direct version doesn't know
            compared += 1
            assert html_extract.main_text(page) == slow_main(t), page
    assert compared > 150


def linkable(page):
    root = html_extract.parse(page)
    html_extract.select(root)
    return [x for x in html_extract._order(root) if x.up is not None and x.tag not in ("body", "html")]


def test_deep_and_hostile_pages_take_linear_time():
    import time

    n = 50_000
    pages = ["<div>" * n + "<p>Some words of text.</p>" + "</div>" * n, "<p>Some words of text." + "</b>" * n, "<div>" * n + "<p>Some words of text.</p>" + "</span>" * n,
             "<p>Some words of text.</p>" + "<i>" * n + "<h2></h2>" * n, "<ul><li><a>x</a><a>y</a><a>z</a></ul>" * 3000 + "<p>Some words of text.</p>", "<p title='x>" * n + "Some words of text."]
    for page in pages:
        began = time.perf_counter()
        assert "Some words of text." in html_extract.main_text(page)
        assert time.perf_counter() - began < 15


def test_open_quotes_and_class_words_leave_the_text():
    assert html_extract.main_text("<p title='x>Some text") == "Some text"
    assert html_extract.main_text("<p title='x>Some text</p><p>More 'quoted' text</p>") == "Some text More 'quoted' text"
    assert html_extract.main_text("<p a=b' c>hello <b title=\"a > b\">you</b></p>") == "hello you"
    for name in ("skip-research", "search", "social", "alert", "reply", "notice"):
        assert html_extract.main_text(f"<section class='{name}'><p>Some text of it.</p></section>") == "Some text of it."


def test_dates_of_all_years_and_more_shapes(spark):
    from pyspark.sql import functions as F

    days = spark.sql("SELECT date_format(d, 'yyyy-MM-dd') AS d FROM (SELECT explode(sequence(date'0001-01-01', date'0199-12-31')) AS d UNION ALL SELECT explode(sequence(date'9800-01-01', date'9999-12-31')))")
    new = [r.p for r in days.select(pii.pseudonym(F.col("d"), "k").alias("p")).collect()]
    assert set(new) == {r.d for r in days.collect()} and len(new) == 145731
    shapes = ["0999-01-01", "9999-12-31", "0200-02-28", "3/7/2021", "13/7/2021", "3.7.2021", "2021-3-7", "555 123 4567", "(555) 123 4567"]
    df = spark.createDataFrame([(i, f"on {s}, so") for i, s in enumerate([*shapes, "31/31/2021", "3/7/21"])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, key="k", found_col="n").collect()}
    for i, s in enumerate(shapes):
        assert got[i].n == 1 and s not in got[i].text
        assert re.sub(r"\d+", "0", got[i].text) == re.sub(r"\d+", "0", f"on {s}, so")
    assert got[len(shapes)].n == got[len(shapes) + 1].n == 0


def test_rules_are_ordered_by_a_sample_of_the_whole_table(spark):
    df = spark.createDataFrame([(i, f"{'late' if i >= 1000 else 'early'} {i}") for i in range(2000)], "doc_id long, text string").coalesce(1)
    seen = [r.text for r in quality_rules.sampled(df, 200).collect()]
    assert 100 < len(seen) <= 200 and min(sum(t.startswith(w) for t in seen) for w in ("early", "late")) > 50


def test_rules_are_measured_in_tasks(spark):
    """A rule that rejects most rows goes first, whichever partitions hold them; without rows the order is that of RULES."""
    plain, loud = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}!!" for i in range(60))
    df = spark.createDataFrame([(i, loud if i % 7 else plain) for i in range(400)], "doc_id long, text string").repartition(6)
    assert quality_rules.measured_order(df, 1000)[0] == "exclamation"
    figures = quality_rules.measure([plain, loud, loud, "short"])
    assert figures["exclamation"][:2] == (3, 2) and figures["symbols"][:2] == (3, 0)
    assert quality_rules.measured_order(df.where("false"), 1000) == list(quality_rules.RULES)
    assert quality_rules.ranked({n: (10, 5, float(k + 1)) for k, n in enumerate(reversed(quality_rules.RULES))}) == list(reversed(quality_rules.RULES))


def test_class_words_dont_cut_the_article():
    ts = paragraphs("Story", 4)
    ps, want = "".join(f"<p>{t}</p>" for t in ts), " ".join(ts)
    for attrs in ("class='site no-sidebar'", "id='page' class='has-header'", "class='layout search-enabled'", "class=widget", "class='post-with-comments'", "class='comments-wrapper'", "id=overlay-root"):
        for tag in ("article", "main", "div"):
            page = f"<body><div class=ad>Buy now</div><div {attrs}><{tag}>{ps}</{tag}><div class=sidebar>Side</div></div><p>x</p></body>"
            if tag != "div" or "comments-" not in attrs:
                assert html_extract.main_text(page).removesuffix(" x") == want, (attrs, tag)
    assert html_extract.main_text(f"<body><section id=comments>{ps}</section></body>") == want  # nothing else is left
    long = "".join(f"<p>{t}</p>" for t in paragraphs("Reader", 9))
    assert html_extract.main_text(f"<body><article>{ps}</article><section id=comments>{long}</section><div class=related>{long}</div></body>") == want


def test_link_lists_of_an_article_stay():
    ts = paragraphs("Story", 4)
    ps = "".join(f"<p>{t}</p>" for t in ts)
    links = "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(4))
    table = "".join(f"<tr><td><a href={i}>Cell {i}</a></td></tr>" for i in range(4))
    want = " ".join([*ts, "Sources", *(f"Source number {i}" for i in range(4)), *(f"Cell {i}" for i in range(4))])
    for tag in ("article", "main", "div"):
        page = f"<body><ul>{links}</ul><{tag}>{ps}<h2>Sources</h2><ul>{links}</ul><table>{table}</table><ul class=menu>{links}</ul></{tag}></body>"
        assert html_extract.main_text(page) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp &;!-=\"' \n", max_size=60))
def test_any_markup_is_tolerated(page):
    out = html_extract.main_text(page)
    assert out == " ".join(out.split())


def test_html_edge_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (3, "v", "<p>a</p>", "z"), (3, "v", "<p>a</p>", "z"), (None, "w", "plain &amp; text", "q"), (5, "l", "<p>" + "word " * 50_000, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = {(r.page_id, r.url, r.text[:20], r.n_chars) for r in html_extract.extract_pages(df).collect()}
    assert got == {(1, "u", "", 0), (2, None, "", 0), (3, "v", "a", 1), (None, "w", "plain & text", 12), (5, "l", ("word " * 4), 249_999)}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# ---- tokens and packing


def test_word_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, ref = word_bpe.WordEncoder(path, most=5), Tokenizer.from_file(path)
    texts = ["", "  ", "It's 12 ab x\x1cy <|endoftext|>b", "ΑΣ Σ İI é é ﬁ ½² <| '' 'S 's don't'LL Straße", "a b\x85c\xa0d", "x " * 5000, "naïve naïve Éa"]
    for _ in range(2):
        for t, raw in zip(texts, enc.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, cap, by_doc):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap.tokens and len(s) <= (cap.documents or cap.tokens)
        assert sum(r.length**2 for r in s) <= (cap.attention or cap.tokens**2)
    return len(seqs)


def test_packing_respects_every_capacity(corpus, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    for cap in (packing.Capacity(), packing.Capacity(tokens=256), packing.Capacity(tokens=128, documents=3, attention=128**2, rule="dot"), packing.Capacity(tokens=128, attention=20_000)):
        rows = packing.pack(corpus, cap=cap, with_ids=True).collect()
        check_packing(rows, cap, None)
        want = Counter()
        for d in corpus.collect():
            ids = ref.encode(d.text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), cap.tokens):
                part = ids[k : k + cap.tokens]
                want[d.doc_id, k // cap.tokens, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    assert packing.pack(empty).count() == 0
    s = packing.sequences(packing.pack(corpus, cap=packing.Capacity(tokens=256), with_ids=True)).collect()
    assert all(len(r.input_ids) <= 256 for r in s)


def test_plan_is_best_fit_and_near_the_bound():
    rng = np.random.default_rng(0)
    x = np.minimum(4096, rng.lognormal(6.3, 1.2, 20_000).astype(int) + 1)
    u, c = np.unique(x, return_counts=True)
    for cap in (packing.Capacity(), packing.Capacity(rule="dot")):
        rows, n = packing.plan(u, c, cap)
        assert n <= math.ceil(x.sum() / 4096) * 1.01 + 1
    # one by one, in the order of decreasing length, into the fullest sequence with room
    small = np.minimum(40, rng.integers(1, 60, 300))
    rooms = []
    for v in sorted(small, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= v]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= v
        else:
            rooms.append(50 - v)
    u, c = np.unique(small, return_counts=True)
    assert packing.plan(u, c, packing.Capacity(tokens=50, weights=(1.0, 0.0, 0.0)))[1] == len(rooms)


def test_vector_plan_matches_one_by_one():
    """Pieces one by one in decreasing length: the open sequence of the best score with room in every component."""
    rng = np.random.default_rng(3)
    for cap in (packing.Capacity(tokens=60, documents=4, attention=900), packing.Capacity(tokens=60, documents=5, attention=1200, weights=(1.0, 0.5, 0.5), rule="dot")):
        x = np.minimum(29, rng.integers(1, 40, 400))
        c, w = cap.vector(), np.array(cap.weights)
        open_, used = [], []
        for v in sorted(x.tolist(), reverse=True):
            p = np.array([v, 1.0, float(v) ** 2])
            best = None
            for i, r in enumerate(open_):
                if (r >= p).all():
                    s = -(w * ((r - p) / c) ** 2).sum() if cap.rule == "norm" else (w * (r / c) * (p / c)).sum()
                    if best is None or s > best[0] + 1e-12:
                        best = (s, i)
            if best is None:
                open_.append(c.copy())
                used.append([])
                best = (0, len(open_) - 1)
            open_[best[1]] -= p
            used[best[1]].append(v)
        u, k = np.unique(x, return_counts=True)
        rows, n = packing.plan(u, k, cap)
        assert n == len(used)
        seqs = {}
        for length, rank, first, slots, _ in rows.tolist():
            later = [r for l, r, *_ in rows.tolist() if l == length and r > rank]
            for t in range((min(later) if later else int(k[u == length][0])) - rank):
                seqs.setdefault(first + t // slots, []).append(length)
        assert sorted(map(sorted, seqs.values())) == sorted(map(sorted, used))
        assert n > packing.plan(u, k, packing.Capacity(tokens=60))[1]  # the other limits bind


# ---- pseudonyms


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(reversed(s))) % 10 == 0


SAMPLES = {
    "mail Ab.72@mail3.example.com, x": r"mail [A-Z][a-z]\.\d\d@mail3\.example\.com, x",
    "4952935900253052$$$ and 1219538112535716.": r"\d{16}\$\$\$ and 1219538112535716\.",
    "4111-1111-1111-1111": r"\d{4}-\d{4}-\d{4}-\d{4}",
    "+1 (487) 555-7209***": r"\+1 \(\d{3}\) \d{3}-\d{4}\*\*\*",
    "ip 169.122.221.182!! 300.1.1.1": r"ip \d+\.\d+\.\d+\.\d+!! 300\.1\.1\.1",
    'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"': r'token = "[0-9A-F]{40}"',
    "1999-12-31 2024-02-30": r"\d{4}-\d{2}-\d{2} 2024-02-30",
    "123-45-6789 000-12-3456": r"\d{3}-\d{2}-\d{4} 000-12-3456",
    "GB82 WEST 1234 5698 7654 32": r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d",
    "version 4.0. of 12 items, 3:45": r"version 4\.0\. of 12 items, 3:45",
}


def test_pseudonyms_keep_formats(spark, empty):
    rows = [(i, t, 5) for i, t in enumerate(SAMPLES)] + [(90, None, 1), (91, "", 1), (92, "x " * 20_000 + "4952935900253052", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_REPLACED int")
    got = {r.doc_id: r for r in pii.pseudonymize(df, key="k", found_col="n_replaced").collect()}
    for i, (t, pattern) in enumerate(SAMPLES.items()):
        assert re.fullmatch(pattern, got[i].text), (t, got[i].text)
        assert (got[i].text == t) == (got[i].n_replaced == 0)
    assert luhn(re.sub(r"\D", "", got[2].text)) and luhn(got[1].text[:16])
    assert (got[90].text, got[91].text) == (None, "") and got[92].text.startswith("x x ") and not got[92].text.endswith("4952935900253052")
    assert got[92].text[-16:] == got[1].text[:16]  # equal values stay linked
    assert pii.pseudonymize(empty, "k").columns == empty.columns
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, key="other").collect()}
    assert other[1] != got[1].text


def test_permutations_are_bijective_and_valid(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(7 * 11).select(pii.permute_pair(F.col("id") % 7, F.floor(F.col("id") / 7), 7, 11, "k", "t").alias("p"))
    assert pairs.select("p.l", "p.r").distinct().count() == 77
    digits = spark.range(1000).select(pii.permute_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert digits.distinct().count() == 1000 and digits.where(~F.col("p").rlike("^[0-9]{3}$")).count() == 0
    days = spark.range(4000).select(F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select(pii.pseudonym(F.col("d"), "k").alias("p"))
    assert new.distinct().count() == 4000 and new.where(F.try_to_date("p").isNull()).count() == 0
    cards = spark.range(500).select(F.lpad((F.col("id") * 7919).cast("string"), 15, "4").alias("b"))
    full = cards.select(F.concat("b", F.pmod(10 - F.pmod(pii.luhn_sum(F.concat("b", F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")).alias("c"))
    out = full.select(pii.pseudonym(F.col("c"), "k").alias("p"))
    assert out.distinct().count() == 500 and all(luhn(r.p) for r in out.collect())


# ---- pseudonyms, by a Feistel network written anew in plain Python


def slow_stream(key, kind, i, other):
    import hashlib

    first = hashlib.sha512("|".join([key, kind, str(i), other]).encode()).hexdigest()
    return first + hashlib.sha512((first + "+").encode()).hexdigest()


def slow_string(core, key, kind, hexadecimal=False):
    a, b = core[: len(core) // 2], core[len(core) // 2 :]

    def add(half, stream):
        out = []
        for i, c in enumerate(half):
            alphabet = "0123456789abcdef" if hexadecimal else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"
            out.append(alphabet[(alphabet.index(c) + int(stream[4 * i : 4 * i + 4], 16)) % len(alphabet)])
        return "".join(out)

    for i in range(8):
        if i % 2 == 0:
            a = add(a, slow_stream(key, kind, i, b))
        else:
            b = add(b, slow_stream(key, kind, i, a))
    return a + b


def slow_pair(x, y, m, n, key, kind):
    import hashlib

    for i in range(8):
        drawn = int(hashlib.sha256("|".join([key, kind, str(i), str(y if i % 2 == 0 else x)]).encode()).hexdigest()[:12], 16)
        if i % 2 == 0:
            x = (x + drawn) % m
        else:
            y = (y + drawn) % n
    return x, y


def refilled(shape, core):
    it = iter(core)
    return "".join((lambda v: v.upper() if c.isupper() else v)(next(it)) if c.isalnum() else c for c in shape)


def slow_pseudonym(kind, v, key):
    import datetime

    plain = "".join(c for c in v if c.isalnum())
    if kind == "email":
        local, rest = v.split("@")
        return refilled(local, slow_string("".join(c for c in local.lower() if c.isalnum()), key, kind)) + "@" + rest
    if kind == "secret":
        out = slow_string(v.lower(), key, kind, True)
        return out.upper() if v != v.lower() else out
    if kind == "phone":
        head = max(len(plain) - 10, 1) if v.startswith("+") else 0
        return refilled(v, plain[:head] + slow_string(plain[head:], key, kind))
    if kind == "card":
        body = slow_string(plain[:-1], key, kind)
        return refilled(v, body + str(next(d for d in range(10) if luhn(body + str(d)))))
    if kind == "iban":
        body = slow_string(plain[4:].lower(), key, kind).upper()
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        return refilled(v, plain[:2] + f"{98 - number % 97:02d}" + body)
    if kind == "ipv4":
        o = [int(x) for x in v.split(".")]
        x, y = slow_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, kind)
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "ssn":
        a, b, c = (int(x) for x in v.split("-"))
        x, y = slow_pair(a - 1 - (a > 666), (b - 1) * 9999 + c - 1, 898, 99 * 9999, key, kind)
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    first = datetime.date(1800, 1, 1)  # a date of a year in whole cycles
    d = (datetime.date.fromisoformat(v) - first).days
    cycle, r = divmod(d, 146_097)
    x, y = slow_pair(r // 773, r % 773, 189, 773, key, kind)
    return (first + datetime.timedelta(days=cycle * 146_097 + x * 773 + y)).isoformat()


def test_pseudonyms_match_plain_python(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = []
    for _ in range(15):
        card = digits(15)
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        body = "WEST" + digits(14)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        values += [
            ("email", f"Ab{digits(2)}.x{digits(3)}@mail.example.com"), ("secret", "".join(rng.choice("0123456789abcdef") for _ in range(40))), ("secret", "".join(rng.choice("ABCDEF") for _ in range(32))),
            ("secret", "".join(rng.choice("abcdef") for _ in range(32))), ("phone", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"), ("card", card + str(next(d for d in range(10) if luhn(card + str(d))))),
            ("ipv4", ".".join(octets)), ("ssn", f"{rng.choice([1, 99, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"), ("date", f"{rng.randint(1000, 2999)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"),
            ("iban", f"GB{check:02d}{body}"),
        ]
    df = spark.createDataFrame([(i, f"{'' if i % 2 else 'a 1 '}so {v} it is") for i, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k", found_col="n").collect()}
    for i, (kind, v) in enumerate(values):
        assert (got[i].n, got[i].text) == (1, f"{'' if i % 2 else 'a 1 '}so {slow_pseudonym(kind, v, 'k')} it is"), (kind, v)
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "")


# ---- co-training


def test_cotraining_separates_held_out_documents(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))) for _ in range(rng.randint(20, 90))]
        text = " ".join(w + ("$$$" if bad else "") for w in words)
        rows.append((i, text, "en", f"src{i % 4}" if i % 3 else "src9", len(text), 3))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    rows += [(900, None, None, None, None, 1), (901, "", "en", None, 0, 1), (902, "word " * 40_000, "fr", "s", 200_000, 1), (902, "word " * 40_000, "fr", "s", 200_000, 1)]
    labels += [(0, None), (None, 1), (2, int(2 % 4 != 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, KEPT int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = cotrain.train(docs, marks, rounds=2, max_pseudo=50)
    got = cotrain.score(docs, model).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id < 400 and r.doc_id % 2]
    right = sum(r.kept == (r.doc_id % 4 != 0) for r in unseen)
    assert right / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    one_class = cotrain.train(docs, marks.where("quality = 1"))
    assert one_class.constant == 1.0 and cotrain.score(docs, one_class).where("kept").count() == len(rows)
    assert cotrain.score(docs.limit(0), cotrain.train(docs.limit(0), marks.limit(0))).count() == 0


def test_bounded_pseudo_labels_keep_the_mix_of_classes(spark, monkeypatch):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "light"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "WIN!!", "###", "click", "0000"]) for _ in range(60))
    rows = [(i, bad() if i % 8 == 0 else good(), "en", f"s{i % 3}", 300) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(200)], "doc_id long, quality int")
    plain = cotrain.fit_logistic
    mixes = []
    for most in (10**6, 40):
        fits = []

        def spy(x, y, *args, counts=None, fits=fits, **kw):
            if counts is not None:
                fits.append((len(y), counts[y == 1].sum(), counts[y == 0].sum()))
            return plain(x, y, *args, counts=counts, **kw)

        monkeypatch.setattr(cotrain, "fit_logistic", spy)
        cotrain.train(docs, marks, rounds=1, max_pseudo=most)
        mixes.append(fits)
    assert sum(n for n, _, _ in mixes[1]) < sum(n for n, _, _ in mixes[0])
    assert np.allclose([f[1:] for f in mixes[0]], [f[1:] for f in mixes[1]])


def test_newton_fit_agrees_with_the_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0).astype(float)
    w = cotrain.fit_logistic(x, y, l2=0.1)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    g = np.append(x.T @ (p - y) + 0.1 * w[:-1], (p - y).sum())
    assert np.abs(g).max() < 1e-2


# ---- language model


def slow_scores(rows):
    docs = [WORDS.findall(t or "") for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = [[grams(w, n) for n in (1, 2, 3)] for w in docs]
    total = [sum((o[n] for o in own), Counter()) for n in range(3)]
    n_all = sum(map(len, docs))
    out = []
    for (i, _), w, o in zip(rows, docs, own):
        c = lambda g: total[len(g) - 1][g] - o[len(g) - 1][g]  # noqa: E731, B023
        s = 0.0
        for k in range(len(w)):
            f = 1.0
            g3, g2 = tuple(w[k - 2 : k + 1]), tuple(w[k - 1 : k + 1])
            if k >= 2:
                if c(g3) > 0:
                    s += math.log(c(g3) / c(g3[:2]))
                    continue
                f *= 0.4
            if k >= 1:
                if c(g2) > 0:
                    s += math.log(f * c(g2) / c(g2[:1]))
                    continue
                f *= 0.4
            s += math.log(f * max(c((w[k],)), 1) / max(n_all - len(w), 1))
        out.append((i, len(w), round(s, 4)))
    return Counter(out)


def test_stupid_backoff_matches_brute_force(corpus, empty):
    want = slow_scores([(r.doc_id, r.text) for r in corpus.collect()])
    for chunk in (50, 3_000_000):  # many chunks, and one
        got = lm_score.score(corpus, chunk_words=chunk).collect()
        assert Counter((r.doc_id, r.n_words, round(r.log_score, 4)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_score.score(empty).count() == 0


def test_count_table_matches_brute_force(corpus):
    total = Counter()
    for r in corpus.collect():
        w = WORDS.findall(r.text or "")
        for n in (1, 2, 3):
            total.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for parts in (1, 7):
        got = lm_score.ngram_counts(corpus, parts=parts).collect()
        assert len({r.hash for r in got}) == len(got)
        assert sorted(r["count"] for r in got) == sorted(total.values())


# ---- pieces


def test_nbest_matches_enumeration():
    v = piece_nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def every(text):
        w = piece_nbest.MARK + text.replace(piece_nbest.MARK, piece_nbest._LITERAL).replace(" ", piece_nbest.MARK)
        out = []

        def walk(s, score, ids):
            if s == len(w):
                out.append((score, ids))
                return
            single = False
            for e in range(s + 1, len(w) + 1):
                if w[s:e] in v.score:
                    single = single or e == s + 1
                    walk(e, score + v.score[w[s:e]], (*ids, v.ids[w[s:e]]))
            if not single:
                walk(s + 1, score + v.unknown, (*ids, *v._bytes(w[s])))

        walk(0, 0.0, ())
        return sorted(out, reverse=True)

    for text in ["", "a b", "the cat", "  x  y", "▁ a", "été 😀", "a\nb c", "hello wor", "12 ab cd"]:
        want = every(text)
        for n in (1, 2, 4, 9):
            got = v.encode(text, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({x for _, x in got}) == len(got)
            for s, raw in got:
                ids = tuple(memoryview(raw).cast("I"))
                assert (s, ids) in want and v.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    v = piece_nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(v.decode(memoryview(raw).cast("I")) == text for _, raw in v.encode(text, 3))


def test_best_pieces_are_close_to_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v = piece_nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ("hello world", "international understanding of complicated mathematical philosophy"):
        assert len(v.encode(t, 4)[0][1]) // 4 == len(sp.encode(t))
    assert piece_nbest.merge_ranks([0.0, -1.0, -2.0]) and not piece_nbest.merge_ranks([-1.5, -2.25])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 33_000)), max_size=20))
def test_any_ids_decode(ids):
    v = piece_nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    out = v.decode(ids)
    out.encode("utf-8", "surrogatepass")
    if any(i is None or not 0 <= i < len(v.text) for i in ids):
        assert "\ufffd" in out


def test_decode_of_a_table(spark):
    v = piece_nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    a, e2 = v.ids["a"], v.byte[0xE2]
    df = spark.createDataFrame([(1, [a, a]), (2, [e2]), (3, [-1, 99_999]), (4, []), (5, None), (6, [v.ids["\u2581a"]])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in piece_nbest.decode(df, "ids").collect()}
    assert got == {1: "aa", 2: "\ufffd", 3: "\ufffd\ufffd", 4: "", 5: None, 6: "a"}


def test_pieces_table(corpus, empty):
    got = piece_nbest.encode_nbest(corpus, n=3, with_ids=True)
    rows = got.collect()
    assert len(rows) == corpus.count() and all(r.round_trip for r in rows)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.score for r in rows)
    back = piece_nbest.decode(got.selectExpr("doc_id", "nbest_ids[0] as ids", "1 as DECODED").drop("DECODED"), "ids").collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((r.doc_id, r.text or "") for r in corpus.collect())
    assert piece_nbest.encode_nbest(empty).count() == 0
