"""The corpus operators against brute force and on odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import decontaminate, graph, html_text, licences, line_dedup, near_dup, pieces, quality, secrets, text, token_counts, toxicity
from webloom.llm.registry import tokenizer_path

MODEL, RANKS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- helpers -------------------------------------------------------------------------------------------------


def test_words_and_slices():
    rows = ["a bc", "", "x", " y\x0bz ", "\x85q"]
    column = pa.array(rows)
    data, at = text.view(column)
    s, e = text.words(data, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == [w for r in rows for w in WORDS.findall(r)]
    assert text.owners(s, at).tolist() == [k for k, r in enumerate(rows) for _ in WORDS.findall(r)]
    assert [x for a, b in text.slices(column, 3) for x in range(a, b)] == list(range(len(rows)))
    part = column.slice(2, 3)
    data, at = text.view(part)
    assert bytes(data[at[0] : at[1]]) == b"x"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, k) for k in range(301, 400)] + [(k, k + 1) for k in range(400, 470)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges + [(None, 1), (5, 5)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicates -----------------------------------------------------------------------------------------


def slow_fingerprint(t):
    w = WORDS.findall(lowered(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("t", ["", " ", "one", "A b C d E f", "a b c d " * 300, "É é x\x1cy z q"])
def test_fingerprint(t):
    assert near_dup.fingerprint(t.encode()) == slow_fingerprint(t)


def test_large_leaf_links_components_through_a_visitor(monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF", 0)
    fp = np.array([0, 0b1111, 0b11111111], np.uint64)
    forest = near_dup._Forest(3)
    near_dup._leaf(fp, np.array([0, 2]), np.arange(3), 4, forest)
    assert forest.roots().tolist() == [0, 0, 0]
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 16, 900).astype(np.uint64))
    home = np.flatnonzero(rng.random(len(fp)) < 0.4)
    for radius in (1, 2):
        got, want = near_dup._Forest(len(fp)), near_dup._Forest(len(fp))
        near_dup._leaf(fp, home, np.arange(len(fp)), radius, got)
        i, j = np.nonzero(np.bitwise_count(fp[home][:, None] ^ fp[None, :]) <= radius)
        want.join(home[i], j)
        assert got.roots().tolist() == want.roots().tolist()


def near_copies(rng, n, centres=40, most=6):
    base = [rng.getrandbits(64) for _ in range(centres)]
    return np.unique(np.array([base[rng.randrange(centres)] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most))) for _ in range(n)], np.uint64))


def slow_roots(fp, radius=4):
    want = near_dup._Forest(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
    want.join(i, j)
    return want.roots().tolist()


@pytest.mark.parametrize(("scheme", "reach"), [((3, 1), 1), ((6, 2), 0), ((5, 1), 0), ((5, 2), 1), ((4, 1), 1), ((2, 1), 2)])
def test_search_is_exact(monkeypatch, scheme, reach):
    monkeypatch.setattr(near_dup, "LEAF", 8)
    fp = near_copies(random.Random(3), 900)
    masks, got = near_dup.masks_of(*scheme, 4)
    assert got == reach
    joined = near_dup._Forest(len(fp))
    for m in masks:
        tree = near_dup.grow((fp & m)[:200], 20, reach, np.random.default_rng(0))
        row, shard, home = near_dup.route(fp & m, tree, reach)
        assert sorted(row[home].tolist()) == list(range(len(fp)))
        assert tree.shards > 4 and (reach or len(row) == len(fp))
        for s in np.unique(shard):
            here = row[shard == s]
            a, b = near_dup._search(fp[here], home[shard == s], m, reach, 4)
            joined.join(here[a], here[b])
    assert joined.roots().tolist() == slow_roots(fp)


def test_shards_keep_to_their_size(monkeypatch):
    """The plan for many fingerprints copies each a bounded number of times, and fills shards evenly."""
    monkeypatch.setattr(near_dup, "SHARD", 500)
    fp = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1 << 16).astype(np.uint64) * np.uint64(2))
    masks, reach, trees = near_dup.plan(fp[:: len(fp) // 8192], len(fp), 4)
    got = [near_dup.route(fp & m, t, reach) for m, t in zip(masks, trees, strict=True)]
    assert sum(len(r) for r, _, _ in got) <= 15 * len(fp)
    assert max(np.bincount(s).max() for _, s, _ in got) <= 2 * 500


@pytest.mark.parametrize("shard", [50_000, 30])
def test_links_of_a_table(spark, monkeypatch, shard):
    monkeypatch.setattr(near_dup, "SHARD", shard)
    fp = near_copies(random.Random(4), 700)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(5)
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    joined = near_dup._Forest(len(fp))
    for r in near_dup.links(table).collect():
        joined.join(np.array([at[r.a]]), np.array([at[r.b]]))
    assert joined.roots().tolist() == slow_roots(fp)


def varied(rng):
    """Texts with exact and near copies, some short, some of no words."""
    words = [f"v{k}" for k in range(400)]
    texts = ["", " ", "one", "two words"]
    for _ in range(25):
        t = rng.choices(words, k=rng.choice([3, 6, 40, 400]))
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            u = list(t)
            for _ in range(rng.randrange(3)):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(" ".join(u))
    return texts


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_against_brute_force(spark, kind):
    """Ids that repeat, with the same and with other texts, of both types."""
    rng = random.Random(6)
    name = (lambda k: k) if kind == "long" else (lambda k: f"d{k:04d}")
    rows = [(name(rng.randrange(60)), t) for t in varied(rng) for _ in range(rng.choice([1, 1, 2]))]
    prints = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    roots = slow_roots(prints)
    want = sorted((k, f"{int(f):016x}", min(rows[j][0] for j, x in enumerate(roots) if x == r)) for (k, _), f, r in zip(rows, prints, roots, strict=True))
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("__n", F.monotonically_increasing_id())
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == want
    kept = near_dup.keep_first(df).collect()
    at = {(k, t): r for (k, t), r in zip(rows, roots, strict=True)}
    # one row of each component, and it has the component's least id
    assert sorted(at[r.doc_id, r.text] for r in kept) == sorted(set(roots))
    assert all(r.doc_id == min(rows[j][0] for j, x in enumerate(roots) if x == at[r.doc_id, r.text]) for r in kept)


def test_keep_first_is_by_row(spark):
    t, u = "the quick brown fox jumps over it", "nothing in common with the other text at all"
    schema = "doc_id long, text string, extra string"
    kept = lambda rows: sorted((r.doc_id, r.text, r.extra) for r in near_dup.keep_first(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert kept([(1, t, "a"), (5, t, "b"), (5, u, "c")]) == [(1, t, "a"), (5, u, "c")]
    assert kept([(5, t, "b"), (5, u, "c")]) == [(5, u, "c"), (5, t, "b")]
    assert kept([(5, t, "b"), (5, t, "a"), (5, u, "c"), (6, u, "d")]) == [(5, u, "c"), (5, t, "a")]


def test_crowded_masks_go_on_over_all_bits(monkeypatch):
    """Fingerprints that are all equal under the mask: three far centres with near copies each, and pairs between."""
    monkeypatch.setattr(near_dup, "LEAF", 8)
    rng = random.Random(8)
    fp = near_copies(rng, 700, centres=6, most=5) & ~np.uint64(0xFF)
    fp = np.unique(fp)
    joined = near_dup._Forest(len(fp))
    joined.join(*near_dup._search(fp, np.ones(len(fp), bool), np.uint64(0xFF), 0, 4))
    assert joined.roots().tolist() == slow_roots(fp)


def test_dense_group():
    """A leaf that no pivot can split still gives one component, in few rows."""
    fp = np.array([1 << a | 1 << b for a in range(32) for b in range(a)], np.uint64)
    a, b = near_dup._search(fp, np.ones(len(fp), bool), np.uint64(0), 1, 4)
    assert len(a) == len(fp) - 1 and set(b) == {0}


def test_near_duplicates(odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by[1][1] == by[2][1] == 1
    # no words: fingerprint zero, and together
    assert by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert by[None][1] is None
    assert by[6][0] == f"{slow_fingerprint('word ' * 60_000):016x}"
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.keep_first(odd)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.filter("doc_id is not null").collect()) == [(False, k) for k in (1, 3, 6, 7, 8, 9)]
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1


# --- token counts --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_token_counts(odd, none, block):
    e = token_counts._encoding(RANKS, pattern())
    want = sorted((r.doc_id or -1, len(e.encode_ordinary(r.text or "")) + 1) for r in odd.collect())
    got = token_counts.count(odd, RANKS, pattern(), block=block).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    assert token_counts.count(none, RANKS, pattern()).count() == 0
    named = token_counts.count(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), RANKS, pattern(), block=block).collect()
    assert sorted((int(r.doc_id[1:]) if r.doc_id else -1, r.n_tokens) for r in named) == want


@pytest.mark.parametrize("ranges", [True, False])
def test_token_files(spark, tmp_path, monkeypatch, ranges):
    """Flat files without an index: ends in other blocks, none in a block, one file unfinished, one empty, one cut off."""
    if not ranges:
        monkeypatch.setattr(token_counts, "_reachable", lambda url: False)
    files = {"a.bin": [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9], "b.bin": [1] * 20 + [9, 5], "c.bin": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + b"\x09" * (name == "b.bin"))
    blocks = token_counts.read_blocks(spark, str(tmp_path), 2, 3)
    assert max(len(r.data) for r in blocks.collect()) == 6
    got = collections.defaultdict(dict)
    for r in token_counts.stitch(token_counts.scan(blocks, 9, 2)).collect():
        got[r.file][r.doc_no] = r.n_tokens
    assert sorted([v for _, v in sorted(d.items())] for d in got.values()) == [[3, 1, 7], [21]]


# --- HTML ----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies, you know.</div><div class=ad>Buy, buy, buy!</div>
<article><h1>A &amp; B</h1><p><b>First   paragraph, with
 text; it goes on.<br><p>Second one, &#233;t&eacute;. More words here.</p><!-- gone --><ul><li>item</li><li>next</li></ul>
<form>Name <input></form><section id="comments"><p>Reader says hi, hello.</p></section></article><aside>Aside, here.</aside><footer>&copy; x</footer>"""


def test_html():
    assert html_text.main_text(PAGE) == "A & B\nFirst paragraph, with text; it goes on.\nSecond one, été. More words here.\nitem\nnext"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<nav>only</nav>", "plain & text"])
def test_html_of_odd_pages(page):
    assert html_text.main_text(page) in ("", "plain & text", "<", "<p")


def test_html_without_an_article():
    page = f"<div id=top class=header>Head</div><div class=body><h1>T</h1><p>{'Long text, here. ' * 9}</p><p>{'More of it, too. ' * 9}</p></div><div class=sidebar>{'Side, text. ' * 20}</div>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "T" and len(got) == 3 and "Side" not in "".join(got)


LONG = "<p>" + "Long text of the page, here. " * 9 + "</p>"


@pytest.mark.parametrize(
    ("page", "n"),
    [
        (f'<div class="site-content has-sidebar">{LONG * 3}</div>', 3),
        (f'<div class="layout no-sidebar"><article>{LONG * 3}</article></div>', 3),
        (f'<article>{LONG}<section class="social-history">{LONG}</section></article>', 2),
        (f'<form id=aspnet><div class="page_sidebar"><div class="menu">{LONG * 5}</div></div></form>', 5),
        (f'<div id=sidebar-content>{LONG * 4}</div><p>x</p>', 4),
        (f'<div>{LONG * 2}</div><div class="user-comments">{LONG * 5}</div>', 2),
        (f'<article>{LONG}<div class="ad-slot">{LONG}</div><ol class="comment-list"><li><article class=body>{LONG * 4}</article></ol></article>', 1),
        (f'<div><div><a href=/>Home</a> <a href=/b>About</a></div>{LONG * 2}<ul><li><a href=/c>One thing to see</a><li><a href=/d>Another to see</a></ul>{LONG}<div>Imprint</div></div>', 3),
    ],
)
def test_html_classes_and_content(page, n):
    """Whole names of classes count by their last word, and not against nearly all content of a page."""
    assert html_text.main_text(page) == "\n".join([re.sub("<.*?>", "", LONG).strip()] * n)


def test_html_keeps_formulas():
    assert html_text.main_text(f"<article>{LONG}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</article>").endswith("Let x=2 be.")


@pytest.mark.parametrize("part", ['<a "', "<a '", '<a b="', "<b>", "<p><ul>", "<", "<!--", "</", "<li>", "<p><button><ul>", "<table><tr><td>", "<div class='ad'>x", "<dd><b>y"])
def test_html_of_a_malformed_megabyte(part):
    """Twice the page takes about twice the time."""
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text(part * (n // len(part)))
        return time.process_time() - began

    assert took(1_000_000) < max(1.0, 6 * took(250_000))


class _Slow:
    """The extraction written plainly over the standard library's parser, for pages with an <article>."""

    def __init__(self, page):
        import html.parser

        outer = self
        self.nodes, self.stack, self.block = [], [], 0

        class Reader(html.parser.HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in html_text.CLOSES_P and "p" in outer.stack:
                    inner = outer.stack[len(outer.stack) - 1 - outer.stack[::-1].index("p") :]
                    if not set(inner[1:]) & {"td", "th", "button", "article", "div", "section", "table"}:
                        del outer.stack[-len(inner) :]
                if tag == "li" and "li" in outer.stack and "ul" not in outer.stack[len(outer.stack) - outer.stack[::-1].index("li") :]:
                    del outer.stack[len(outer.stack) - 1 - outer.stack[::-1].index("li") :]
                outer.block += tag in html_text.BLOCK
                if tag == "br":
                    outer.nodes.append((tuple(outer.stack), " ", outer.block))
                elif tag not in html_text.VOID:
                    outer.stack.append("ad" if ("class", "ad") in attrs else tag)

            def handle_endtag(self, tag):
                names = ["div" if x == "ad" else x for x in outer.stack]
                if tag in names:
                    del outer.stack[len(names) - 1 - names[::-1].index(tag) :]
                outer.block += tag in html_text.BLOCK

            def handle_data(self, data):
                outer.nodes.append((tuple(outer.stack), data, outer.block))

        reader = Reader()
        reader.feed(page)
        reader.close()

    def text(self):
        gone = {"head", "script", "style", "nav", "footer", "aside", "ad"}
        paths = collections.defaultdict(lambda: [0, 0, 0])
        for path, t, _ in self.nodes:
            if not gone & set(path):
                p = paths[path]
                p[0] += len(t.strip())
                p[1] += sum(t.count(c) for c in ".,;:!?")
                p[2] += 1
        best = max(paths, key=lambda p: paths[p][0] * (1 + paths[p][1]) / paths[p][2] ** 2, default=())
        if "article" not in best:
            return None
        blocks = collections.defaultdict(str)
        for path, t, block in self.nodes:
            if "article" in path and not gone & set(path):
                blocks[block] += t
        joined = [" ".join(b.split()) for b in blocks.values()]
        return "\n".join(b for b in joined if b)


def test_html_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: _Slow(r.html).text() for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == want and all(want.values())


def test_html_ratios_against_brute_force(spark, sf_dir):
    """Sums of paths, smoothing and threshold, node by node."""
    import math

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        page = html_text.parse(r.html)
        out, picked, in_links = html_text.left_out(page)
        names = []
        for x in page.nodes:
            e, tags = x.at, []
            while e.up is not None:
                tags.append(e.tag)
                e = e.up
            names.append(tuple(tags))
        text = [len(x.text.strip()) for x in page.nodes]
        mark = [sum(c in ".,;:!?…。，、；：！？¿¡" for c in x.text) for x in page.nodes]
        link = ["a" in n for n in names]
        of = lambda values, k: sum(v for v, n in zip(values, names, strict=True) if n == names[k])
        share = [of([t * s for t, s in zip(text, link, strict=True)], k) / max(1, of(text, k)) for k in range(len(names))]
        ratio = [of(text, k) / names.count(names[k]) * (1 - share[k]) for k in range(len(names))]
        marks = [of(mark, k) / names.count(names[k]) for k in range(len(names))]
        weights = [math.exp(-(d * d) / 2) for d in range(-2, 3)]
        at = lambda v, k: v[min(max(k, 0), len(v) - 1)]
        smooth = lambda v, k: sum(w * at(v, k + d) for w, d in zip(weights, range(-2, 3), strict=True)) / sum(weights)
        live = [not out[x.at.number] for x in page.nodes]
        fused = [smooth(ratio, k) * (1 + smooth(marks, k)) if live[k] else 0 for k in range(len(names))]
        some = [f for f, x in zip(fused, live, strict=True) if x]
        mean = sum(some) / len(some)
        limit = 0.5 * (sum((f - mean) ** 2 for f in some) / len(some)) ** 0.5
        want = [live[k] and not link[k] and text[k] > 0 and fused[k] > 0 and fused[k] >= limit * (1 - 1e-9) for k in range(len(names))]
        assert picked.tolist() == want and in_links == pytest.approx(share)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(df.filter("false")).count() == 0


def test_line_hashes_of_a_large_batch_come_in_parts():
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices("abcdefgh", k=40)) for _ in range(30)) for _ in range(1200)] + ["", "x"]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b])], ["doc_id", "text"])
    run = line_dedup._hashed(20)
    parts = list(run(iter([batch(0, len(texts))])))
    assert len(parts) == -(-sum(map(len, texts)) // text.STEP_BYTES) > 1
    assert pa.Table.from_batches(parts).to_pylist() == [r for k in range(len(texts)) for p in run(iter([batch(k, k + 1)])) for r in p.to_pylist()]


# --- toxicity ------------------------------------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["river", "stone", "the", "and", "of", "garden", "walks", "quiet", "morning", "is"]
    out = []
    for k in range(n):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randrange(5, 60))]
        bad = k % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = "nastig" + rng.choice(["er", "st", "ly", "ness", "um"])
        out.append((k, " ".join(w), int(bad)))
    return out


def slow_logit(m, t):
    """One text's logit, word by word and window by window."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in t)
    w = [x.encode() for x in re.findall("[0-9A-Za-z'\x80-\U0010ffff]+", lower)]
    hashed = lambda b: int(text.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    size = np.uint64(toxicity.BUCKETS - 1)

    def vector(b):
        ids = [1 + hashed(b) % (toxicity.BUCKETS - 1)]
        for p in toxicity.PREFIXES:
            if len(b) > p:
                folded = sum((x + 1) * pow(0x100000001B3, k, 1 << 64) for k, x in enumerate(b[:p])) + int(text.mixed(np.full(1, p, np.uint64))[0])
                ids.append(1 + int(text.mixed(np.full(1, folded % (1 << 64), np.uint64))[0] % size))
        return sum(m.table[k].astype(float) for k in ids)

    rows = [vector(b) for b in w] or [np.zeros(toxicity.DIM)]
    rows += [np.zeros(toxicity.DIM)] * 2
    best = []
    for width, f in zip(toxicity.WIDTHS, m.filters, strict=True):
        best += [max(sum(rows[k + j] @ f[j][:, c] for j in range(width)) for k in range(len(rows) - 2)) for c in range(toxicity.FILTERS)]
    return float(np.maximum(np.array(best) + m.bias, 0) @ m.out + m.prior)


def slow_language(t):
    w = re.findall("[0-9a-z'\x80-\U0010ffff]+", t.lower())
    votes = [sum(x in v.split() for x in w) for v in toxicity.FUNCTION_WORDS.values()]
    return votes.index(max(votes)) if max(votes) else len(votes)


@pytest.fixture(scope="module")
def classifier():
    rows = corpus(500, 3)
    rows += [(500 + k, t.replace("the", "der").replace("and", "und"), y) for k, t, y in corpus(300, 4)]
    fold = np.array([k % 4 == 1 for k, _, _ in rows])
    return toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]), fold), rows, fold


def test_toxicity_forward_against_brute_force(classifier):
    m, rows, _ = classifier
    texts = [t for _, t, _ in rows[::25]] + ["", " ", "one", "ÀÉ×Þ é's x1", "a" * 500, "nastiger " * 300, "\x00\x85"]
    scores = m.scores(pa.array(texts))
    for t, s in zip(texts, scores, strict=True):
        assert s == pytest.approx(1 / (1 + np.exp(m.thresholds[slow_language(t)] - slow_logit(m, t))), abs=1e-4)


def test_toxicity_thresholds_are_the_best_of_their_language(classifier):
    """No threshold of a language's calibration rows has a better F1, and languages differ."""
    m, rows, fold = classifier
    of = [slow_language(t) for _, t, _ in rows]
    for k in sorted(set(of)):
        mine = [(slow_logit(m, t), y) for (_, t, y), f, x in zip(rows, fold, of, strict=True) if x == k and f]
        if not 5 <= sum(y for _, y in mine) <= len(mine) - 5:
            continue
        f1 = lambda at: 2 * sum(y for s, y in mine if s > at) / max(1, sum(s > at for s, _ in mine) + sum(y for _, y in mine))  # noqa: B023, E731
        assert f1(m.thresholds[k]) >= max(f1(s - 1e-6) for s, _ in mine) - 1e-9
    assert len(set(of)) > 1


def test_toxicity(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [k for k, _, _ in rows if toxicity.bucket(k) == 0]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[k].predicted == y for k, _, y in rows if toxicity.bucket(k) == 0]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in toxicity.reject(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 10)], "doc_id long, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(none, labels).count() == 0
    nothing = toxicity.classify(odd, labels.filter("false")).collect()
    assert {r.score for r in nothing} == {0.0}
    assert toxicity.reject(odd, labels).columns == odd.columns


def test_toxicity_learns_from_every_row(spark):
    """Also from long texts and from more rows than one machine would take; in one shard as the local fit, in several nearly so."""
    words = [f"w{k}x{k % 7}" for k in range(400)]
    rng = random.Random(9)
    # each bad word stands in texts of over 20,000 characters alone
    rows = [(k, " ".join(rng.choice(words) for _ in range(4500)) + (" vilest" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    short = corpus(400, 8)
    rows += [(1000 + k, t, y) for k, t, y in short]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(5000, rows[0][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5000, 1)], "doc_id long, toxic int")
    seen = toxicity._labelled(docs.unionAll(docs), labels, "doc_id", "text", "toxic")[0].collect()
    assert sorted(r["text"] for r in seen) == sorted({t for k, t, _ in [*rows, (5000, rows[0][1], 1)] if toxicity.bucket(k) != 0})
    one, few = toxicity.train(docs, labels), toxicity.train(docs, labels, shard=400_000)
    again = toxicity.train(docs.repartition(5), labels.repartition(2), shard=400_000)
    assert (few.table == again.table).all() and (few.thresholds == again.thresholds).all()
    unseen = [(t, y) for k, t, y in rows if toxicity.bucket(k) == 0] + [("a quiet morning vilest walks", 1), ("a quiet morning walks", 0)]
    for m in (one, few):
        right = (m.scores(pa.array([t for t, _ in unseen])) >= 0.5) == np.array([y for _, y in unseen])
        assert right[-2:].all() and right.mean() > 0.95


def python_nodes(plan, above=0):
    """The most Python nodes that one task of a physical plan has, each with a worker of its own."""
    name = plan.nodeName()
    above = 0 if "Exchange" in name else above + ("InArrow" in name or "InPandas" in name)
    children = plan.children()
    return max([above, *(python_nodes(children.apply(k), above) for k in range(children.size()))])


def test_toxicity_fits_with_one_worker_of_a_task(spark, monkeypatch):
    """Two Python nodes in a stage hold twice the workers of an executor, and their memory."""
    rows = corpus(300, 11)
    docs, labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    frames, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **b: frames.append(plain(*a, **b)) or frames[-1])
    models = [toxicity.train(d, labels, shard=20_000) for d in (docs, docs.unionAll(docs.filter("doc_id % 3 = 0")))]
    assert len(frames) > 6
    assert max(python_nodes(f._jdf.queryExecution().executedPlan().initialPlan() if "Adaptive" in f._jdf.queryExecution().executedPlan().nodeName() else f._jdf.queryExecution().executedPlan()) for f in frames) == 1
    # repeated rows count once, by whichever way they come
    assert (models[0].table == models[1].table).all() and (models[0].thresholds == models[1].thresholds).all()


# --- SentencePiece -------------------------------------------------------------------------------------------


def test_pieces_equal_the_library():
    import sentencepiece

    sp, e, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(MODEL), random.Random(2)
    alphabet = " \n\tabcdeABC123é▁한ﬁ　😀\x00\r_-=/thein.,'"
    texts = ["", " ", "a" * 300, " " * 40 + "the" + " " * 17, "<s></s><0x41>", "�"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(["ing", "the", "er", "in", "  ", "0", "==", "----", "a", "s", " t", "tion", "'s", "."]) for _ in range(40)) for _ in range(800)]
    for t in texts:
        ids = sp.encode(t, add_eos=True)
        assert e.encode(t) == ids, t
        back = sp.decode(ids)
        assert e.decode(ids) == back
        assert e.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_pieces_refuse_a_model_of_other_rules(monkeypatch):
    """As one that folds letters or keeps no spaces would show."""
    import sentencepiece

    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, t, **k):
            return super().encode(t.replace("  ", " "), **k)

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="two  spaces"):
        pieces.Encoder(MODEL)


def test_pieces_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 5)
    e = pieces.Encoder(MODEL)
    want = pieces.Encoder(MODEL).encode("a bb ccc dddd eeeee ffffff ggggggg a bb")
    assert e.encode("a bb ccc dddd eeeee ffffff ggggggg a bb") == want and len(e.memo) <= 5


def test_pieces_of_odd_rows(odd, none):
    d = {(r.doc_id, r.n_tokens) for r in pieces.digests(odd, MODEL).collect()}
    assert (3, 1) in d and (4, 1) in d
    assert pieces.digests(none, MODEL).count() == 0
    back = pieces.decode(pieces.encode(odd, MODEL), MODEL)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())


# --- quality -------------------------------------------------------------------------------------------------


def slow_counts(t):
    w = WORDS.findall(t)
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {x for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)]


def test_quality_counts():
    rng = random.Random(4)
    texts = ["", "a", "a b\na b\n \n a b", "x " * 30, "é#|<b>\x85"] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "é "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    m = quality.measure(pa.array(texts))
    assert np.array([m[k] for k in quality._BASE]).T.tolist() == [slow_counts(t) for t in texts]


def slow_distance(p, q):
    p, q = np.array(p) / max(1, sum(p)), np.array(q) / max(1, sum(q))
    m = (p + q) / 2
    return max(0, sum(sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) for a in (p, q)) / 2) ** 0.5


def test_quality_verdicts(spark):
    rng = random.Random(6)
    clean = [(k, " ".join(rng.choice(["the", "of", "and", "walking", "river", "stones", "in", "is"]) + rng.choice(["", "", ",", "."]) for _ in range(120)), "en") for k in range(60)]
    junk = [(100 + k, " ".join(rng.choice(["QQXZ!!", "RRTT!!", "#$%&"]) + str(rng.random()) for _ in range(120)), "en") for k in range(4)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.assess(df).collect()}
    assert all(rows[k].kept for k, _, _ in clean) and not any(rows[k].kept for k, _, _ in junk)
    # brute force: shares' means, then those of the nearer half or nearer than NEAR
    m = quality.measure(pa.array([t for _, t, _ in clean + junk]))
    shares = {k: m[k] / m[k].sum(1, keepdims=True) for k in ("chars", "common")}
    first = [slow_distance(x, shares["chars"].mean(0)) for x in m["chars"]]
    near = np.array(first) <= max(quality.NEAR, np.ceil(np.sort(first)[(len(first) - 1) // 2] * quality.STEPS) / quality.STEPS + 1e-12)
    for k, r in enumerate([*clean, *junk]):
        got = rows[r[0]]
        assert got.js_chars == pytest.approx(slow_distance(m["chars"][k], shares["chars"][near].mean(0)), abs=1e-8)
        assert got.js_common == pytest.approx(slow_distance(m["common"][k], shares["common"][near].mean(0)), abs=1e-8)


def test_quality_of_the_tables(spark, sf_dir):
    """Counts, references by language, distances and limits on real rows, one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {r.doc_id: r for r in quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)).collect()}
    m = quality.measure(pa.array([r.text for r in docs]))
    shares = {k: m[k] / np.maximum(1, m[k].sum(1, keepdims=True)) for k in ("chars", "common")}
    for lang in {r.lang for r in docs}:
        mine = [k for k, r in enumerate(docs) if r.lang == lang]
        long = [k for k in mine if m["n_words"][k] >= quality.CHAR_LIMITS[0][0]]
        first = {k: slow_distance(m["chars"][k], shares["chars"][long].mean(0)) for k in long}
        middle = np.ceil(sorted(first.values())[(len(long) - 1) // 2] * quality.STEPS) / quality.STEPS
        near = [k for k in long if first[k] <= max(quality.NEAR, middle) + 1e-12]
        for k in mine:
            r, counts = got[docs[k].doc_id], slow_counts(docs[k].text)
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
            js = [slow_distance(m[h][k], shares[h][near].mean(0)) for h in ("chars", "common")]
            assert (r.js_chars, r.js_common) == pytest.approx(js, abs=1e-8)
            base = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
            off = any(counts[0] >= least and d > limit for d, limits in zip(js, (quality.CHAR_LIMITS, quality.WORD_LIMITS), strict=True) for least, limit in limits)
            assert (r.base_failed, r.kept) == (base, not base and not off)


def test_quality_of_odd_rows(odd, none):
    rows = quality.assess(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[3].base_failed and by[4].n_words == 0 and by[6].n_repeat_words == 60_000 and not by[6].kept
    assert quality.assess(none).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------


def test_patience():
    a, b = np.array([1, 2, 3, 4, 5, 6]), np.array([9, 2, 3, 8, 5, 6, 7])
    assert line_dedup.patience(a, b) == [(1, 1, 2), (4, 4, 2)]
    assert line_dedup.patience(a, a) == [(0, 0, 6)]
    assert line_dedup.patience(a, np.array([], int)) == []
    # a line that is twice on a side anchors nothing by itself
    assert line_dedup.patience(np.array([1, 7, 7, 2]), np.array([3, 7, 7, 4])) == []


def test_line_dedup(spark):
    line = lambda k, n=12: " ".join(f"w{k}x{j}" for j in range(n))
    block = "\n".join([line(1), line(2)])
    rows = [
        (1, f"own a\n{block}\nown b"),
        (2, f"other\n{block}\nend"),
        (3, f"{line(1)}\nshort only"),
        (4, block),
        (4, block),
        (5, None),
        (6, ""),
        (None, block),
        (7, f"{line(2)}\n{line(1)}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_n_lines": F.lit("x"), "gone": F.lit(1)})
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(df).collect():
        got[r.doc_id].append((r.text, r._n_removed))
    assert got[1] == [(rows[0][1], 0)]
    assert got[2] == [("other\nend", 2)]
    assert got[3] == [(rows[2][1], 0)]  # 12 words are under the least block
    assert got[4] == [("", 2), ("", 2)]
    assert got[5] == [(None, 0)] and got[6] == [("", 0)] and got[None] == [(block, 0)]
    assert got[7] == [(rows[8][1], 0)]  # the lines are there, but in another order
    assert line_dedup.dedup_lines(df.filter("false")).count() == 0


def test_line_dedup_keeps_each_line_somewhere(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = lambda df: {x.strip() for r in df.select("text").collect() for x in r.text.split("\n") if x.strip()}
    assert lines(line_dedup.dedup_lines(docs)) == lines(docs)


def test_line_dedup_meets_whole_blocks(spark):
    """Each line of a block was held first by another document than the block."""
    lines = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(5)]
    block = "\n".join(lines)
    rows = [*((k, f"own {k}\n{x}") for k, x in enumerate(lines)), (5, f"head\n{block}\nend"), (9, f"other\n{block}\nlast")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {9: "other\nlast"}


def test_line_dedup_of_repeated_and_swapped_blocks(spark):
    p, q = ("\n".join(" ".join(f"{c}{k}x{j}" for j in range(12)) for k in range(3)) for c in "pq")
    rows = [
        (1, f"a\n{p}\nb\n{p}\nc\n{q}"),
        (2, f"d\n{p}\ne"),  # twice in its first holder
        (3, f"f\n{q}\ng\n{q}\nh"),  # twice in the later document
        (4, f"{q}\ni\n{p}"),  # in the other order
    ]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "d\ne", 3: "f\ng\nh", 4: "i"}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["", *(" ".join(f"w{k}x{j}" for j in range(rng.choice([1, 4, 9, 12, 25]))) for k in range(9))]
    texts = [[rng.choice(alphabet) for _ in range(rng.randrange(14))] for _ in range(60)]
    runs = lambda t: {(x, y): tuple(t[x:y]) for x in range(len(t)) for y in range(x + 1, len(t) + 1) if len(" ".join(t[x:y]).split()) >= 20}
    held, want = set(), {}
    for k, t in enumerate(texts):
        own = runs(t)
        gone = {i for (x, y), r in own.items() if r in held for i in range(x, y)}
        want[k] = [x for i, x in enumerate(t) if i not in gone and x]
        held |= set(own.values())
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [x for x in r.text.split("\n") if x] for r in line_dedup.dedup_lines(df).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len([x for x in t if x]) for t in texts)


# --- licences ------------------------------------------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/x.py", "code\n# Licensed under the Apache License, Version 2.0\nmore"),
        (3, "a/b/c/y.py", "code without"),
        (4, "z/y.py", "code without"),
        (5, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"),
        (6, "a/b/q.py", None),
        (7, None, "licensed under CC BY-NC 4.0"),
        (8, "z/w.py", "a licence of some kind that nobody knows about at all"),
        (8, "z/w.py", "a licence of some kind that nobody knows about at all"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"licence": F.lit("x"), "dir": F.lit("x"), "cosine": F.lit(1)})
    got = {r.doc_id: (r.licence, r.inherited, r.inherited_from) for r in licences.scan(df).collect()}
    assert got == {
        1: ("MIT", None, None), 2: ("Apache-2.0", None, None), 3: (None, "GPL-3.0", "a/b"), 4: (None, None, None), 5: ("GPL-3.0", None, None), 6: (None, "GPL-3.0", "a/b"), 7: ("CC-BY-NC-4.0", None, None), 8: (None, None, None),
    }
    assert licences.scan(df).count() == 9 and licences.scan(df.filter("false")).count() == 0


def test_whole_licences(spark):
    """A whole text goes before its sentences; names don't matter, nor how it is wrapped; headers may be comments."""
    import textwrap

    files = dict(licences.FILES)
    wrapped = lambda t: "Copyright (c) 2020 Somebody. All rights reserved.\n\n" + textwrap.fill(t.replace("the copyright holder", "Some Body"), 70)
    rows = [(k, f"p{k}/LICENSE", wrapped(t)) for k, t in enumerate(files.values())]
    header = "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\"); you may\n * not use this file except in compliance with the License.\n *\n * code */"
    rows += [(10, "src/a.c", header), (11, "q/COPYING", "   GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n" + "Everyone is permitted to copy. " * 900), (12, "q/x/y.c", "int main")]
    got = {r.doc_id: (r.licence, r.inherited) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k][0] for k in range(len(files))] == list(files)
    assert got[10][0] == "Apache-2.0" and got[11][0] == "GPL-3.0" and got[12] == (None, "GPL-3.0")


def test_licences_of_odd_rows(odd):
    rows = licences.of_documents(odd).collect()
    assert len(rows) == 11 and {r.licence for r in rows if r.doc_id == 9} == {"Apache-2.0"}


# --- secrets -------------------------------------------------------------------------------------------------


def test_secret_queries_never_miss():
    rng = random.Random(8)
    bits = ['PassWord="abc', "passwd : xyzxyz", "AKIA" + "Q" * 16, "AKIA", "deadbeef" * 3, "ghp_" + "a" * 36, "api_key=", "APIKEY: 'abcdefg", "-----BEGIN PRIVATE KEY-----", "http://u:pwd@h.example", "ſecret=abcdefgh", "é", " ", "token=abcdef.", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(6))) for _ in range(400)] + [""]
    for t, found in zip(texts, secrets.Scanner().scan(pa.array(texts)), strict=True):
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t, r.flags) if len(m.group(r.group)) >= r.least)
        assert found == want


def test_hex_is_the_runs_of_its_class():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("0123456789abcdefg") for _ in range(rng.randrange(90)))
        plain = [m.span() for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        assert [m.span() for m in re.finditer(secrets.BASE[2].pattern, t)] == plain


def test_secret_digests(spark, odd, none):
    t = 'é token = "abcdef123" and ' + "0123456789abcdef" * 2
    r = secrets.digests(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    spans = f"assign:2:{t.index('123') + 3},hex:{t.index('0123456789')}:{len(t)}"
    assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (1, 0, 1, spans)
    assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert secrets.digests(odd).count() == 11 and secrets.digests(none).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------


def slow_contained(docs, items, threshold):
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]
    out = {}
    for i, t in items:
        w = split(t)
        if not w or i is None:
            continue
        n = min(5, len(w))
        want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for r, d in docs:
            x = split(d)
            share = len(want & {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}) / len(want)
            if share >= threshold:
                out[r, i] = max(share, out.get((r, i), 0))
    return out


def test_decontamination(spark):
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 15, 40, 59, 300])))) for k in range(60)] + [(60, ""), (61, None), (None, "v1 v2 v3 v4 v5 v6"), (5, "v1 v2 v3 v4 v5 v6 v7")]
    docs = []
    for r in range(150):
        w = rng.choices(vocabulary, k=rng.choice([3, 80, 3000]))
        for _ in range(2):
            t = (items[rng.randrange(60)][1] or "").split()
            cut = t[: int(len(t) * rng.choice([0.5, 0.85, 0.95, 1]))]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() for x in cut]
        docs.append((r, rng.choice([" ", "\n"]).join(w)))
    want = slow_contained(docs, items, 0.8)
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string").withColumn("id", F.lit("clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("containment", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained(df, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 50
    kept = {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()}
    assert kept == {r for r, _ in docs} - {r for r, _ in want}


def test_decontamination_in_parts(spark, monkeypatch):
    """The number of parts changes nothing, also where an item has several texts and rows."""
    items = [(k % 10, " ".join(f"i{k % 14}w{j}" for j in range(12))) for k in range(20)]
    docs = spark.createDataFrame([(k, f"before {t} after {u}") for k, ((_, t), (_, u)) in enumerate(zip(items, items[3:], strict=False))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontaminate.contained(docs, bench).collect())
    whole = found()
    assert {(r, i): s for r, i, s in whole} == pytest.approx(slow_contained([tuple(r) for r in docs.collect()], items, 0.8)) and len({x[:2] for x in whole}) == len(whole)
    for n in (1, 3):
        monkeypatch.setattr(decontaminate, "PART_ITEMS", n)
        assert found() == whole


def test_decontamination_of_scattered_items(spark):
    """An item that is torn into ten pieces, each in another place, is found by its shingles all the same."""
    rng = random.Random(12)
    plain = [f"v{k}" for k in range(3000)]
    items = [(k, [f"i{k}w{j}" for j in range(400)]) for k in range(40)]
    docs = []
    for k, w in items:
        pieces_ = [w[x : x + 40] for x in range(0, 400, 40)]
        rng.shuffle(pieces_)
        docs.append((k, " ".join(x for p in pieces_ for x in [*p, *rng.choices(plain, k=30)])))
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(40)}


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contained(odd, bench).collect()) == [1, 2, 2]
    assert decontaminate.contained(none, bench).count() == 0 and decontaminate.contained(odd, bench.filter("false")).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns
