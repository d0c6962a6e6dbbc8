"""The operators' kernels against brute force, without Spark."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import html_text, langid, media, mixing, neardup, packing, quality, token_counts, url_rules


# ---- packing
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_best_fit_places(lengths, open_bins):
    used: dict[int, list[tuple[int, int]]] = {}
    for n, (b, o) in zip(lengths, packing.best_fit(lengths, 50, open_bins), strict=True):
        used.setdefault(b, []).append((o, n))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 50


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    assert [b for b, _ in packing.best_fit([30, 40, 9, 10], 50, 8)] == [0, 1, 1, 0]
    # with two open bins, the one with 45 used closes when a third opens
    assert [b for b, _ in packing.best_fit([45, 30, 40, 5, 10], 50, 2)] == [0, 1, 2, 2, 1]


def slow_best_fit(lengths, size, open_bins):
    """Bins as a plain list: the open one with the least sufficient space, the last used among equals; the one with the least space closes."""
    bins, out, made = [], [], 0
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[1], -b[2]))
            bins.remove(b)
        else:
            b = (made, size, 0)
            made += 1
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: (b[1], -b[2])))
        out.append((b[0], size - b[1]))
        if b[1] > n:
            bins.append((b[0], b[1] - n, len(out)))
    return out


@given(st.lists(st.integers(1, 30), max_size=120), st.integers(1, 9))
@settings(max_examples=200)
def test_best_fit_equals_a_plain_list(lengths, open_bins):
    assert packing.best_fit(lengths, 30, open_bins) == slow_best_fit(lengths, 30, open_bins)


def test_words_are_forgotten_but_ids_stay():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdeé'!1 ", k=200)) for _ in range(60)]
    few = packing.TokenBytes(packing.encoder(packing.VOCABULARY).path, remembered=20)
    assert [np.frombuffer(x, "<u4").tolist() for x in few.encode_all(texts)] == [few.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(few.words) < 5000


def test_ranked_pieces_equal_the_merges():
    e = packing.encoder(packing.VOCABULARY)
    rng = random.Random(3)
    tokens = [t.removesuffix("</w>") for t in e.whole.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha() and t.islower()]
    words = ["".join(rng.choices(tokens, k=rng.randint(1, 4))) if i % 2 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéèßüñø", k=rng.randint(1, 40))) for i in range(5000)]
    for w, ids in zip(words, e.whole.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(w), "<u4").tolist() == ids.ids


def test_encoder_equals_the_tokenizer():
    e = packing.encoder(packing.VOCABULARY)
    odd = ["it's", "DON'T!", "a1b2", "x<|endoftext|>y", "naïve's", "ÿÀÖ×÷ß", "''s", "ﬁ", "İx", "Σας", "áb", "ª", "x\u0085y", "a\xa0b", "😀!", "a\x1cb", "", "\x1d"]
    rng = random.Random(1)
    texts = [*odd, " ".join(odd), *("".join(rng.choices("ab'sßé.,!1 \n\x1f", k=30)) for _ in range(200))]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


# ---- mixing
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 40))
@settings(max_examples=80)
def test_nearest_sum(counts, budget):
    taken = mixing.nearest_sum(list(counts), list(counts.values()), budget)
    assert all(0 <= n <= counts[k] for k, n in taken.items())
    sums = {sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))}
    assert abs(sum(k * n for k, n in taken.items()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_budget_is_exact_on_many_lengths():
    rng = random.Random(4)
    lengths = list(range(1, 3000, 7))
    counts = [rng.randint(1, 9) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts, strict=True)) // 3
    taken = mixing.fit_budget(lengths, counts, budget)
    assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == budget
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert mixing.fit_budget([100], [1], 60) == [1] and mixing.fit_budget([100], [1], 40) == [0] and mixing.fit_budget([0, 5], [9, 1], 0) == [0, 0]


# ---- token counts
def greedy(vocabulary: set[bytes], text: bytes) -> int:
    n = at = 0
    while at < len(text):
        best = max((len(v) for v in vocabulary if text.startswith(v, at)), default=0)
        if not best:
            return -1
        at, n = at + best, n + 1
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=20).map(str.encode), max_size=10))
@settings(max_examples=200)
def test_automaton_counts_as_greedy_matching(vocabulary, texts):
    a = token_counts.LongestMatch(sorted(vocabulary))
    for t in texts:
        assert a.count(t) == greedy(vocabulary, t)


# ---- near-duplicates
def slow_signature(elements, size):
    h = [2**64 - 1] * size
    for e in elements:
        p = list(range(size))
        for j in range(size):
            r = int(neardup.mix(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((r >> 32) * (size - j) >> 32) if size - j > 1 else j
            v, p[k] = p[k], p[j]
            h[v] = min(h[v], j << 32 | r & 0xFFFFFFFF)
    return h


def test_signatures_equal_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 0, 2, 5, 40, 300)]
    found = neardup.SuperMinHash(20).signatures(sets)
    for s, row in zip(sets, found, strict=True):
        assert row.tolist() == slow_signature(s, 20)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 500).astype(np.uint64)
        a, b = neardup.SuperMinHash().signatures([base[:400], base[50:450]])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 350 / 450) < 0.02


def test_large_sets_go_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    big = rng.integers(0, 2**63, 5000).astype(np.uint64)
    whole = neardup.SuperMinHash(30).signatures([big])
    monkeypatch.setattr(neardup, "DRAW", 256)
    assert (neardup.SuperMinHash(30).signatures([big]) == whole).all()


@pytest.mark.parametrize("blocks", [1, 2])
def test_confirmed_links_span_the_similar_pairs(blocks):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    names = sorted((i % blocks, i) for i in range(40))
    links = neardup.confirmed_links((80, 100))(names, [sets[i].tobytes() for _, i in names])

    def parts(pairs):
        up = list(range(40))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        return [next(x for x in iter(lambda x=[i]: x.__setitem__(0, up[x[0]]) or x[0], None) if up[x] == x) for i in range(40)]

    similar = [(a, b) for a in range(40) for b in range(a) if (blocks == 1 or a % 2 != b % 2) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert parts(links) == parts(similar) and len(links) < 40


# ---- language ID
def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    prob = np.array([[0.1], [0.2], [0.3], [0.05], [0.25], [0.1], [0.0], [langid.UNKNOWN]])
    table = {p: i for i, p in enumerate(pieces)}

    def brute(run):
        if not run:
            return 1.0
        found = sum(prob[table[run[:k]], 0] * brute(run[k:]) for k in range(1, len(run) + 1) if run[:k] in table)
        return found + (langid.UNKNOWN * brute(run[1:]) if run[0] not in table else 0)

    trie, weights = langid.PieceTrie(pieces), langid.scaled(prob, pieces)
    runs = ["▁ab", "▁abab", "▁zab", "▁aabbabab", "▁" + "ab" * 9, "▁", "▁日本ab"]
    assert np.exp(langid.log_probs(runs, trie, weights))[:, 0] == pytest.approx([brute(r) for r in runs])


@pytest.mark.parametrize("longest", [3, 11, 40])
def test_forward_in_blocks(longest):
    """Runs longer than a block, against sums place by place in logarithms; pieces may be longer than 8 letters and than a block."""
    rng = random.Random(longest)
    pieces = sorted({"▁", "▁a", "a", "b"} | {"".join(rng.choices("ab", k=rng.randint(1, longest))) for _ in range(40)} | {"a" * longest})
    prob = np.array([[rng.random() / 10, rng.random() / 1000] for _ in pieces] + [[0, 0], [langid.UNKNOWN] * 2])
    table = {p: i for i, p in enumerate(pieces)}

    def slow(run, language):
        logs = [0.0]
        for j in range(1, len(run) + 1):
            parts = [logs[i] + np.log(prob[table[run[i:j]], language]) for i in range(max(0, j - longest - 1), j) if run[i:j] in table]
            if run[j - 1] not in table:
                parts.append(logs[j - 1] + np.log(langid.UNKNOWN))
            logs.append(np.logaddexp.reduce(parts))
        return logs[-1]

    runs = ["▁" + "".join(rng.choices("abz" if n % 2 else "ab", k=n)) for n in (1, 30, 31, 32, 33, 63, 64, 65, 200, 997)] + ["▁" + "a" * 500]
    trie, weights = langid.PieceTrie(pieces), langid.scaled(prob, pieces)
    got = langid.log_probs(runs, trie, weights)
    assert got == pytest.approx(np.array([[slow(r, k) for k in (0, 1)] for r in runs]))
    small = langid.SUMS
    try:
        langid.SUMS = 1  # a block at a time
        assert langid.log_probs(runs, trie, weights) == pytest.approx(got)
    finally:
        langid.SUMS = small


def test_the_whole_vocabulary_is_in_use():
    pieces = langid.read_pieces()
    assert "▁information" in pieces and "▁" in pieces and max(map(len, pieces)) > 12
    text = "▁" + "informationdifferentbusiness" * 400
    prob = langid.learn({"▁information": 5, "▁different": 2, text: 1}, pieces)
    assert prob[pieces.index("▁information")] > prob[pieces.index("▁inform")]
    weights = langid.scaled(prob[:, None], pieces)
    assert np.isfinite(langid.log_probs([text, "▁" + "z" * 3000, "▁" + "語" * 3000], langid.PieceTrie(pieces), weights)).all()


def test_expected_uses_add_up():
    pieces = ["▁", "a", "b", "ab"]
    prob = np.array([0.4, 0.2, 0.2, 0.2, 1e-300, langid.UNKNOWN])
    uses = langid.expected_uses(["▁ab", "▁"], np.array([3.0, 1.0]), langid.PieceTrie(pieces), np.log(prob))
    split, whole = 0.4 * 0.2 * 0.2, 0.4 * 0.2
    assert uses[0] == pytest.approx(4) and uses[3] == pytest.approx(3 * whole / (split + whole)) and uses[1] == pytest.approx(3 * split / (split + whole))


# ---- URL rules
def slow_rule(rules, host, path):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def test_sweep_equals_brute_force():
    rng = random.Random(7)
    host = lambda n: ".".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): ("block" if rng.random() < 0.5 else "allow", h, p) for h, p in ((host(3), path()) for _ in range(80))}.values())
    rows = sorted((url_rules.reversed_host(h), p, h) for h, p in ((host(5), path()) for _ in range(3000)))
    found = list(url_rules.sweep(((k, p) for k, p, _ in rows), url_rules.by_host(rules)))
    for (_, p, h), got in zip(rows, found, strict=True):
        assert got == slow_rule(rules, h, p)


# ---- media
@pytest.mark.parametrize("n", [0, 1, 64, 65, 5000])
def test_media_round_trip(n):
    for raw in (random.Random(n).randbytes(n), b"\xff" * n, b"ab" * (n // 2)):
        film = media.read_avi(m := media.media_of(raw))
        decoded = media.decode_all(m, film["frames"])
        assert media.payload_of(decoded, film["note"]) == media.padded(raw)
        j = media.Jpeg(m[film["frames"][0][0] : sum(film["frames"][0])])
        assert (j._decoded() == j.coefficients()).all() and (j.width, j.height) == (64, 16)
        assert sum(k for _, k in media.shots(media.histograms(decoded))) == len(decoded)


def test_index_is_optional():
    m = media.media_of(b"x" * 9000)
    cut = m[: m.rindex(b"idx1")]
    assert media.read_avi(cut)["frames"] == media.read_avi(m)["frames"]


def test_shots_at_a_change():
    a, b = np.eye(16)[2], np.eye(16)[9]
    levels = np.array([a * 0.98 + b * 0.02 * (i % 2) if i < 10 else b for i in range(20)])
    assert media.shots(levels) == [(0, 10), (10, 10)]
    assert media.shots(levels[:0]) == [] and media.shots(levels[:1]) == [(0, 1)]


# ---- HTML
PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">ad</div><article><h1>T&amp;C</h1><p><b>Bold.<br><p>one\n  two&nbsp;three</p><script>var x="</p>";</script><p>a &lt; b</article><footer>f</footer></body></html>'


def test_page_text():
    assert html_text.page_text(html_text.parse(PAGE)) == "T&C\nBold.\none two three\na < b"
    assert html_text.page_text(html_text.parse("")) == ""
    assert html_text.page_text(html_text.parse("just text < 3 <b")) == "just text < 3"
    assert html_text.page_text(html_text.parse("<p>a<!-- x --><span>b</span></p><div id='comments'>c</div><form>d</form>e")) == "ab\ne"
    assert html_text.page_text(html_text.parse("<article><p>cut &am")) == "cut &am"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html_text.page_text(html_text.parse(deep)) == "x"


def test_page_text_keeps_content():
    text = lambda html: html_text.page_text(html_text.parse(html))
    comment = "<ul><li class=comment><article class=comment-body><p>first!</p></article></li></ul>"
    assert text(f"<div><p>body</p></div>{comment}") == "body"
    assert text(f"<main><p>body</p></main><p>x</p>{comment}") == "body"
    assert text('<p>a<svg class="i"/>b</p><p>c</p><math/><p>d</p>') == "ab\nc\nd"
    assert text("<p>a<svg><path d='M0'/><g>no</g></svg>b</p>") == "ab"
    assert text("<p>a<svg title='x/>y'>no</svg>b</p>") == "ab"
    assert text("<p>a</p><script src=x />var b;</script><p>c</p>") == "a\nc"
    assert text("<article><h2 id=search>Search</h2><p>trees</p><section id=login><h3 id=comments>Comments</h3><p>on style</p></section><section id=comments><p>no</p></section></article>") == "Search\ntrees\nComments\non style"
    assert text("<h2 id=comments>Comments</h2><p>x</p>") == text("<article><h2 class=related>Related</h2><p>x</p></article>") == "x"


def test_wrapper_finds_the_template():
    page = lambda i: f"<body><div><p>Welcome to our site</p></div><div><h1>Title {i}</h1>{''.join(f'<p>text {i} {k}</p>' for k in range(i % 4 + 1))}</div><div><p>All rights reserved</p></div></body>"
    wrappers = {k: html_text.Wrapper(w) for k, w in html_text.induce([page(i) for i in range(6)]).items()}
    assert html_text.text_of(page(9), wrappers.get) == "Title 9\ntext 9 0\ntext 9 1"
    assert html_text.induce([page(1)] * 6) == {}


def test_structure_tells_template_without_kinds():
    """Menus, adverts and footers that vary from page to page, in elements whose names say nothing."""
    words = lambda i, n: " ".join(f"w{(i * 37 + k * 11) % 101}" for k in range(n))
    menu = lambda i: "".join(f"<li><a href=/{k}>{words(i + k, 2)}</a></li>" for k in range(3 + i % 4))
    page = lambda i: (
        f"<body><div class=u><ul>{menu(i)}</ul></div><div class=v><span>{words(i, 4)}</span></div><div class=w><div class=x><h1>{words(i, 3)}</h1>"
        + "".join(f"<p>{words(i + k, 60)}</p>" for k in range(2 + i % 5)) + f"<div class=y><p>{words(i, 50)} <a>{words(i, 2)}</a></p></div></div></div><h2>{words(i, 5)}</h2><div class=z>{words(i, 3)}</div></body>"
    )
    want = lambda i: "\n".join([words(i, 3), *(words(i + k, 60) for k in range(2 + i % 5)), words(i, 50) + " " + words(i, 2), words(i, 5)])
    for kinds in (True, False):
        wrappers = {k: html_text.Wrapper(w, kinds) for k, w in html_text.induce([page(i) for i in range(12)]).items()}
        assert len(wrappers) == 1
        for i in (3, 8, 20):
            assert html_text.text_of(page(i), wrappers.get, kinds) == want(i) != html_text.text_of(page(i), {}.get, kinds)


def test_wide_and_deep_pages_are_aligned():
    wide = "<div>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}><p>t{i}</p></div>" for i in range(3000)) + "</div>"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    for html in (wide, deep):
        top = html_text.slots_of(html_text.parse(html))
        assert max(len(s.children) for s in html_text.numbered_slots(top)) <= 2 * html_text.WIDE
        pages = [html + f"<p>page {i}</p>" for i in range(5)]
        wrappers = {k: html_text.Wrapper(w) for k, w in html_text.induce(pages).items()}
        assert html_text.text_of(pages[2], wrappers.get) == "page 2"


def slow_matching(a, b):
    """The heaviest matching by trying every order-preserving choice of children."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), slow_matching(x[0], y[0]) + best(x[1:], y[1:]) if x[0].label == y[0].label else 0)

    return 1 + best(a.children, b.children)


def test_tree_matching_is_the_heaviest():
    rng = random.Random(5)

    def tree(depth):
        s = html_text.Slot(rng.choice("ab"), "div", False, False)
        s.children = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return s

    for _ in range(150):
        a, b = tree(3), tree(3)
        m = html_text.Matcher()
        assert m.weight(a, b) == slow_matching(a, b) == len(pairs := list(m.pairs(a, b)))
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


# ---- quality
def test_log_ratios():
    r = quality.log_ratios({0: (10, 5), 1: (10, 0)}, 2)
    assert r[0] > 0 > r[1] and r[2:] == [0.0, 0.0]
    assert quality.log_ratios({}, 2) == [0.0] * 4


def test_packing_loads_its_tables_once_a_worker():
    """A worker's next task takes the vocabulary's tables from the one before, and none of its words."""
    first = packing.encoder(packing.VOCABULARY)
    assert list(first.encode_all(["some words"])) and first.words
    second = packing.encoder(packing.VOCABULARY)
    assert second.whole is first.whole and second.ranked is first.ranked and not second.words
