"""The operators on small tables: odd rows with a defined result, and brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import html_text, langid, media, mixing, neardup, packing, quality, sharding, token_counts, url_rules
from plumbline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"
WORD = re.compile("[^ \t-\r]+")
LONG = "".join(f"w{i % 977}x{i % 13} " for i in range(30_000))
near = [f"n{i}" for i in range(60)]
ROWS = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "a", 0, "x", "y"),
    (3, " \t\n\x0b ", "en", "a", 5, None, None),
    (4, "one", "en", "b", 3, "x", "y"),
    (5, "One two", None, None, 7, "x", "y"),
    (6, "one TWO", "en", "b", 7, "x", "y"),
    (7, LONG, "en", "a", len(LONG), "x", "y"),
    (8, LONG, "en", "c", len(LONG), "x", "y"),
    (9, " ".join(near), "de", "c", 1, "x", "y"),
    (10, " ".join([*near[:55], "other"]), "de", "c", 1, "x", "y"),
    (11, "Straße ÉTÉ ñandú 12 #$% <b>", "de", "b", 1, "x", "y"),
    (12, "Straße ÉTÉ ñandú 12 #$% <b>", "de", "b", 1, "x", "y"),
    (12, "Straße ÉTÉ ñandú 12 #$% <b>", "de", "b", 1, "x", "y"),
    (None, "lost id of some words", "en", "a", 1, "x", "y"),
    (14, "line one\nline one\n\nline one\na\x1cb c", "en", "a", 1, "x", "y"),
    (15, "x" * 5000, "en", "a", 1, "x", "y"),
    (16, "12 34 !!", "en", "a", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted((k, str(v)) for k, v in r.items())))


def by_id(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[n] for n in names))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_packing(spark, docs, empty):
    t = packing.encoder(packing.VOCABULARY).whole
    found = packing.pack_documents(docs, size=64, group=8)
    want = []
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    got = found.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty).count() == 0


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given, left = {s: left * weight[s] / whole for s in open_}, 0.0
        for s, x in given.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark, docs, empty):
    found = mixing.mix(docs)
    sizes, whole, taken, target = {}, Counter(), Counter(), {}
    for i, text, _, source, *_ in ROWS:
        whole[source] += len(WORD.findall(text or ""))
        sizes.setdefault(i, []).append(len(WORD.findall(text or "")))
    for r in found.collect():
        assert r["size"] in sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] and r["source_size"] == whole[r["source"]] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = slow_targets(whole)
    assert target == pytest.approx(want)
    for s in want:
        assert abs(taken[s] - want[s]) <= max([len(WORD.findall(t or "")) for _, t, _, x, *_ in ROWS if x == s]) / 2 + 1
    assert rows_of(found) == rows_of(mixing.mix(docs))
    assert mixing.mix(empty).count() == 0


def test_mixing_ranks_a_hot_length_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 600, "s0").otherwise("s1").alias("source"))
    got = mixing.mix(hot).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1.5 for r in got) and max(r["c"] for r in got) == 2


def test_mixed_rows_keep_columns(spark, docs):
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("copies", F.lit("mine"))
    out = mixing.mixed_rows(named)
    assert out.columns == named.columns and set(r["copies"] for r in out.collect()) == {"mine"}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(named).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})


def test_stages_where_ids_repeat(spark, tmp_path):
    """Rows of one id, or of none, are judged each: one of each group of linked texts stays, and no copy is taken more than twice."""
    texts = [" ".join(f"{name}{i}" for i in range(80)) for name in "abc"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[1]), (None, texts[2]), (None, "few words"), (2, "few words"), (3, None), (3, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, copies int").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, frame, DATA)
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, "few words"), (3, None), (3, None)])
    mixed = corpus_pipeline.mix_sources(spark, frame, DATA)
    mixed.write.parquet(str(tmp_path / "mixed"))
    times = Counter(r["copies"] for r in spark.read.parquet(str(tmp_path / "mixed")).collect())
    whole = sum(len((t or "").split()) for _, t in rows)
    assert mixed.columns == frame.columns and max(times.values()) <= 2
    assert abs(sum(n * len((rows[k][1] or "").split()) for k, n in times.items()) - 1.5 * whole) <= 40


def test_token_counts(spark, docs, empty):
    a = token_counts.LongestMatch(token_counts.read_ranks(token_counts.VOCABULARY))
    want = {}
    for i, text, *_ in ROWS:
        words = WORD.findall(text or "")
        want.setdefault(i, []).append((len(words), sum(a.count(b" " + w.encode()) for w in words), 0))
    assert by_id(token_counts.token_counts(docs), "n_words", "n_tokens", "n_unknown") == {k: sorted(v, key=str) for k, v in want.items()}
    assert token_counts.token_counts(empty).count() == 0


def slow_groups(rows, k=4, share=80):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    out = {}
    for a, (i, *_) in enumerate(rows):
        x = a
        while up[x] != x:
            x = up[x]
        members = []
        for b, (j, *_) in enumerate(rows):
            y = b
            while up[y] != y:
                y = up[y]
            if x == y:
                members.append(j)
        known = [j for j in members if j is not None]
        least = min(known) if known else None
        out.setdefault(i, []).append((len(sets[a]), least, i == least))
    return {i: sorted(v, key=str) for i, v in out.items()}


def test_near_duplicates(spark, docs, empty):
    assert by_id(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept") == slow_groups(ROWS)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(spark):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 5)):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_groups(rows)
    for block in (7, 512):
        assert by_id(neardup.near_duplicates(df, bucket_block=block, group_block=block), "n_shingles", "component_id", "kept") == want


def test_near_duplicates_of_large_groups(spark):
    """One star of many near copies, a second cluster that a few texts tie to it, and a chain, in groups of several blocks: no link between components is lost."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(100)]
    other = [*base[:60], *(f"c{i}" for i in range(40))]
    rows = []

    def add(words, changes):
        w = list(words)
        for at in rng.integers(0, len(w), changes):
            w[at] = f"e{len(rows)}_{at}"
        rows.append((len(rows), " ".join(w)))

    for _ in range(220):
        add(base, rng.integers(0, 3))
    for _ in range(90):
        add(other, rng.integers(0, 3))
    for k in range(0, 41, 2):  # from the one to the other
        add([*base[:60], *other[60 : 60 + k], *base[60 + k :]], 0)
    for k in range(40):
        add([f"d{i}" for i in range(3 * k, 3 * k + 90)], 0)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = slow_groups(rows)
    assert by_id(neardup.near_duplicates(df, bucket_block=48, group_block=48), "n_shingles", "component_id", "kept") == want


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)  # the star's hub and labels are looked up apart
    name = lambda i: bytes([i // 256, i % 256])
    order = np.random.default_rng(2).permutation(300)
    edges = [(name(order[i]), name(order[i + 1])) for i in range(199)] + [(name(order[200]), name(order[i])) for i in range(201, 300)]
    found = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    for part in (order[:200], order[200:]):
        assert {bytes(found[name(i)]) for i in part} == {name(min(part))}


def test_language_id(spark, docs, empty):
    words = {"en": "the house and the garden of winter", "de": "das haus und der garten im winter", "fr": "la maison et le jardin avec hiver"}
    rng = np.random.default_rng(1)
    made = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i in range(60) for lang in words]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(train.select("doc_id", "text", "lang").withColumn("doc_id", F.struct("doc_id", "lang")), model).collect()
    assert all(r["lang_pred"] == r["doc_id"]["lang"] and 0.5 < r["score"] <= 1 for r in got)
    odd = by_id(langid.identify(docs, model), "lang_pred", "score")
    for i in (1, 2, 3, 16):
        assert odd[i] == [("und", 0.0)]
    assert all(x in ("de", "en", "fr") for x, _ in odd[7] + odd[15] + odd[None])
    nothing = langid.train(train.limit(0))
    assert by_id(langid.identify(docs, nothing), "lang_pred")[7] == [("und",)]
    assert langid.identify(empty, model).count() == 0


def test_rows_kept_by_language(spark, docs, empty):
    model = langid.train(docs)
    told = {(r["doc_id"], r["lang_pred"] != "und" and r["score"] >= 0.9) for r in langid.identify(docs, model).collect()}
    kept = langid.kept_rows(docs, model, 0.9)
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(docs.filter(" or ".join(f"doc_id <=> {'null' if i is None else i}" for i, yes in told if yes)))
    assert langid.kept_rows(empty, model, 0.9).collect() == []


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?y", "https://x.net/de/1", "a://example.net/de/8#q", "q://org/es/", "http://com/en/", "http://xcom/en/", "x?y=http://b.com/en/a b", "http://a.com:80/en/", "http://h.com/en/1\n2"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] + [(4, urls[4], "r", "v")], "page_id long, url string, rule string, host string")
    want = []
    for i, u in [*enumerate(urls), (4, urls[4])]:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match("[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"))
    for per_pass in (1, 2, 100):
        got = [tuple(r) for r in url_rules.filter_urls(pages, rules_per_pass=per_pass).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert url_rules.filter_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(pages, []).collect()} == {"allow"}


def test_media(spark, docs, empty):
    stored = media.to_media(docs)
    back = {bytes(r["media"]): bytes(r["payload"]) for r in media.read_media(stored).collect()}
    for r in stored.collect():
        texts = [(t or "").encode() for i, t, *_ in ROWS if i == r["doc_id"]]
        assert back[bytes(r["media"])] in [media.padded(t) for t in texts] and r["n_bytes"] in map(len, texts)
    rows = media.clips(media.read_media(stored)).filter("doc_id = 7").orderBy("clip").collect()
    assert rows[0]["first_frame"] == 0 and rows[-1]["end_s"] == pytest.approx((rows[-1]["first_frame"] + rows[-1]["frames"]) / 25)
    whole = bytes(stored.filter("doc_id = 15").first()["media"])
    broken = [None, b"", b"RIFF", b"no film at all", whole[:200], whole[:3000], whole[:600] + b"\xff\xc2" * 40 + whole[680:], whole.replace(b"\xff\xc0", b"\xff\xc2")]
    bad = spark.createDataFrame([(i, m, "x") for i, m in enumerate([*broken, whole])], "doc_id long, media binary, payload string")
    read = {r["doc_id"]: r for r in media.read_media(bad).collect()}
    assert len(read) == len(broken) + 1 and bytes(read[len(broken)]["payload"]) == media.padded(b"x" * 5000)
    assert all(read[i]["payload"] is None and read[i]["clips"] is None for i in (0, 1, 2, 3))
    assert media.to_media(empty).count() == 0 and media.read_media(media.to_media(empty)).count() == 0


def test_sharding(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t"), F.expr("repeat(cast(id as string), cast(id % 7 as int))"))).alias("text"))
    for df in (docs, many):
        got = sharding.shard(df).collect()
        assert len(got) == df.count() and {r["law"] for r in got} == {"bytes"}
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
        slots = {}
        for r in got:
            assert (r["size"], r["text_crc32"]) in [(len(t) + 1, zlib.crc32(t)) for t in texts[r["doc_id"]]] and 0 <= r["shard"] < 16
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    whole = sum(load.values())
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 0.06 * whole / 16
    assert sharding.shard(empty).count() == 0


def test_shards_equal_cuts_of_a_full_sort(spark):
    """The splitters against all rows sorted by their keys in Python: shards are runs of the sort, cut as near the targets as rows and equal texts allow."""
    rng = np.random.default_rng(12)
    rows = [(i, "same text " * 40 if i % 5 == 0 else f"text {i} " * int(rng.integers(1, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keys = {r["doc_id"]: (r["a"] % 2**64, r["b"] % 2**64) for r in df.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(8), "doc_id").alias("b")).collect()}
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(df).collect()}
    order = sorted(rows, key=lambda r: keys[r[0]])
    found = [got[i] for i, _ in order]
    assert found == sorted(found) and set(found) == set(range(16))
    ends = np.cumsum([len(t) + 1 for _, t in order])
    total, most = ends[-1], sharding.TOLERANCE * ends[-1] / 16
    for k in range(1, 16):
        target = total * k / 16
        cut = ends[found.index(k) - 1]
        nearest = min(ends, key=lambda e: abs(e - target))
        assert abs(cut - target) <= max(most, abs(nearest - target) + max(len(t) + 1 for _, t in rows))


def test_shots_by_the_definition():
    """A cut is where a difference exceeds the mean and SIGMAS deviations of the shot's last HISTORY differences."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        levels = np.abs(np.cumsum(rng.normal(size=(40, 16)) * (rng.random((40, 1)) < 0.2), axis=0)) + 0.1
        levels /= levels.sum(1, keepdims=True)
        starts = [0]
        for t in range(1, 40):
            d = [float(np.abs(levels[i] - levels[i - 1]).sum() / 2) for i in range(starts[-1] + 1, t + 1)]
            past = d[:-1][-media.HISTORY :]
            limit = max(media.FLOOR, np.mean(past) + media.SIGMAS * np.std(past)) if past else media.FIRST
            if d[-1] > limit:
                starts.append(t)
        assert media.shots(levels) == [(a, b - a) for a, b in zip(starts, [*starts[1:], 40], strict=True)]


def test_html(spark):
    pages = [(1, "http://a.b/x", "<article><p>one</p> <p>two &amp; three</p></article><footer>f</footer>"), (2, None, None), (3, "nohost", ""), (3, "nohost", ""), (4, "http://a.b/y", "<p>" + "word " * 50_000), (5, "u", "<div>" * 5000 + "x")]
    df = spark.createDataFrame([(*p, "t", "h") for p in pages], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got[1] == ("http://a.b/x", "one\ntwo & three", 15) and got[2] == (None, "", 0) and got[3] == ("nohost", "", 0) and got[5][1] == "x"
    assert got[4][2] == 50_000 * 5 - 1
    assert html_text.extract(df).count() == len(pages) and html_text.extract(df.limit(0)).count() == 0


def test_html_wrapper_counts_all_pages(spark, monkeypatch):
    box = lambda kind, *lines: f"<div class={kind}>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"
    body = lambda *parts: "<html><body>" + "".join(parts) + "</body></html>"
    rows, want = [], {}

    def add(host, html, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))

    for i in range(80):  # two layouts
        add("two", body(box("x", "Welcome", f"two {i}", "Bye")) if i % 2 else body(box("y", "Hello"), box("z", f"two {i}")), f"two {i}")
    for i in range(80):  # a line on four pages of five
        add("most", body(box("x", f"most {i}"), box("line", "We moved") if i % 5 else ""), f"most {i}")
    for host in range(12):  # small hosts
        for i in range(4):
            add(f"small{host}", body(box("x", f"Host {host}"), box("z", f"small {host} {i}")), f"small {host} {i}")
    for i in range(40):  # a line on a few pages is content
        add("few", body(box("x", f"few {i}", "Quoted") if i < 8 else box("x", f"few {i}")), f"few {i}\nQuoted" if i < 8 else f"few {i}")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == want
    for host in ("two", "most", "small3", "few"):  # the plain way finds the same
        own = [r for r in rows if r[1].startswith(f"http://{host}/")]
        wrappers = {k: html_text.Wrapper(w) for k, w in html_text.induce([r[2] for r in own]).items()}
        assert wrappers and all(html_text.text_of(r[2], wrappers.get) == want[r[0]] for r in own)
    monkeypatch.setattr(html_text, "WRAPPERS_BROADCAST_BYTES", 0)  # joined by layout and salt
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == want


class SlowPage(HTMLParser):
    """Main text by the standard library's parser: the blocks of the article, without what never is main text."""

    def __init__(self, html):
        super().__init__()
        self.blocks, self.text, self.inside, self.skip = [], "", False, 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if " ".join(self.text.split()):
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.flush()
        self.inside = self.inside or tag == "article"
        self.skip += tag in ("script", "style", "nav", "footer", "aside", "form")
        self.text += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        self.inside = self.inside and tag != "article"
        self.skip -= tag in ("script", "style", "nav", "footer", "aside", "form")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.text += data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_html_of_the_tables(sf):
    """All pages against the slow parser; and where a host has a wrapper, it alone, without kinds, finds the same text and changes every page."""
    rows = duckdb.sql(f"select url, html from '/root/testdata/{sf}/pages.parquet'").fetchall()
    hosts = {}
    for url, html in rows:
        hosts.setdefault(re.search("://([^/?#]*)|$", url or "")[1], []).append(html or "")
    wrapped = 0
    for pages in hosts.values():
        packed = html_text.induce(pages)
        full, alone = ({k: html_text.Wrapper(w, kinds) for k, w in packed.items()} for kinds in (True, False))
        for html in pages:
            text = html_text.text_of(html, full.get)
            assert text == "\n".join(SlowPage(html).blocks)
            if html_text.layout_of(html_text.parse(html)) in alone:
                wrapped += 1
                assert html_text.text_of(html, alone.get, False) == text != html_text.text_of(html, {}.get, False)
    assert wrapped >= 0.25 * len(rows)


def test_near_copy_with_a_null_id(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (2, "something else " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in neardup.kept_rows(df).orderBy("doc_id").collect()] == [1, 2]


def slow_base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    spots = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(spots))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(6)
    few = [(100 + i, " ".join(rng.choice(list("abcdefgh") if i % 2 else [f"v{j}" for j in range(60)], 80)), None, None, None, None, None) for i in range(20)]
    df = docs.unionByName(spark.createDataFrame(few, SCHEMA))
    trusted = spark.createDataFrame([(101,), (103,), (103,), (105,), (None,), (999,)], "doc_id long")
    got = quality.quality(df, trusted)
    want = {}
    for i, text, *_ in [*ROWS, *few]:
        want.setdefault(i, []).append(slow_base(text))
    assert by_id(got, *BASE) == {k: sorted(v, key=str) for k, v in want.items()}
    assert all(not r["kept"] for r in got.filter("base_failed").collect())
    scores = {r["doc_id"]: r["score"] for r in got.filter("doc_id >= 100").collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    model = quality.fit(df, trusted)
    # scores, threshold and verdicts anew, from hashes that Spark gives
    texts = [(i, t) for i, t, *_ in [*ROWS, *few]]
    vocabulary = sorted({w for _, t in texts for w in WORD.findall(t or "")})
    ends = sorted({p for _, t in texts for w in [WORD.findall(t or "")] for p in zip(w, w[1:])})
    n = quality.FEATURES
    of = {r["w"]: r["f"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(n)).alias("f")).collect()}
    of |= {(r["a"], r["b"]): r["f"] + n for r in spark.createDataFrame(ends, "a string, b string").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(n)).alias("f")).collect()}
    features = [[*(of[x] for x in w), *(of[p] for p in zip(w, w[1:]))] for _, t in texts for w in [WORD.findall(t or "")]]
    good = [i in (101, 103, 105) for i, _ in texts]
    counts = [Counter(f for fs, g in zip(features, good, strict=True) if g or not only for f in fs) for only in (False, True)]
    ratio = {}
    for lo in (0, n):
        raw, own = (sum(c[f] for f in range(lo, lo + n)) for c in counts)
        for f in range(lo, lo + n):
            ratio[f] = round(np.log((counts[1][f] + 1) / (own + n)) - np.log((counts[0][f] + 1) / (raw + n)), 6)
    score = [sum(ratio[f] for f in fs) / len(fs) if fs else 0.0 for fs in features]
    known = [x for x, g, (_, t) in zip(score, good, texts, strict=True) if g and len(WORD.findall(t)) >= quality.MIN_WORDS]
    threshold = np.mean(known) - quality.SPREAD * np.std(known)
    assert model[1] == pytest.approx(threshold, abs=1e-5)
    verdicts = {}
    for (i, t), x in zip(texts, score, strict=True):
        verdicts.setdefault(i, []).append((round(x, 4), bool(not slow_base(t)[5] and x >= threshold)))
    assert {i: sorted((round(x, 4), k) for x, k in v) for i, v in by_id(got, "score", "kept").items()} == {i: sorted(v) for i, v in verdicts.items()}
    kept = quality.kept_rows(df, model)
    assert kept.columns == df.columns and kept.count() == got.filter("kept").count()
    assert {r["kept"] for r in kept.filter("doc_id < 100").collect()} <= {"x", "y", None}
    assert quality.quality(empty, trusted).count() == 0 and quality.quality(docs, trusted.limit(0)).count() == len(ROWS)




@pytest.mark.parametrize("few", [0, 16])
def test_repeated_windows_by_both_ways(spark, docs, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    got = quality.with_base(docs.select("doc_id", "text"), "text")
    want = {}
    for i, text, *_ in ROWS:
        want.setdefault(i, []).append(slow_base(text))
    assert by_id(got, *BASE) == {k: sorted(v, key=str) for k, v in want.items()}


# ---- registered queries
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    table = "pages" if name.startswith(("op6_", "op9_")) else "documents"
    rows = duckdb.sql(f"select * from '{DATA}/{table}.parquet'").fetchall()
    if name in ORACLES:
        c = duckdb.connect()
        c.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        want = c.sql(ORACLES[name]).df()
        key = lambda df: sorted(map(tuple, df[sorted(want.columns)].fillna("none").astype(str).to_numpy().tolist()))
        assert key(got) == key(want)
    if not name.startswith("op1_"):
        assert sorted(got.iloc[:, 0]) == sorted(r[0] for r in rows)
    if name.startswith("op1_"):
        t = packing.encoder(packing.VOCABULARY).whole
        ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
        want = {(i, k, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for i, x in ids.items() for k, at in enumerate(range(0, len(x), 2048))}
        assert {tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == want and len(got) == len(want)
        whole = got.groupby("sequence_id")["length"].sum()
        assert whole.max() <= 2048 and len(whole) <= 1.05 * -(-whole.sum() // 2048) + 1
    if name.startswith("op2_"):
        words = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
        whole = Counter()
        for r in rows:
            whole[r[3]] += words[r[0]]
        want = slow_targets(whole)
        assert all(r.size == words[r.doc_id] and r.taken == r.copies * r.size <= 2 * r.size for r in got[["doc_id", "size", "taken", "copies"]].itertuples(index=False))
        taken, targets = got.groupby("source", dropna=False)["taken"].sum(), got.groupby("source", dropna=False)["target"].first()
        for s, x in want.items():
            key = s if s is not None else next(k for k in taken.index if k is None or k != k)
            assert targets[key] == pytest.approx(x) and abs(taken[key] - x) <= 1 + max(words[r[0]] for r in rows if r[3] == s) / 2
    if name.startswith("op3_"):
        ranks = token_counts.read_ranks(token_counts.VOCABULARY)
        known, longest = set(ranks), max(map(len, ranks))

        def slow_tokens(word):
            n = at = 0
            while at < len(word):
                size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known), 0)
                if not size:
                    return 2, 1
                at, n = at + size, n + 1
            return n, 0

        for r in got.sort_values("doc_id")[["doc_id", "n_words", "n_tokens", "n_unknown"]].itertuples(index=False):
            found = [slow_tokens(b" " + w.encode()) for w in WORD.findall({x[0]: x[1] for x in rows}[r.doc_id] or "")] if r.doc_id % 5 == 0 else None
            assert found is None or (len(found), sum(n if not lost else 1 for n, lost in found), sum(lost for _, lost in found)) == (r.n_words, r.n_tokens, r.n_unknown)
    if name.startswith("op9_"):
        page = {r[0]: (r[1], r[2]) for r in rows}
        assert all((r.url, r.text, r.n_chars) == (page[r.page_id][0], text := "\n".join(SlowPage(page[r.page_id][1] or "").blocks), len(text)) for r in got.itertuples())
    if name.startswith("op4_"):
        assert {i: [(n, c, k)] for i, n, c, k in got[["doc_id", "n_shingles", "component_id", "kept"]].itertuples(index=False)} == slow_groups(rows)
    if name.startswith("op5_"):
        lang = {r[0]: r[2] for r in rows}
        held = got[got["held_out"] & got["doc_id"].map(lambda i: lang[i] is not None)]
        assert (held["lang_pred"] == held["doc_id"].map(lang)).mean() >= 0.95
        assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    if name.startswith("op7_"):
        text = {r[0]: (r[1] or "").encode() for r in rows}
        for r in got.itertuples():
            p = media.padded(text[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(m := media.media_of(text[r.doc_id])), hashlib.sha256(m).hexdigest())
    if name.startswith("op10_"):
        text = {r[0]: r[1] for r in rows}
        assert all(tuple(r) == (r[0], *slow_base(text[r[0]])) for r in got[["doc_id", *BASE]].itertuples(index=False))


@needs_data
def test_pipeline_of_an_empty_table(spark, tmp_path):
    """Every stage gives an empty table, too; extra columns go along, and null ids and texts don't matter."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).withColumn("score", F.lit(1)).withColumn("cls", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


@needs_data
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows = [tuple(r) for r in before.collect()]
        if k < 4:
            assert docs.columns == before.columns
        got = [tuple(r) for r in docs.collect()]
        ids = {r[0] for r in got}
        if name == "quality rules":
            assert all(not slow_base(r[1])[5] for r in got)
        if name == "MinHash near-dedup":
            assert ids == {i for i, found in slow_groups(rows).items() if found[0][2]} and len(got) == len(ids)
        if name == "mixing to target weights":
            whole, taken = Counter(), Counter()
            for r in rows:
                whole[r[3]] += len(WORD.findall(r[1] or ""))
            for r in got:
                taken[r[3]] += len(WORD.findall(r[1] or ""))
            most = {s: max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in whole}
            assert all(abs(taken[s] - t) <= 1 + most[s] / 2 for s, t in slow_targets(whole).items())
    t = packing.encoder(packing.VOCABULARY).whole
    assert sum(r[3] for r in got) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert corpus_pipeline.run(spark, DATA).count() == len(got)
