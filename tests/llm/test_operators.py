import hashlib
import json
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import _common, aq_ann, chat_render, id_store, lang_ftrl, mixing, near_dup, piece_codec, quality_rff, sketch, wrapper_html
from tallyspark.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY, vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, slot long"
WORDS = [f"w{i}" for i in range(300)]


def corpus():
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n\t ", "a", "a", "a b", "a b c d e f", " ".join(rng.choice(WORDS) for _ in range(20000)), "日本語 ça Ünïcode ▁ x", "x  y\n\nz ", *[" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 80))) for _ in range(20)]]
    return [(i * 3, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, 0.0, 1) for i, t in enumerate(texts)] + [(None, base, None, None, None, None, None), (3, base, "en", "s1", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):  # families of edited copies
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 14)):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice("qrst") + str(rng.random())
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r[0], r[1]) for r in corpus() if r[0] is not None]
    rows = list(dict(rows).items())
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    s = {i: sets(t) for i, t in rows}
    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (find(i), len(s[i]), find(i) == i) for i, _ in rows}


def test_near_duplicates_odd_rows(spark, docs):
    out = near_dup.near_duplicates(docs).collect()
    assert len(out) == docs.count() and [r for r in out if r["doc_id"] is None][0]["kept"]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 3").count() == 0


def test_signature_errors_are_found():
    rng = np.random.RandomState(1)
    a = np.unique(rng.randint(0, 2**62, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[60:], rng.randint(0, 2**62, 40).astype(np.uint64)]))
    x, y = (near_dup.signature(s).view("<u2") for s in (a, b))
    diff = (x != y).reshape(16, 4)
    assert diff.sum() <= near_dup.ERRORS and (diff.sum(axis=1) <= 1).any()


def test_mixing_follows_pfair(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 9}") for i in range(3000)] + [(None, None), (None, None)]
    out = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=4, period=50).toPandas()
    assert len(out) == len(rows)
    blocks = out[out.in_mix].drop_duplicates(["source", "block"]).sort_values("slot")
    assert blocks.slot.is_unique and (blocks.slot >= blocks.release).all() and (blocks.slot < blocks.deadline).all()
    assert mixing.schedule(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_mixing_to_given_weights(spark):
    rows = [(i, s) for s, n in (("a", 1000), ("b", 1000), ("c", 40), (None, 500)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash"))
    out = mixing.schedule(docs, block=2, period=100, weights={"a": 5, "b": 3, None: 2}).toPandas()
    mix = out[out.in_mix].drop_duplicates(["source", "block"])
    assert len(out) == len(rows) and (mix.slot >= mix.release).all() and (mix.slot < mix.deadline).all()
    share = mix.fillna({"source": "none"}).groupby("source").size() / mix.slot.max()
    assert abs(share["a"] - 0.5) < 0.04 and abs(share["b"] - 0.3) < 0.04 and abs(share["none"] - 0.2) < 0.04 and share["c"] < 0.03
    with pytest.raises(ValueError):
        mixing.schedule(docs, weights={"a": 0})


def test_mix_keeps_columns(docs):
    out = mixing.mix(docs, block=1)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_goes_on_after_a_source_is_used_up(spark):
    sizes = {"tiny": 10, "hot": 3000, "a": 600, "b": 600, None: 1}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    out = [r["source"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id string, source string"), block=2, period=50).collect()]
    assert {s: out.count(s) for s in sizes} == sizes
    both = [s for s in out if s in ("a", "b")]  # of equal weight: side by side to the end
    assert all(abs(2 * both[:k].count("a") - k) <= 8 for k in range(len(both)))
    assert out.index("hot") < 50 and {"a", "b"} <= set(out[1000:1100])


def test_pieces_equal_library_without_dropout_and_decode_with_it(spark, docs):
    import sentencepiece

    path = vocabulary(PIECE_VOCABULARY)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.Codec(path, 0.0)
    for t in ("Hello world, it's 12.5%!", " lead", "trail ", "a  b\n\nc", "日本語 naïve", "l'été", "\n", "   "):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == sp.encode(t)
    one, two = piece_codec.Codec(path, 0.3, 1), piece_codec.Codec(path, 0.3, 2)
    text = "tokenization of internationalization and understanding"
    assert one.encode(text) != two.encode(text) and one.encode(text) == piece_codec.Codec(path, 0.3, 1).encode(text)
    out = piece_codec.encode_documents(docs, path).collect()
    assert len(out) == docs.count() and all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_units_merged_together_equal_units_merged_alone():
    c, rng = piece_codec.Codec(vocabulary(PIECE_VOCABULARY), 0.2), random.Random(5)
    units = list({"".join(rng.choice("▁aeinrstdlou") for _ in range(rng.randint(1, 12))) for _ in range(3000)} | {"", "☃" * 3, "a☃b", "x" * 200})
    at = np.array([i for i in range(len(units)) for _ in range(1 + i % 3)])  # some once, some again
    for _ in range(2):
        keys = np.array([rng.randrange(2**64) for _ in at], np.uint64)
        ids, ends = c._results(units, at, keys)
        ends = [0, *ends.tolist()]
        assert [ids[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)] == [c._merge(units[i], k) for i, k in zip(at.tolist(), keys.tolist(), strict=True)]


def test_pieces_do_not_depend_on_what_is_remembered_or_read_together():
    path, rng = vocabulary(PIECE_VOCABULARY), random.Random(5)
    odd = ["", None, " lead", "trail ", "a  b\n\nc", "\n", "x\n y", "▁ raw ▁▁", "nul\0nul", "日本語 ☃ x" + "y" * 70, "l'été, 12.5%! (ok)", "tab\tbed \r\n"]
    texts = [" ".join(rng.choices(WORDS, k=40)) + f" odd{i} " + rng.choice(odd[2:]) for i in range(60)] + odd
    c = piece_codec.Codec(path)
    c.memory.most = 20
    assert [c.encode(t, i) for i, t in enumerate(texts)] == piece_codec.Codec(path).encode_all(texts, list(range(len(texts))))


def test_words_are_cut_anew_in_each_document():
    c, n = piece_codec.Codec(vocabulary(PIECE_VOCABULARY)), 4000
    out = c.encode_all(["of"] * n, list(range(n)))  # one merge of its characters, one with the space
    plain = piece_codec.Codec(vocabulary(PIECE_VOCABULARY), 0.0).encode("of")
    assert 0.1 < sum(x != plain for x in out) / n < 0.3
    long = "internationalization"
    assert len(set(c.encode_all([long] * n, list(range(n))))) > 50
    one = np.frombuffer(c.encode(" ".join([long] * 200), 5), "<u4")
    whole = np.frombuffer(piece_codec.Codec(vocabulary(PIECE_VOCABULARY), 0.0).encode(" ".join([long] * 200)), "<u4")
    assert len({x.tobytes() for x in np.split(one, 200)} if len(one) % 200 == 0 else {1, 2}) > 1 and c.decode(one) == c.decode(whole)


PAGE = """<html><head><title>t</title><script>x="</p>"</script></head><body><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head {0}</h1><p><b>One&amp;two   {0}<br>three<p>Second &lt;p&gt; {0}<div class=ad>Buy</div><form><input><button>Go</button></form></article>
<section id=comments><p>I disagree {0}</p></section><aside>Side</aside><footer>&copy; f</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(8)] + [(90, None, None), (91, "x", ""), (92, "http://o.example", "just text < 5 & <b>more"), (0, "http://h.example/0", PAGE.format(0))]
    out = wrapper_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and texts[3] == "Head 3\nOne&two 3 three\nSecond <p> 3"
    assert texts[90] == texts[91] == "" and texts[92] == "just text < 5 & more"
    assert all(r["n_chars"] == len(r["text"]) for r in out)


@pytest.mark.parametrize("buckets, each", [(64, 4096), (2, 100)])  # the second: a host too large for its buckets
def test_template_texts_leave_unmarked_pages(spark, monkeypatch, buckets, each):
    monkeypatch.setattr(wrapper_html, "BUCKETS", buckets)
    monkeypatch.setattr(wrapper_html, "BUCKET_PAGES", each)
    page = "<body><div><p>Same words on each page of it</p><div><p>Body {0} of page {0} with its own long text {0}</p><p>And more {0} {0}</p></div></div></body>"
    rows = [(i, "http://t.example/", page.format(i)) for i in range(400)]
    out = wrapper_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Body {i} of page {i} with its own long text {i}\nAnd more {i} {i}" for i in range(400)}


def test_template_texts_leave_a_small_host(spark):
    page = "<body><div><p>Same words on each page of it</p><div><p>Body {0} of page {0} with its own long text {0}</p><p>And more {0} {0}</p></div></div></body>"
    rows = [(i, "http://small.example/", page.format(i)) for i in range(8)]
    out = wrapper_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Body {i} of page {i} with its own long text {i}\nAnd more {i} {i}" for i in range(8)}
    (wrapper,) = wrapper_html.induce(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(json.loads(wrapper["wrapper"])["texts"]) == 1


def test_template_texts_beside_varying_ones_leave(spark):
    page = "<body><div><p>Same words on each page</p><p>Body {0} of page {0} with its own text</p></div><div>{1}<p>Same tail after all</p></div></body>"
    own = [[f"Row {j} of page {i} is its own" for j in range(40 + i * 7 % 23)] for i in range(12)]
    rows = [(i, "http://v.example/", page.format(i, "".join(f"<p>{x}</p>" for x in own[i]))) for i in range(12)]
    (wrapper,) = wrapper_html.induce(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = set(json.loads(wrapper["wrapper"])["texts"])
    assert texts == {wrapper_html._key("/body/div/p", "Same words on each page"), wrapper_html._key("/body/div/p", "Same tail after all")}


def test_long_lists_are_aligned_whole():
    a, b = (wrapper_html.parse("<ul>" + "".join(f"<li>{c}{i}</li>" for i in range(n)) + "<li>same</li></ul>" + "<p>x</p>") for c, n in (("a", 300), ("b", 420)))
    pairs = wrapper_html.align(a, b)
    assert len(pairs) == 304 and ["same"] in [x.kids for x, y in pairs if x.kids == y.kids]


@pytest.mark.parametrize("page", ["<main>{0}</main>{1}", "<main><div>{0}</div><div>{1}</div></main>", "<div>{0}</div><section>{1}</section>"])
def test_article_cards_do_not_replace_the_main_text(page):
    text = "".join(f"<p>Paragraph {i} of what the page is about, at some length</p>" for i in range(6))
    cards = "".join(f"<article><h3>Card {i}</h3><p>Teaser</p></article>" for i in range(4))
    want = "\n".join(f"Paragraph {i} of what the page is about, at some length" for i in range(6))
    assert wrapper_html.extract("<body>" + page.format(text, cards)) == want
    assert wrapper_html.extract(f"<body><main><h1>Top</h1><div>{text}</div></main>") == "Top\n" + want
    assert wrapper_html.extract(f"<body><div>{text}</div><main>{cards}</main>") == want


def test_articles_with_most_of_the_text_are_the_content():
    page = "<body><div><p>Intro</p><article><h2>One</h2><div><p>First long text of it</p></div></article><article><h2>Two</h2><p>Second long text</p></article></div>"
    assert wrapper_html.extract(page) == "One\nFirst long text of it\nTwo\nSecond long text"


def best_match(a, b):
    """Nodes in the largest match of equal signs that keeps order and ancestry, by all ways of matching children."""
    xs, ys = ([k for k in n.kids if not isinstance(k, str)] for n in (a, b))

    def of(i, j):
        if i == len(xs) or j == len(ys):
            return 0
        skip = max(of(i + 1, j), of(i, j + 1))
        return max(skip, best_match(xs[i], ys[j]) + of(i + 1, j + 1)) if xs[i].sign == ys[j].sign else skip

    return 1 + of(0, 0)


def test_alignments_of_small_trees_by_brute_force():
    rng = random.Random(7)

    def tree(depth):
        return "".join(f"<{t}>{rng.choice('xyz')}{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "b", "i"], k=rng.randint(0, 3)))

    smaller = 0
    for _ in range(200):
        a, b = wrapper_html.parse(tree(2)), wrapper_html.parse(tree(2))
        pairs, most = wrapper_html.align(a, b), best_match(a, b)
        assert len(pairs) <= most and all(x.sign == y.sign for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})
        smaller += len(pairs) < most  # equal subtrees that are matched first may cost a node
    assert smaller < 40


def test_deep_long_and_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>down here {0}</p>" + "</div>" * 3000
    long = "<div>" + "".join(f"<p>Paragraph {i}</p>" for i in range(20000)) + "</div>"
    rows = [(i, "http://deep.example/", deep.format(i), 1) for i in range(5)] + [(10, "http://long.example/", long, 1), (11, "http://long.example/", long + "<p>x</p>", 1), (None, None, "<p>a<p>b", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in wrapper_html.main_text(pages).collect()}
    assert out[3]["text"] == "down here 3" and out[10]["text"].count("\n") == 19999 and out[None]["text"] == "a\nb"
    assert wrapper_html.main_text(pages.limit(0)).count() == 0


def test_tree_matching():
    a, b = wrapper_html.parse("<ul><li>1<li>2<li>3</ul>"), wrapper_html.parse("<ul><li>1<b>x</b><li>3</ul>")
    assert len(wrapper_html.align(a, b)) == 4  # root, list, two items


def test_id_store(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    out = sorted(id_store.store_ids(docs, vocabulary(WORD_VOCABULARY)).collect(), key=lambda r: r["start"])
    texts = {}
    for r in corpus():
        texts.setdefault(r[0], []).append(r[1] or "")
    start = 0
    assert len(out) == docs.count() and [r["doc_id"] for r in out][1:] == sorted(r[0] for r in corpus() if r[0] is not None)
    for r in out:
        ids = [tk.encode(t, add_special_tokens=False).ids + [2] for t in texts[r["doc_id"]]]
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids]
        start += r["n_tokens"]
    assert id_store.store_ids(docs.limit(0), vocabulary(WORD_VOCABULARY)).count() == 0


def test_ids_of_every_latin_1_character_equal_the_library():
    e = id_store.encoder(vocabulary(WORD_VOCABULARY))
    assert e.by_piece
    for c in map(chr, range(256)):
        texts = [left + x + right for left in ("", "a", "é", "1", ".", "'", " ", "½") for right in ("", "b", "Ü", "2", ".", "'s", " ", "²") for x in (c, c + c)]
        assert [t for t in texts if e(t) != e._whole(t)] == []


def test_ids_of_random_texts_equal_the_library():
    e, rng = id_store.encoder(vocabulary(WORD_VOCABULARY)), random.Random(12)
    latin, wide = [chr(c) for c in range(32, 256) if id_store._PLAIN(chr(c))] + list("\n\t  aeinst'"), [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for chars in (latin, wide) for _ in range(3000)]
    got = e.encode_all(texts)
    assert [t for t, ids in zip(texts, got, strict=True) if ids != e._whole(t) + b"\2\0\0\0"] == []


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(id_store.Encoder, "MEMORY", 4000)
    texts = [" ".join(random.Random(i).choices(WORDS, k=40)) + f" odd{i} É{i}x. " + "y" * 70 for i in range(60)]
    e = id_store.Encoder(vocabulary(WORD_VOCABULARY))
    assert [e(t) for t in texts] == [e._whole(t) for t in texts] and len(e.names) < 200


def test_a_stored_document_is_read_alone(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(id_store, "SHARD_BYTES", 200)
    path = vocabulary(WORD_VOCABULARY)
    id_store.write_shards(docs.select("doc_id", "text"), path, str(tmp_path / "ids"), range_rows=4, shard_bytes=200)
    assert spark.read.parquet(str(tmp_path / "ids/shards")).count() > 4
    e = id_store.encoder(path)
    for doc_id in (0, 3, 9, 30):
        want = sorted(e._whole(r[1] or "") + b"\2\0\0\0" for r in corpus() if r[0] == doc_id)
        assert sorted(x.tobytes() for x in id_store.read_document(spark, str(tmp_path / "ids"), doc_id)) == want
    assert id_store.read_document(spark, str(tmp_path / "ids"), 1) == []


def test_ranges_of_many_cut_points(spark):
    for cuts in ([], [5], list(range(0, 9000, 7)), [-3, 0, 2**40]):
        df = spark.createDataFrame([(x,) for x in (-5, -3, 0, 1, 6, 7, 8, 4500, 8999, 9000, 2**41)], "v long")
        got = df.select("v", _common.range_of("v", cuts).alias("r")).collect()
        assert [r["r"] for r in got] == [int(np.searchsorted(cuts, r["v"], "right")) for r in got]


def test_shard_reads_one_document():
    import zstandard

    frames = [(i, zstandard.compress(np.arange(i + 1, dtype="<u4").tobytes()), i + 1) for i in range(5)]
    shard = id_store.Shard(id_store.pack(frames, hashlib.sha256(b"").digest()), b"")
    assert shard.find(3).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        id_store.Shard(id_store.pack(frames, hashlib.sha256(b"x").digest()), b"")


def test_quality(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) + ("!!##" if i % 4 == 0 else "") for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = quality_rff.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) > 0.97 * len(held)
    assert {r["score"] for r in quality_rff.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_rff.score_quality(docs.limit(0), labels).count() == 0
    kept = quality_rff.keep_quality(docs, labels)
    assert kept.columns == docs.columns


def test_quality_is_calibrated_on_rows_it_has_not_seen(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "!", "#", ".", "9", "A"]) for _ in range(rng.randint(20, 90)))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(rng.random() < 0.5), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    out = quality_rff.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    # labels by chance: no score may be sure
    assert np.mean([(r["score"] - y[r["doc_id"]]) ** 2 for r in out if r["held_out"]]) < 0.28


def test_quality_model_by_brute_force(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(300, 4))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(size=300) > 0).astype(int)
    fold = rng.randint(0, quality_rff.FOLDS, 300)
    rows = [(v.tolist(), int(a), int(k)) for v, a, k in zip(x, y, fold, strict=True)]
    model = quality_rff.fit(spark.createDataFrame(rows, "stats array<double>, y int, fold int").repartition(5), 4)
    z = model.features(x)

    def ridge(some):
        return np.linalg.solve(z[some].T @ z[some] + quality_rff.RIDGE * some.sum() * np.eye(z.shape[1]) / quality_rff.FEATURES, z[some].T @ y[some])

    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.dev, x.std(axis=0))
    assert np.allclose(model.raw(x), z @ ridge(fold >= 0), atol=1e-6)
    raw = np.array([z[i] @ ridge(fold != fold[i]) for i in range(300)])
    at = np.clip(np.floor((raw + 0.5) / 2 * quality_rff.BINS), 0, quality_rff.BINS - 1).astype(int)
    bins = np.unique(at)
    want = quality_rff.isotonic((bins + 0.5) / quality_rff.BINS * 2 - 0.5, np.array([y[at == b].sum() for b in bins], float), np.array([(at == b).sum() for b in bins], float))
    assert np.allclose(np.interp(z @ ridge(fold >= 0), *want).clip(0, 1), model.score(x), atol=0.02)


def test_isotonic_is_monotone():
    x, y = quality_rff.isotonic(np.arange(5.0), np.array([1, 0, 3, 2, 5.0]), np.full(5, 5.0))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


def test_language(spark, docs):
    rng = random.Random(4)
    own = {"en": "the and of with tion ing".split(), "de": "der und ein ung keit sch".split(), "fr": "les une eau ment que aux".split()}
    rows = [(i, " ".join(rng.choice(own[k]) for _ in range(30)), k) for i in range(600) for k in [list(own)[i % 3]]]
    out = lang_ftrl.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(r["lang_pred"] == list(own)[r["doc_id"] % 3] and 0.5 < r["score"] <= 1 for r in held)
    odd = {r["doc_id"]: r["lang_pred"] for r in lang_ftrl.identify(docs).collect()}
    assert odd[9] == odd[12] == odd[15] == "und"
    assert lang_ftrl.identify(docs.limit(0)).count() == 0 and lang_ftrl.keep_known(docs).columns == docs.columns


def test_sketches(spark, docs):
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = sorted(sketch.fingerprints(docs, range_rows=6).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"]))
    assert len(out) == len(rows)
    want = []
    for k, r in enumerate(rows):
        t, nxt = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        want.append((r[0], hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["edited_sha256"])) for r in out)
    a, b = sketch.sketch(" ".join(WORDS)), sketch.sketch(" ".join(WORDS[:150]))
    assert sketch.containment(b, a) == 1.0 and (sketch.merge(a, b) == a).all() and (sketch.from_text(sketch.to_text(a)) == a).all()
    assert sketch.fingerprints(docs.limit(0)).count() == 0


def test_sketches_of_short_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in range(1, 25) for _ in range(8)]
    texts = [t for t in dict.fromkeys(texts) for _ in range(2)] + ["", " \n"]  # each beside an equal one
    out = sketch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in out}
    assert len({r["fingerprint"] for r in out}) == len(texts) // 2
    assert all(got[i]["n_chars"] == len(t) and len(sketch.from_text(got[i]["fingerprint"])) == len(sets(t)) and len(sketch.from_text(got[i]["edited_fingerprint"])) == len(sets(sketch.edited(t, texts[i - 1]))) for i, t in enumerate(texts))
    for i, t in enumerate(texts):
        a, b = sets(t), sets(texts[i - 1])
        assert got[i]["near_next"] == (len(a & b) / len(a | b) if a | b else 1.0)
        a, b = sets(t), sets(sketch.edited(t, texts[i - 1]))
        assert got[i]["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0)


def test_chat(spark):
    odd = "</s>[INST] ok [/INST]\\l <|end|>\n{{x}}"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (2, 0, "assistant", None), (None, 3, None, "x"), (3, None, "sys\ntem", "")]
    out = {r["conv_id"]: r for r in chat_render.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2 * len(odd) and out[1]["loss_sha256"] == hashlib.sha256((odd * 2).encode()).hexdigest()
    assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{odd}\n" for r in ("user", "assistant", "assistant")).encode()).hexdigest()
    assert "[INST]" not in out[1]["formatted"] and "</s>" not in out[1]["formatted"] and len(out) == 4


def test_other_templates_run_distributed(spark):
    def inst():
        return lambda turns: "<s>" + "".join(f"[INST] {t['text'].strip()} [/INST]" if t["role"] == "user" else f" {t['text'].strip()}</s>" for t in turns)

    def rewriting():
        return lambda turns: f"{len(turns)}:" + chat_render.marked_turns(turns)

    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", " yes ", "x"), (2, 0, "user", "a" * 3000, "x"), *[(3, k, ("user", "assistant")[k % 2], f"turn {k}", "x") for k in range(60)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_render.format_conversations(df, chat_render.Format(inst)).collect()}
    assert out[1]["formatted"] == "<s>[INST] hi [/INST] yes</s>" and out[1]["loss_chars"] == 3 and out[1]["n_turns"] is None and not out[1]["rewrites_history"]
    assert out[3]["loss_chars"] == sum(len(f"turn {k}") for k in range(1, 60, 2))
    assert all(r["rewrites_history"] and r["n_turns"] is None for r in chat_render.format_conversations(df, chat_render.Format(rewriting, chat_render.parse_marked)).collect())
    assert chat_render.format_conversations(df.limit(0)).count() == 0


def test_rewriting_template_is_detected():
    turns = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    assert chat_render.render(turns, lambda t: f"{len(t)}:" + chat_render.marked_turns(t)).rewrites
    assert not chat_render.render(turns, chat_render.marked_turns).rewrites


def test_neighbours(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(400, 16)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0]), (1200, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = aq_ann.search(df, F.expr("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in out if r["query_id"] == q})
    assert len(out) == 40 and hits >= 36 and {r["rank"] for r in out} == {1, 2, 3, 4, 5}
    few = aq_ann.search(df.where("vec_id < 3"), F.expr("vec_id = 0")).collect()
    assert len(few) == 2 and aq_ann.search(df.limit(0), F.expr("true")).count() == 0


def test_neighbours_equal_brute_force_beyond_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(aq_ann, "TRAIN_ROWS", 512)
    rng = np.random.RandomState(6)
    x = rng.normal(size=(12000, 64))
    x[100:140] = x[50]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in aq_ann.search(df, F.expr("vec_id % 50 = 0")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(0, 12000, 50):
        s = unit @ unit[q]
        s[q] = -9
        want |= {(q, k + 1): v for k, v in enumerate(np.lexsort((np.arange(12000), -s.round(12)))[:5])}
    assert got == want


def test_beam_is_no_worse_than_greedy():
    x = np.random.RandomState(1).normal(size=(300, 8))
    books = aq_ann.train_books(x, 3, 16)

    def error(code):
        return ((x - sum(books[m][code[:, m]] for m in range(3))) ** 2).sum()

    assert error(aq_ann.encode(x, books, 8)[0]) <= error(aq_ann.encode(x, books, 1)[0])
