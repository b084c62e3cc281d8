"""Classifiers, packing, archives, extraction."""

import base64
import collections
import hashlib
import html
import math
import re
import struct
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from palimpsest.llm import extraction, ftrl, packing, quality_rules, toxicity, warc
from palimpsest.llm import queries as registered
from palimpsest.llm.words import pieces

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(y, s):
    r, n = pd.Series(s).rank().to_numpy(), y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def odd(spark):
    texts = ["", None, "one", "ü" * 5000, "word " * 40_000, "\n\n", "a"]
    return spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(0, "", 0.1), (None, "x y", 0.2)], "doc_id long, text string, score double")


# Quality classifier


def test_quality_scores_held_out_documents(spark):
    out = registered.op8_quality_classifier(spark, "/root/testdata/sf0.1").join(table(spark, "labels", "/root/testdata/sf0.1"), "doc_id").where("held_out").toPandas()
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.98
    assert (out.predicted == out.quality).mean() > 0.97 and out[out.quality == 1].predicted.mean() > 0.99
    assert [zlib.crc32(str(i).encode()) % 5 for i in out.doc_id.head(20)] == [0] * 20


def test_quality_of_odd_texts(spark):
    model = ftrl.train_quality(table(spark, "documents"), table(spark, "labels"))
    out = ftrl.score_quality(odd(spark), model).toPandas()
    assert len(out) == 9 and out.score.between(0, 1).all() and list(out.columns) == ["doc_id", "score"]
    assert out[out.doc_id == 0].score.nunique() == 1
    assert ftrl.score_quality(odd(spark).limit(0), model).count() == 0
    none = ftrl.train_quality(table(spark, "documents"), table(spark, "labels").limit(0))
    assert set(ftrl.score_quality(odd(spark), none).toPandas().score) == {0.5}
    assert ftrl.filter_quality(table(spark, "documents"), table(spark, "labels")).columns == table(spark, "documents").columns


def plain_ftrl(examples, epochs, alpha, beta, l1, l2, seed=7):
    """The updates as they are written down, one number at a time; the bias is a feature of value 1 without penalties."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            x, y = examples[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return weight


def test_training_agrees_with_plain_updates(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = docs.join(labels, "doc_id").where("quality is not null").orderBy("doc_id").limit(200).collect()
    few = docs.where(docs.doc_id.isin([r.doc_id for r in rows]))
    weights, bias, scale, bits = ftrl.train_quality(few, labels, epochs=2)
    default, examples = ftrl.Ftrl(), []
    for r in rows:
        (texts,) = pieces(pa.array([r.text]), 1 << 30)
        found = collections.Counter(ftrl.features(texts, bits)[0].tolist())
        total = sum(found.values())
        examples.append(({i: c / total * scale for i, c in found.items()} | {"bias": 1.0}, int(r.quality > 0)))
    weight = plain_ftrl(examples, 2, default.alpha, default.beta, default.l1, default.l2)
    assert bias == pytest.approx(weight("bias")) and len(rows) == 200
    seen = sorted({i for x, _ in examples for i in x if i != "bias"})
    assert weights[seen] == pytest.approx([weight(i) for i in seen], abs=1e-6) and np.count_nonzero(weights) == np.count_nonzero(weights[seen])
    got = {r.doc_id: r.score for r in ftrl.score_quality(few, (weights, bias, scale, bits)).collect()}
    for r, (x, _) in zip(rows, examples):
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()))), abs=1e-4)


def test_features_are_those_of_equal_tokens():
    (texts,) = pieces(pa.array(["The cat, the CAT -- the end", "", "cat end"]))
    i, first = ftrl.features(texts, 30)
    tokens = ["the", "cat", ",", "the", "cat", "--", "the", "end"]
    grams = i[first[0] : first[1]].reshape(-1, 3)
    for a in range(8):
        for b in range(8):
            assert (grams[a, 0] == grams[b, 0]) == (tokens[a] == tokens[b])
            assert a == 7 or b == 7 or (grams[a, 1] == grams[b, 1]) == (tokens[a : a + 2] == tokens[b : b + 2])
    assert i[first[1] : first[2]].tolist() == [0] and i[first[2] : first[3]].reshape(-1, 3)[:, 0].tolist() == [grams[1, 0], grams[7, 0]]


def test_fits_take_long_texts(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat(concat(if(id % 2 = 0, 'Plain words of a text', 'BUY! NOW! ###'), id, char(10)), 200000) as text").repartition(10)
    labels = spark.range(50).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    assert docs.selectExpr("min(length(text))").first()[0] > 2_500_000
    model = ftrl.train_quality(docs, labels, epochs=1)
    assert ftrl.train_quality(docs, labels, epochs=1, feature_bytes=1)[0].any() and np.isfinite(model[0]).all()
    crf = quality_rules.train_lines(docs, labels)
    judged = quality_rules.apply_rules(docs.limit(4), crf).collect()
    assert np.isfinite(crf.weights).all() and all(r.base_failed == (100 * r.n_repeat_words > 30 * r.n_words) for r in judged)
    assert len(toxicity.learn_toxicity(docs, labels, text_bytes=10 << 20).labels) < 10


def test_training_tables_with_clashing_columns(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    odd_docs = docs.selectExpr("*", "1 as h", "2 as id", "'x' as label", "0 as cost", "array(1) as columns", "map(1, 2) as counts")
    odd_labels = labels.selectExpr("*", "1 as h", "'y' as label", "2 as id").unionByName(spark.createDataFrame([(None, 1, 1, 1, "y", 2), (1, None, None, 1, "y", 2)], "doc_id long, quality long, toxic long, h int, label string, id int").select(*labels.columns, "h", "label", "id"))
    want, got = ftrl.train_quality(docs, labels, epochs=1), ftrl.train_quality(odd_docs, odd_labels, epochs=1)
    assert (want[0] == got[0]).all() and want[1] == got[1]
    want, got = toxicity.learn_toxicity(docs, labels), toxicity.learn_toxicity(odd_docs, odd_labels)
    assert (want.posting_weight == got.posting_weight).all() and want.ids == got.ids
    assert (quality_rules.train_lines(docs, labels).weights == quality_rules.train_lines(odd_docs, odd_labels).weights).all()


def test_ftrl_keeps_useless_features_at_zero():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        i = np.array([1 + y, 100 + rng.integers(0, 5000)])
        rows.append((i, np.full(2, 0.5), y))
    w, *_ = ftrl.Ftrl(bits=14, l1=0.5).fit(rows, 3).model()
    assert w[2] > 0.5 and w[1] < -0.5 and (w[100:] != 0).mean() < 0.01


# Toxicity


def test_toxicity_scores_held_out_documents(spark):
    out = registered.op2_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "labels", "/root/testdata/sf0.1"), "doc_id").where("held_out").toPandas()
    assert auc(out.toxic.to_numpy(), out.score.to_numpy()) > 0.95
    assert (out.predicted == out.toxic).mean() > 0.96 and out[out.toxic == 0].predicted.mean() < 0.02


def brute(index, columns, weights, k):
    n = len(index.labels)
    scores = np.zeros(n)
    for c, w in zip(columns, weights):
        first, last = index.entry_first[index.term_first[c]], index.entry_first[index.term_first[c + 1]]
        scores[index.posting_example[first:last]] += index.posting_weight[first:last] * w
    order = np.lexsort((np.arange(n), -np.round(scores, 12)))[:k]
    return order[scores[order] > 0], scores[order][scores[order] > 0]


def test_block_bounds_lose_no_neighbour():
    rng = np.random.default_rng(5)
    n, v = 1500, 60
    rows = np.repeat(np.arange(n), 6)
    pairs = np.unique(np.stack([rows, (rng.zipf(1.5, len(rows)) - 1) % v]), axis=1)
    counts = rng.integers(1, 4, pairs.shape[1])
    labels = (rng.random(n) < 0.3).astype(np.int64)
    df = np.bincount(pairs[1], minlength=v)
    index = toxicity.NearestExamples(np.arange(v).astype(np.uint64), df, pairs[0], pairs[1], counts, labels, list(range(n)), k=10, block=16)
    for _ in range(200):
        columns = np.sort(rng.choice(v, rng.integers(1, 8), replace=False))
        weights = rng.random(len(columns)) + 0.1
        weights /= np.sqrt(weights @ weights)
        got, want = index.nearest(columns, weights), brute(index, columns, weights, 10)
        assert np.allclose(got[1], want[1]) and got[0].tolist() == want[0].tolist()


def plain_terms(text):
    """How often each term of a text occurs: words and beginnings of longer words, by bytes."""
    found = collections.Counter()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        found[0, word] += 1
        for n in toxicity.PREFIXES:
            if len(word) > n:
                found[n, word[:n]] += 1
    return found


def plain_neighbours(examples, texts, min_df, strength, k):
    """Cosines of the nearest examples of each text, from the texts alone: dictionaries, and every example is compared."""
    bags, n, n1 = [plain_terms(t) for t, _ in examples], len(examples), sum(y for _, y in examples)
    df, df1 = collections.Counter(t for b in bags for t in b), collections.Counter(t for b, (_, y) in zip(bags, examples) for t in b if y)
    log_likelihood = lambda k, of, p: (k * math.log(p) if k else 0) + ((of - k) * math.log(1 - p) if k < of else 0)
    kept = set()
    for t, d in df.items():
        a, b, p = df1[t], d - df1[t], d / n
        ratio = 2 * (log_likelihood(a, n1, a / n1) + log_likelihood(b, n - n1, b / (n - n1)) - log_likelihood(a, n1, p) - log_likelihood(b, n - n1, p))
        if d >= min_df and ratio >= strength * math.log(n):
            kept.add(t)

    def vector(bag):
        v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in bag.items() if t in kept}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(b) for b in bags]
    for text in texts:
        q = vector(plain_terms(text))
        yield sorted((c for c in (sum(x * v.get(t, 0) for t, x in q.items()) for v in vectors) if c > 0), reverse=True)[:k]


def test_neighbours_are_those_of_a_plain_tf_idf(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = docs.join(labels, "doc_id").where("toxic is not null").orderBy("doc_id").limit(300).collect()
    index = toxicity.learn_toxicity(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), labels, min_df=3, strength=0.7)
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect()]
    want = list(plain_neighbours([(r.text, r.toxic) for r in rows], texts, 3, 0.7, 5))
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), index).orderBy("doc_id").collect()
    assert len(rows) == 300 and sum(bool(w) for w in want) > 40
    for r, w in zip(got, want):
        assert [e.cosine for e in r.evidence] == pytest.approx(w)


def test_toxicity_of_odd_texts(spark):
    index = toxicity.learn_toxicity(table(spark, "documents"), table(spark, "labels"))
    out = toxicity.score_toxicity(odd(spark), index).toPandas()
    assert len(out) == 9 and out.score.between(0, 1).all()
    assert toxicity.score_toxicity(odd(spark).limit(0), index).count() == 0
    none = toxicity.learn_toxicity(table(spark, "documents"), table(spark, "labels").limit(0))
    assert toxicity.score_toxicity(odd(spark), none).toPandas().score.between(0, 1).all()
    evidence = toxicity.score_toxicity(table(spark, "documents").limit(300), index).where("size(evidence) > 0").first().evidence
    assert evidence[0].cosine >= evidence[-1].cosine > 0 and evidence[0].label in (0, 1)


# Packing

TOKENIZER = registered.TOKENIZER


def check_packing(docs, out, window=2048):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, by_doc = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    for i, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return padded / max(1, total)


def test_packing_gives_every_id_one_place(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.001").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(rows, packing.pack(docs, *TOKENIZER).collect()) == 0
    odd_texts = [(0, ""), (1, None), (2, "a <|endoftext|> b"), (3, "word " * 5000), (4, "z" * 30_000), (5, "日本 🙂 \n\n  x"), (6, "")]
    odd_docs = spark.createDataFrame([(*r, 7) for r in odd_texts], "doc_id long, text string, length int")
    assert check_packing(odd_texts, packing.pack(odd_docs, *TOKENIZER).collect()) == 0
    assert packing.pack(odd_docs.limit(0), *TOKENIZER).count() == 0
    assert packing.pack(odd_docs.union(odd_docs), *TOKENIZER, window=64).groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 64


def test_both_encoders_agree(spark):
    code = packing.encoder(*TOKENIZER)
    for r in table(spark, "documents").limit(300).collect():
        assert code(r.text).tolist() == code.full.encode(r.text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 9000])
def test_encoders_agree_on_long_runs(n):
    code = packing.encoder(*TOKENIZER)
    for text in ("z" * n, "ab" * (n // 2) + " tail", "é" * n, "日本" * (n // 2), "1" * n + " x", " " * n + "x", "a\u0301" * (n // 2), "\n" * n, "!?" * (n // 2)):
        assert code(text).tolist() == code.full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shape", ["even", "long", "one length", "few", "none"])
def test_plans_place_all_tokens(shape):
    rng = np.random.default_rng(2)
    lengths = {"even": rng.integers(1, 2048, 40_000), "long": rng.integers(1100, 2048, 2000), "one length": np.full(3000, 700), "few": np.array([5, 2000, 48, 43]), "none": np.zeros(0, int)}[shape]
    histogram = np.bincount(lengths, minlength=2048)
    plan, sequences = packing.Plan(histogram, 2048, 10), {}
    for length in np.flatnonzero(histogram).tolist():
        for rank in range(histogram[length]):
            parts = plan.place(length, rank)
            assert sum(p[1] for p in parts) == length
            for _, n, sequence, offset in parts:
                sequences.setdefault(sequence, []).append((offset, n))
    assert sorted(sequences) == list(range(10, 10 + len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    if shape == "even":
        assert plan.combined > 0.9 * len(sequences)


def test_least_squares_meets_what_can_be_met():
    histogram = np.zeros(2048, np.int64)
    histogram[[1000, 1048, 500, 548]] = [300, 200, 100, 100]
    columns = [(1048, 1000), (1000, 548, 500)]
    assert packing.nonnegative_least_squares(columns, histogram, 200) == pytest.approx([200, 100], abs=1)


# WARC


def pages(spark):
    rows = [(5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (4, None, None), (2, "http://c/\r\nX: y", ""), (9, "http://d/", "é 🙂 " * 4000), (1, "http://e/", "unique"), (1, "http://e/", "unique"), (None, "http://f/", "unique"), (None, "http://g/", "other")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")


def test_archives_come_back_whole(spark, tmp_path):
    df = pages(spark)
    archives = warc.write_archives(df, f"file://{tmp_path}/w", roll_bytes=400)
    got = sorted((int(r.page) if r.page else -1, r.record_type, r.payload_bytes, r.payload_digest, int(r.refers_to) if r.refers_to else None) for r in warc.read_archives(spark, archives).collect())
    want = []
    for r in df.collect():
        payload = (r.html or "").encode()
        ids = [x.page_id for x in df.collect() if (x.html or "") == (r.html or "") and x.page_id is not None]
        first = min(ids, default=None)
        response = first is None or r.page_id == first or len([x for x in df.collect() if (x.html or "") == (r.html or "")]) == 1
        want.append((r.page_id if r.page_id is not None else -1, "response" if response else "revisit", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None if response else first))
    assert got == sorted(want, key=str) or got == sorted(want, key=lambda w: w[:4])
    assert archives.count() > 1 and archives.agg({"records": "sum"}).first()[0] == df.count()
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archive_begins_with_its_dictionary(spark, tmp_path):
    df = table(spark, "pages")
    path = warc.write_archives(df.coalesce(1), f"file://{tmp_path}/w").first().path
    content = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack_from("<II", content)
    dictionary = content[8 : 8 + size]
    assert magic == warc.DICTIONARY_FRAME and struct.unpack_from("<I", dictionary)[0] == warc.DICTIONARY_MAGIC
    reader, at, records = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), 8 + size, []
    while at < len(content):
        frame = reader.decompressobj()
        records.append(frame.decompress(content[at:]))
        at = len(content) - len(frame.unused_data)
    assert len(records) == df.count() and warc.train_dictionary(records, 64 << 10) == dictionary  # of all that is archived
    assert len(content) < len(b"".join(zstandard.ZstdCompressor(3).compress(r) for r in records))
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    data = first.decompress(content[8 + size :])
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and first.unused_data
    assert len(list(warc.read_archive(content))) == df.count()
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_archive(content[:-5]))


# Extraction


def text_of(page):
    read = extraction.read_page(page)
    return read.text(read.best_path())


def test_extraction_leaves_out_what_surrounds_the_article():
    body = "Some words of the article that are long enough to count as text. " * 3
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <div id="main" class="with-sidebar"><article class="post-12"><h1>Title &amp; more</h1><p><b>First {body}<br><p>Second&nbsp;{body}</p><div class="ad">Buy</div><form><p>Mail</p><input></form>
    <ul><li>One<li>Two</ul><blockquote>Said &lt;so&gt;</blockquote><table><tr><td>Cell</td><td>Next</td></tr></table></article>
    <section class="comments"><p>{body}{body}{body}</p></section></div><aside><p>{body}</p></aside><footer>&copy; 2024</footer></body></html>"""
    flat = body.strip()
    assert text_of(page).split("\n\n") == ["Title & more", f"First {flat}", f"Second {flat}", "One", "Two", "Said <so>", "Cell", "Next"]


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "plain words", "<p", "</p></div>", "<article><p>open", "<!--", "<script>x", "a < b and b > c", "<p>&#x110000; &bogus; &amp", "<b><i><p>x</b>y</i>", "<div>" * 3000 + "deep", "<table><td>a<td>b<tr><td>c"])
def test_extraction_survives_broken_markup(page):
    assert isinstance(text_of(page), str)


BODY = "Some words of the article that are long enough to count as text. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        ('<main><div class="side-by-side"><p>Left</p></div><div class="share-price-report">Up</div></main>', "Left\n\nUp"),
        ('<main><p>Story</p><div class="page-footer">Foot</div><div class="page-sidebar">Side</div><div class="has-sidebar">Kept</div><div id="siteFooter">x</div><div class="ad-300x250">y</div></main>', "Story\n\nKept"),
        ('<body><article><div class="notice">A notice is the story</div></article><div class="ad">Buy</div></body>', "A notice is the story"),
        ('<article><p>Story</p><p class="cookiebar">No</p><div class="sitefooter">No</div><div id="advertorial1">No</div><div class="page__menu--open">No</div><div class="addendum">Yes</div></article>', "Story\n\nYes"),
        ('<body><article></article><div class="ad">Buy</div><nav>x</nav></body>', ""),
        ('<article><p>Story</p><div class="search-form">Find</div><p class="category-news">More</p><div hidden class="x">No</div><p style="display: none">No</p></article>', "Story\n\nMore"),
        (f'<body><div class="post"><h2>Title</h2>Lead <a href="/x">text</a>.<div class="entry"><p>{BODY * 4}</p></div><a href="/next">Next story</a></div><div class="other">Else</div></body>', f"Title\n\nLead text.\n\n{(BODY * 4).strip()}"),
        (f'<body><h1>Title</h1><div class="story"><p>{BODY * 4}</p></div><h4><a href="/x">Other</a></h4></body>', f"Title\n\n{(BODY * 4).strip()}"),
    ],
)
def test_marks_and_what_stands_beside_the_winner(page, want):
    assert text_of(page) == want


HOSTILE = ["<div class=a>x", "<p><a>", "<b><div>", "<div><b>", "<i><p></i>", "<li>", "<table><td>a", "<b><i>x</b>", "<a '", '<a "', "&amp", "<", "</p>", "<select><option>", "<button>", "<button><div></button>", "<span hidden><p>", "<div x='' ", "<!-- ", "<article><div class=notice>"]


@pytest.mark.parametrize("part", HOSTILE)
def test_time_grows_with_the_page(part):
    def took(size):
        began = time.process_time()
        text_of(part * (size // len(part)))
        return time.process_time() - began

    took(10_000)
    times = [took(size) for size in (125_000, 250_000, 500_000, 1_000_000)]
    assert times[-1] < 5 and times[-1] < 0.3 + 14 * times[0]


def test_time_grows_with_attributes():
    began = time.process_time()
    assert text_of('<div x="" ' + "a" * 1_000_000 + ">y" + "<p " + "b " * 500_000 + ">z") == "y\n\nz"
    assert time.process_time() - began < 5


def plain_reading(page):
    """The article of a page of the given tables, by cutting it up at tags: no parser, no scores, no votes."""
    article = re.search(r"(?s)<article[^>]*>(.*?)</article>", page or "")
    if not article:
        return ""
    inner = re.sub(r'(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<div class="ad">.*?</div>', "", article[1])
    parts = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|table|tr|td|th|blockquote|pre)\b[^>]*>", inner)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", part))).split()) for part in parts) if t)


def test_extraction_agrees_with_a_plain_reading(spark):
    pages = table(spark, "pages")
    want = {r.page_id: plain_reading(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extraction.extract_text(pages).collect()}
    assert len(want) >= 50 and got == want


def test_heavy_hosts_give_the_same(spark):
    pages = table(spark, "pages")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(extraction.extract_text(pages, heavy=3)) == rows(extraction.extract_text(pages))


def test_hosts_vote(spark):
    body = "words that fill the story of this page and go on for a while "
    story = lambda n: f"<html><body><div class='top'>{body * 2}</div><div class='story-{n}'><p>{body * 9}</p></div></body></html>"
    short = f"<html><body><div class='top'>{body * 2}</div><div class='story-9'><p>{body}</p></div></body></html>"
    rows = [(n, "http://h/x", story(n)) for n in range(5)] + [(9, "http://h/y", short), (10, "http://other/", short), (11, None, None), (12, "no host", ""), (0, "http://h/x", story(0))]
    out = extraction.extract_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got[9] == body.strip() and got[11] == got[12] == ""
    assert got[10] != got[9]  # without the other pages' votes the larger container wins
    assert all(r.n_chars == len(r.text) for r in out)
    assert extraction.extract_text(table(spark, "pages").limit(0)).count() == 0


def test_quality_learns_from_twelve_thousand_rows(spark):
    docs = spark.range(11_000).selectExpr("id as doc_id", "concat('w', id % 97, ' v', id % 89) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model, whole = ftrl.train_quality(docs, labels, epochs=1), ftrl.train_quality(docs, labels, rows=11_000, epochs=1)
    assert (model[0] == whole[0]).all() and model[1] == whole[1]
