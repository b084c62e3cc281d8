"""URL filters, decontamination, quality rules, license scans: against brute force and odd inputs."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import decontamination, licenses, quality_rules, urls
from palimpsest.llm import queries as registered
from palimpsest.llm.words import LETTERED, SPACED, pieces, span_hashes, windows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "", None, " \n\t ", "one", "Ünï çode 日本語 text 🙂 end", "a b c\x0bd\x0ce\x1cf", "x " * 3000, "same line\nsame line\n\nsame line", "w" * 200_000,
    "This work is licensed under CC BY-NC 4.0.\nAll rights reserved.", "ALL  rights--reserved cc/by CC by GNU General Public License, version 3", "a|b|c ### $$$ <tag> & %",
    "The quick brown fox jumps over the lazy dog and runs far away from here today", "repeat me now please repeat me now please " * 5, "\r\n\r\n", "\u212aelvin cc by",
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2] + [(None, "null id words", "x", 1)], "doc_id long, text string, n_words string, rank int")


def test_words_and_windows_agree_with_python():
    column = pa.array(TEXTS)
    for kind, pattern in ((SPACED, re.compile(r"[^\x20\x09-\x0D]+")), (LETTERED, re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))):
        for size in (1 << 20, 50):
            got = []
            for texts in pieces(column, size):
                found = words(texts, kind)
                hashes = span_hashes(texts.buf, found.start, found.end)
                for r in range(len(texts)):
                    a, b = found.first[r], found.first[r + 1]
                    got.append([texts.buf[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])])
                known = {}
                for h, s, e in zip(hashes.tolist(), found.start, found.end):
                    assert known.setdefault(h, texts.buf[s:e].tobytes()) == texts.buf[s:e].tobytes()
            assert got == [pattern.findall(t or "") for t in TEXTS]


def test_windows_of_repeated_words_differ():
    text = pa.array(["a b b a b a b a a b a a b b b a a a b b a b"])
    (texts,) = pieces(text)
    found = words(texts, SPACED)
    h, _ = windows(span_hashes(texts.buf, found.start, found.end), found.first, 5, False)
    plain = text[0].as_py().split()
    assert len(set(h.tolist())) == len({tuple(plain[i : i + 5]) for i in range(len(plain) - 4)})


# URL filters


def test_urls(spark):
    given = [
        ("https://www.Example.COM/en/x?q#f", ("www.example.com", "/en/x", "www.example.com/en/", "allow")), ("http://a.example.com/en/", ("a.example.com", "/en/", "example.com/en/", "block")),
        ("http://example.com/fr/x", ("example.com", "/fr/x", "com/", "allow")), ("http://x.net/es/1", ("x.net", "/es/1", "net/es/", "block")), ("http://x.net/es", ("x.net", "/es", None, "allow")),
        ("http://com/", ("com", "/", "com/", "allow")), ("http://com", ("com", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("no scheme.com/", ("", "", None, "allow")),
        ("x://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")), ("http://a.com?x/en/", ("a.com", "", None, "allow")), ("a://b://c.net/es/", ("b:", "//c.net/es/", None, "allow")), ("http://ÉX.net/fr/é", ("Éx.net", "/fr/é", "net/fr/", "block")),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _) in enumerate(given)] + [(0, given[0][0], "again")], "page_id long, url string, host string")
    out = urls.filter_urls(pages, registered.URL_RULES)
    got = [(r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]
    assert got == [given[0][1], *(want for _, want in given)]
    assert urls.filter_urls(pages.limit(0), registered.URL_RULES).count() == 0
    with pytest.raises(ValueError, match="more than"):
        urls.filter_urls(pages, registered.URL_RULES, max_rule_bytes=3)


def test_very_long_urls(spark):
    urls_ = ["http://" + "a." * 100_000 + "net/es/x", "http://x.net/es/" + "/y" * 200_000, "://" * 100_000, "x" * 500_000, "http://" + "b" * 300_000 + ".com/"]
    out = urls.filter_urls(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), registered.URL_RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict, len(r.host), len(r.path)) for r in out] == [("net/es/", "block", 200_003, 5), ("net/es/", "block", 5, 400_004), (None, "allow", 1, 299_996), (None, "allow", 0, 0), ("com/", "allow", 300_004, 1)]


def test_trie_agrees_with_trying_all_rules():
    rng = np.random.default_rng(1)
    labels, segments = ["a", "b", "com"], ["/", "/x", "/x/", "/x/y", "/xy/", "/x/y/z/"]
    rules = [(".".join(rng.choice(labels, rng.integers(1, 4))), str(rng.choice(segments)), str(rng.choice(["allow", "block"]))) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    trie = urls.UrlTrie(rules)
    for _ in range(2000):
        host, path = ".".join(rng.choice(labels, rng.integers(1, 5))), str(rng.choice([*segments, "", "/x/yy", "/q"]))
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie.match(host, path) == (max(fits)[2:] if fits else None)


# Decontamination


def overlaps(texts, items, window=10):
    grams = {}
    for i, t in items:
        w = LETTERS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + min(window, len(w))]), set()).add(str(i))
    for t in texts:
        w = LETTERS.findall((t or "").translate(LOWER))
        hit, which = set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if found := grams.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    which |= found
        yield len(w), len(hit), sorted(which)


ITEMS = [(1, TEXTS[12]), (2, "end"), (10, "x x x"), (3, None), (4, ""), (5, "repeat me now please repeat me now please repeat me"), (5, "repeat me now please repeat me now please repeat me"), (6, "never there at all")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_overlaps_agree_with_brute_force(spark, max_bytes):
    docs, bench = documents(spark), spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, items string")
    out = {(r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontamination.find_overlaps(docs, bench, max_bytes=max_bytes).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert out == {(i, n, h, tuple(w)) for (i, _), (n, h, w) in zip(rows, overlaps([t for _, t in rows], ITEMS))}
    assert decontamination.find_overlaps(docs, bench, max_bytes=max_bytes).count() == docs.count()


def test_overlaps_without_rows(spark):
    docs, bench = documents(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontamination.remove_overlaps(docs, bench.limit(0)).count() == docs.count()


def test_removal_leaves_nothing_of_the_benchmark(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rest = " ".join(f"own{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{rest} {passage}. {rest}", 5), (2, passage, 5), (3, rest, 5), (4, None, 5), (5, "one two three four five " + "six seven eight nine ten eleven twelve " * 2 + rest + rest, 5)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.remove_overlaps(docs, bench).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[3].text == rest and out[3].n_chars == 5 and out[4].text is None
    assert out[1].text == f"{rest} . {rest}" and out[1].n_chars == len(out[1].text)
    again = decontamination.find_overlaps(decontamination.remove_overlaps(docs, bench), bench)
    assert again.agg({"n_hit": "sum"}).first()[0] == 0


@pytest.mark.parametrize("drop_share", [0.5, 1.0])
def test_removal_by_slices_is_that_by_one(spark, drop_share):
    rng = np.random.default_rng(2)
    w = [f"w{i}" for i in range(400)]
    rest = " ".join(f"own{i}" for i in range(25))
    items = [(i, " ".join(w[i : i + 14])) for i in range(0, 380, 3)] + [(500, "tail end")]
    texts = [f"{rest} {' '.join(w[a : a + n])}, {rest}" for a, n in zip(rng.integers(0, 300, 40).tolist(), rng.integers(5, 60, 40).tolist())]
    texts += [" ".join([rest, *w[:14], rest, *w[200:214]]), " ".join([rest, *w[:20], *w[100:120]]), " ".join([*w[:5], *w[50:70], *w[5:30], rest, rest]), f"tail {items[0][1]} end {rest}", rest, None, "", "é " * 30 + items[7][1]]
    docs = spark.createDataFrame([(i, t, -1, [[i]]) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_chars long, spans array<array<long>>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.doc_id, r.text or "")
    want = sorted(decontamination.remove_overlaps(docs, bench, drop_share=drop_share).collect(), key=key)
    got = decontamination.remove_overlaps(docs, bench, drop_share=drop_share, max_bytes=2500)
    assert got.columns == docs.columns and sorted(got.collect(), key=key) == want
    assert decontamination.find_overlaps(got, bench).agg({"n_hit": "sum"}).first()[0] == 0


def plain_removal(text, items, drop_share, window=10):
    """Hit words cut out, again and again, by sets of tuples of words; None where the document goes."""
    first = True
    while True:
        at = [(m.start(), m.end()) for m in LETTERS.finditer(text.translate(LOWER))]
        ((_, hit, _),) = overlaps([text], items, window)
        grams = {tuple(w[k : k + min(window, len(w))]) for _, t in items for w in [LETTERS.findall(t.translate(LOWER))] for k in range(max(1, len(w) - window + 1) if w else 0)}
        w = LETTERS.findall(text.translate(LOWER))
        hits = sorted({j for size in {len(g) for g in grams} for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in grams for j in range(k, k + size)})
        assert len(hits) == hit
        if not hits:
            return text
        if first and hit > drop_share * len(w):
            return None
        first, cut = False, list(text)
        for j in hits:
            end = at[j + 1][0] if j + 1 in hits else at[j][1]
            cut[at[j][0] : end] = [""] * (end - at[j][0])
        text = "".join(cut)


@pytest.mark.parametrize("max_bytes, slices", [(1 << 20, 1), (60, 3), (11, 16)])
def test_removal_agrees_with_brute_force_whatever_the_slices(spark, max_bytes, slices):
    rng = np.random.default_rng(12)
    a, b, own = ([f"{x}{i}" for i in range(20)] for x in "abo")
    texts = [" ".join([*a[:10], *own[:15], *b[:10]]), " ".join([*a[:10], *own, *own, *b[:10]]), " ".join([*a[:5], *b[:10], *a[5:10], *own, *own])]
    texts += [", ".join(rng.choice([" ".join(a[i : i + 12]), " ".join(b[i : i + 9]), " ".join(own), " ".join(own[:3])]) for i in rng.integers(0, 9, 9)) for _ in range(40)]
    items = [(1, " ".join(a[:10])), (2, " ".join(b[:10])), (3, " ".join(a[3:20])), (4, " ".join(b[5:18])), (5, "a1 b1")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination._sets(bench, "item_id", "text", 10, max_bytes)[0] == slices
    got = {r.doc_id: r.text for r in decontamination.remove_overlaps(docs, bench, max_bytes=max_bytes).collect()}
    want = {i: plain_removal(t, items, 0.5) for i, t in enumerate(texts)}
    assert got == {i: t for i, t in want.items() if t is not None} and 0 not in got and 1 in got


# Quality rules


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_counts_agree_with_brute_force(spark):
    docs = documents(spark)
    out = quality_rules.apply_rules(docs, quality_rules.LineCrf())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *counts(r.text or "")) for r in docs.collect())
    for r in out.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(docs.limit(0), quality_rules.LineCrf()).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(3)
    crf = quality_rules.LineCrf(stay=0.7)
    lengths = np.array([1, 6, 3, 9])
    x = rng.integers(0, 2, (lengths.sum(), len(quality_rules.FEATURES))).astype(float)
    got, at = crf.decode(x, lengths), 0
    for n in lengths:
        e = x[at : at + n] @ crf.weights
        score = lambda y: sum(e[i] * y[i] for i in range(n)) + crf.stay * sum(y[i] == y[i - 1] for i in range(1, n))  # noqa: B023, E731
        best = max(score([s >> i & 1 for i in range(n)]) for s in range(1 << n))
        assert score(got[at : at + n].tolist()) == pytest.approx(best)
        at += n


def test_long_sequences_are_decoded_alike(monkeypatch):
    rng = np.random.default_rng(9)
    crf, lengths = quality_rules.LineCrf(stay=0.5), rng.integers(1, 40, 60)
    x = rng.integers(0, 2, (lengths.sum(), len(quality_rules.FEATURES))).astype(float)
    want = crf.decode(x, lengths)
    monkeypatch.setattr(quality_rules, "_LONG", 7)
    assert (crf.decode(x, lengths) == want).all()


def test_training_raises_the_likelihood_of_its_labels():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 12, 80)
    y = np.repeat(rng.integers(0, 2, 80), lengths).astype(float)
    x = np.zeros((len(y), len(quality_rules.FEATURES)))
    x[:, 0] = 1
    x[:, 10] = rng.random(len(y)) < np.where(y > 0, 0.7, 0.2)  # against the rule's sign
    crf = quality_rules.LineCrf().fit(quality_rules.coded(x), y, lengths)
    assert (crf.decode(x, lengths) == y).mean() > 0.9 > (quality_rules.LineCrf().decode(x, lengths) == y).mean()


def log_likelihood(crf, x, y, lengths):
    """Of labels ``y``, by summing over all label sequences of each text."""
    total, at = 0.0, 0
    for n in lengths:
        e = x[at : at + n] @ crf.weights
        score = lambda s: sum(e[i] * s[i] for i in range(n)) + crf.stay * sum(s[i] == s[i - 1] for i in range(1, n))  # noqa: B023, E731
        every = [score([k >> i & 1 for i in range(n)]) for k in range(1 << n)]
        total += score(y[at : at + n]) - np.logaddexp.reduce(every)
        at += n
    return total


def test_fit_climbs_the_likelihood_of_all_sequences():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 7, 40)
    x = rng.integers(0, 2, (lengths.sum(), len(quality_rules.FEATURES))).astype(float)
    y = (rng.random(lengths.sum()) < 0.2 + 0.6 * x[:, 3]).astype(float)
    crf = quality_rules.LineCrf().fit(quality_rules.coded(x), y, lengths, rounds=400, rate=0.05, pull=0)
    best = log_likelihood(crf, x, y, lengths)
    assert best > log_likelihood(quality_rules.LineCrf(), x, y, lengths)
    for k in range(len(crf.weights) + 1):  # no step to either side leads higher
        for step in (-0.05, 0.05):
            other = quality_rules.LineCrf(crf.weights.copy(), crf.stay)
            if k < len(crf.weights):
                other.weights[k] += step
            else:
                other.stay += step
            assert log_likelihood(other, x, y, lengths) < best + 0.02


def test_lines_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"some words of line {i} and more\n" * 1000) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    crf = quality_rules.train_lines(docs, labels, lines=5000)
    assert np.isfinite(crf.weights).all()
    assert quality_rules.train_lines(docs, labels, lines=1).stay == quality_rules.STAY  # one document alone


def test_rules_tell_labelled_documents_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.apply_rules(docs, quality_rules.train_lines(docs, labels)).join(labels, "doc_id").where("not base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.2
    assert quality_rules.train_lines(docs, labels.limit(0)).stay == quality_rules.STAY
    kept = quality_rules.filter_rules(docs, quality_rules.LineCrf())
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# License scans


def test_phrases_agree_with_brute_force(spark):
    docs = documents(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect())
    want = []
    for r in docs.collect():
        w, at, named = LETTERS.findall((r.text or "").translate(LOWER)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            named |= {label} if here else set()
        want.append((r.doc_id if r.doc_id is not None else -1, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named))))
    assert got == sorted(want)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_rules_and_suppression(spark):
    given = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "See the Mozilla Public License 2.0": "mpl-2.0", "Copyright (c) 2020 Someone. All rights reserved.": "copyright,reserved", "mit und von der license": "", "": "",
        "an elastic artistic license for boost software and apache 2": "artistic-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy": "permissive-text",
    }
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    out = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    assert [r.labels for r in out] == list(given.values())
    assert all((r.score > 0) == bool(r.labels) and r.score <= 1 for r in out)


def test_every_rule_passes_the_gate_and_nothing_leaves_the_jvm(spark):
    table = licenses.rules()
    assert sum(map(len, table.values())) >= 200
    for keyword, of in table.items():
        for rule in of:
            surely = licenses.surely(rule["pattern"]).replace("[sc]", "c")
            assert any(g in surely for g in licenses.GATE), rule
            assert keyword in rule["pattern"], rule
    plan = licenses.scan_licenses(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def matches(pattern):
    """Texts that ``pattern`` matches: every alternative, with all that may be missing and with nothing of it."""

    def of(items, full):
        found = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = [chr(arg[0][1])] if str(arg[0][0]) == "LITERAL" else ["3"]
            elif op == "SUBPATTERN":
                more = of(arg[-1], full)
            elif op == "BRANCH":
                more = [t for branch in arg[1] for t in of(branch, full)]
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                more = of(arg[2], full)[:1] if full or arg[0] else [""]
            else:
                assert op in ("ASSERT", "AT"), op
                more = [""]
            found = [a + b for a in found for b in more]
        return found

    return {t for full in (False, True) for t in of(re._parser.parse(pattern), full)}


def test_every_alternative_is_found_alone(spark):
    table = licenses.rules()
    alone = sorted({t for of in table.values() for rule in of for t in matches(rule["pattern"])})
    for rule in {r["pattern"]: r for of in table.values() for r in of}.values():
        keywords = [k for k, of in table.items() if rule in of]
        assert all(re.fullmatch(rule["pattern"][6:-5], t) and any(k in t for k in keywords) for t in matches(rule["pattern"])), rule
    docs = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string").repartition(4)
    assert [alone[r.doc_id] for r in licenses.scan_licenses(docs).where("labels = ''").collect()] == []


def test_grants_without_the_word_license(spark):
    given = {"Released under the GPL v3": "gpl-3.0", "Distributed under the MIT.": "mit", "It is available under Apache 2.0": "apache-2.0", "Provided to you only according to the terms of BSD": "bsd", "she lived under MIT": ""}
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()] == list(given.values())


def test_bare_abbreviations(spark):
    given = {"Licensed under the GNU GPL": "gpl", "the MPL 2.0 license": "mpl-2.0", "Licensed under MPL": "mpl", "EPL license": "epl", "License: EPL v1.0": "epl-1.0", "Released under the GPL v3": "gpl-3.0", "licensed under the MPL 1.1": "mpl-1.1", "Licensed under LGPL": "lgpl"}
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()] == list(given.values())


def plain_scan(text):
    """Labels and score by trying every rule at every place and comparing all detections in pairs."""
    w = LETTERS.findall((text or "").translate(LOWER))
    norm, found, named = " " + " ".join(w) + " ", set(), set()
    for keyword, of in licenses.rules().items():
        if keyword in norm:
            found |= {(m.start(), m.end(), r["kind"], r["rank"], r["label"], r["confidence"]) for r in of for m in re.finditer(r["pattern"], norm)}
    within = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or o[2:] < d[2:])
    outer = [d for d in found if not any(within(d, o) for o in found)]
    left = [d for d in outer if not any(o[2] < d[2] and o[0] < d[1] and d[0] < o[1] for o in outer)]
    for phrase, label in licenses.PHRASES:
        if f" {phrase} " in norm:
            named.add(label)
    return ",".join(sorted(named | {d[4] for d in left})), max([0.5] * bool(named) + [d[5] for d in left], default=0.0)


def test_labels_and_scores_agree_with_trying_all_rules(spark):
    rng = np.random.default_rng(6)
    parts = "the|mit|license|is|apache 2.0|licensed under|released under the|gnu|general public license|v3|version 2|cc by|nc 4.0|sa|all rights reserved|copyright 2019 2020|of|terms of use|bsd 3 clause|spdx license identifier|mozilla public|and|public domain|placed in the public domain|lesser|agpl|https www apache org licenses license 2 0|or later|permission".split("|")
    texts = [" ".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(1500)]
    texts += ["the mit license is apache 2.0", "the mit license is apache 2.0 license mit", *(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '(?i)licen|rights reserved|cc by'").collect())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)} and got[1500][0] == "apache-2.0"
    assert sum(bool(labels) for labels, _ in got.values()) > 700


@pytest.mark.parametrize("part", ["all rights reserved ", "licensed under the mit license is apache 2.0 all rights reserved ", "copyright 2001 "])
def test_time_grows_with_the_matches(spark, part):
    def took(size):
        docs = spark.createDataFrame([(1, part * (size // len(part)))], "doc_id long, text string").coalesce(1)
        frame, began = licenses.scan_licenses(docs), time.time()
        assert frame.collect()[0].labels
        return time.time() - began

    took(1000)
    times = [took(size) for size in (125_000, 250_000, 500_000, 1_000_000)]
    assert times[-1] < 5 and times[-1] < 1 + 14 * times[0]


def test_counts_and_phrases_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    for name in ("quality_counts", "license_phrases"):
        got, want = registered.queries()[name](spark, sf), con.execute(registered.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_digest_of_items_is_of_sorted_strings(spark):
    out = {r.doc_id: r for r in registered.op4_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert any(r.contaminated for r in out.values())
    clean = next(r for r in out.values() if not r.contaminated)
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest() and clean.n_items == 0
