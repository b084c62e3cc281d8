"""Near-dedup against brute force; the pipeline stage by stage."""

import itertools
import os

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import near_dedup, runtime
from palimpsest.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Smallest id reachable by (id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def edited(rng, base, n):
    words = list(base)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{rng.integers(5000)}" for _ in range(n)]
    texts, passage = [], word(60)
    for size in (7, 12, 30, 150, 600):  # near copies of every length
        for _ in range(6):
            base = word(size)
            texts += [base, base, *(edited(rng, base, k) for k in (1, 1, 2, 3) if k < size)]
    hub = word(140)  # a large group around one text, of which only the closest are linked
    texts += [hub] * 30 + [edited(rng, hub, int(k)) for k in rng.integers(1, 9, 160)]
    chain = word(120)  # a chain whose ends are not linked with one another
    for _ in range(25):
        texts.append(list(chain))
        chain = edited(rng, chain, 1)
    texts += [word(100) + passage for _ in range(120)]  # a passage that many share
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    n = len(out)
    return out + [(n, ""), (n + 1, ""), (n + 2, None), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, " \n"), (n + 6, "one three"), (n + 7, "w1 " * 30_000)]


def test_components_are_those_of_all_pairs(spark, corpus):
    rows = [(i, t, "clash") for i, t in corpus]
    again = rows[:3] + rows[-260:-200]  # of the group too
    docs = spark.createDataFrame(rows + again + [(None, corpus[0][1], "x")], "doc_id long, text string, n string")
    out = near_dedup.near_duplicates(docs).collect()
    want = brute(corpus)
    assert len(out) == len(rows) + len(again) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(shingles(corpus[r.doc_id][1])), want[r.doc_id] == r.doc_id)


def test_scratch_goes_but_for_what_is_read(spark, corpus):
    shared = runtime.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = near_dedup.near_duplicates(spark.createDataFrame(corpus[:40], "doc_id long, text string"))
    left = {n.rpartition("-")[0] for n in set(os.listdir(shared)) - before}
    assert left <= {"sketches", "classes", "components"} and out.count() == 40
    before = set(os.listdir(shared))
    with pytest.raises(Exception):  # noqa: B017
        near_dedup.near_duplicates(spark.createDataFrame([(1, "x")], "doc_id long, text string").selectExpr("raise_error('no') as doc_id", "text"))
    assert set(os.listdir(shared)) == before


def test_one_id_with_several_texts(spark):
    rows = [(5, "a b c d e f g h"), (5, "k l m n o p q r"), (2, "k l m n o p q r"), (9, "a b c d e f g h"), (7, "else")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        near_dedup.near_duplicates(docs, threshold=0.1)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 1.0):
        pool = np.unique(rng.integers(1, 1 << 32, 3000, dtype=np.uint64)).astype(np.uint32)
        rng.shuffle(pool)
        n = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:n], pool[1000 : 1000 + 1000 - n]])
        true = n / (2000 - n)
        pad = lambda s: np.sort(s)[: near_dedup.K][None, :]
        got, size = near_dedup.estimates(pad(a), pad(b))
        assert size[0] == near_dedup.K and abs(got[0] - true) < 0.16
    small = np.full((2, near_dedup.K), 0xFFFFFFFF, np.uint32)
    small[0, :3], small[1, :4] = [1, 2, 3], [1, 2, 3, 4]
    assert near_dedup.estimates(small[:1], small[1:])[0][0] == 0.75


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7, 0.8, 0.85])
def test_pairs_at_any_threshold_share_enough_values(threshold):
    rng, n = np.random.default_rng(5), 1000
    common = round(n * 2 * threshold / (1 + threshold))
    shared = []
    for _ in range(2000):
        pool = rng.integers(1, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = (np.sort(s)[: near_dedup.LISTED] for s in (pool[:n], pool[n - common :]))
        shared.append(len(np.intersect1d(a, b)))
    assert min(shared) >= near_dedup.common_values(threshold) and near_dedup.common_values(0.85) == 17


def forms(n, length=100, seed=3):
    """Texts of one form with three variable words, 50 of each place: many pairs, of which few are alike."""
    rng = np.random.default_rng(seed)
    base = [f"form{i}" for i in range(length)]
    for k in range(n):
        words = list(base)
        for place, at in enumerate((length // 6, length // 2, 5 * length // 6)):
            words[at] = f"s{place}x{rng.integers(50)}"
        yield k, " ".join(words)


@pytest.mark.parametrize("length", [70, 100, 140])
def test_forms_are_linked_as_all_pairs_are(spark, length):
    rows = list(forms(900, length))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_pairs_to_verify_grow_with_the_forms(spark, monkeypatch):
    verified, plain = [], near_dedup.similar_links

    def counted(sets, pairs, threshold):
        verified[-1] += pairs.count()
        return plain(sets, pairs, threshold)

    monkeypatch.setattr(near_dedup, "similar_links", counted)
    sizes = (4000, 16_000)
    for n in sizes:
        verified.append(0)
        near_dedup.near_duplicates(spark.createDataFrame(list(forms(n)), "doc_id long, text string")).count()
    # four times the documents have sixteen times the links
    assert verified[1] < 4.6 * verified[0] and all(v < 4 * n for v, n in zip(verified, sizes))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 1), (3, 3), (2, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [1, 2, 7, *range(200, 260)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_one_after_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    from palimpsest.llm import ftrl, quality_rules
    from palimpsest.llm.runtime import stored
    from test_models_and_packing import check_packing
    from test_text_filters import plain_removal

    sources = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]
    crf, model = quality_rules.train_lines(*sources), ftrl.train_quality(*sources)
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        rows, got = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            want = {r.doc_id: rows[r.doc_id] for r in quality_rules.apply_rules(docs, crf).where("kept").collect()}
        elif name == "quality_classifier":
            want = {r.doc_id: rows[r.doc_id] for r in ftrl.score_quality(docs, model).where("score >= 0.3").collect()}
        elif name == "near_dedup":
            want = {i: rows[i] for i, c in brute(list(rows.items())).items() if i == c}
        else:
            want = {i: kept for i, t in rows.items() if (kept := plain_removal(t, items, 0.5)) is not None}
        assert got == want
        docs = out
    left = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == left
    by = {}
    for r in pieces:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert all(by[r.doc_id] == r.doc_tokens for r in pieces)
    assert check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces) == 0


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "", "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None", "None"]


def test_near_dedup_stage_takes_any_columns(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of the same id"), (2, "a b c d e f g"), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = ["(1, 'a b c d e f g')", "(1, 'other words of the same id')", "(3, '')", "(None, None)"]
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == want
    mapped = docs.selectExpr("*", "map('k', text) as more", "array(map(1, 2)) as less")
    out = corpus_pipeline.near_dedup_stage(spark, mapped, "")
    assert out.columns == mapped.columns and sorted(str((r.doc_id, r.text)) for r in out.collect()) == want


def test_pipeline_leaves_no_scratch_but_what_its_result_reads(spark):
    shared = runtime.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {n.rpartition("-")[0] for n in set(os.listdir(shared)) - before}
    assert out.count() > 0 and left <= {"pieces", "coded", "decontamination"}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_documents(spark, stage):
    sf = "/root/testdata/sf0.001"
    good = " ".join(f"word{i} and then the other{i * 7}" for i in range(40)) + "."
    texts = [good, good, None, "", " \n ", "short", "x " * 60_000, "ü" * 3000, "cc by " * 50]
    rows = [(i if i != 4 else None, t, None if i % 2 else "en", None, None, "x", 1, None, 2.0, "c", True) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key string, score double, concerned string, kept boolean"
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    out = stage(spark, docs, sf)
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or out.columns == docs.columns
    got = out.collect()
    if stage in (corpus_pipeline.quality_rules_stage, corpus_pipeline.quality_classifier_stage, corpus_pipeline.decontamination_stage):
        assert sum(r.text == good for r in got) == 3  # clean documents stay
    if stage is corpus_pipeline.near_dedup_stage:
        assert sum(r.text == good for r in got) == 1 and len(got) == len(texts) - 1
    if last:
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert stage(spark, docs.limit(0), sf).count() == 0
