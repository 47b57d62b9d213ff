"""Alignment, n-gram join and centroid clustering against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.llm import alignment, buckets, centroids, licenses, ngramjoin, queries, secrets

from . import brute
from .test_llm import AWKWARD, SF, docs, real, records, table  # noqa: F401


def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


ODD = [*AWKWARD, "  two  spaces \n then\n\n\n x\r\n y\tz ", "▁ own mark", "日本語のテキスト" * 300, "a\x00b ½ ™ ﬁ é é  x", " ", "\n", "don't 'LL we'll", "<s> </s> <unk> <0x41> x", "<|endoftext|>"]


def test_alignment(spark, monkeypatch):
    """Texts of every kind, several times, in batches, stripes and deals far smaller than meant."""
    monkeypatch.setattr(alignment, "BATCH_BYTES", 4000)
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "clash"), (None, "a null id", "x"), (7, ODD[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    want, held = brute.alignment([{"doc_id": i, "text": t} for i, t, _ in rows], *files())
    assert sorted(map(repr, map(tuple, alignment.align(df, *files()).collect()))) == sorted(map(repr, want))
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(df, *files()).collect()} == held
    assert alignment.align(df.limit(0), *files()).collect() == [] and alignment.align(df.limit(0), *files()).columns[0] == "doc_id"


def test_alignment_query(spark, real):  # noqa: F811
    want, _ = brute.alignment(records(real), *files())
    assert sorted(map(tuple, queries.op11_alignment(spark, SF).collect())) == sorted(want)


def test_alignment_refuses_other_files(tmp_path):
    with pytest.raises(ValueError):
        alignment._Pair(queries.vocabulary(), files()[1])


@pytest.mark.parametrize("words, percent", [(4, 85), (1, 60), (2, 100)])
def test_ngram_join(table, words, percent):  # noqa: F811
    want = brute.near_duplicates(records(table), words, percent)
    got = ngramjoin.jaccard_components(table.withColumn("n_shingles", F.lit("clash")), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)


def test_ngram_join_in_large_buckets(spark, monkeypatch):
    """Near copies around several texts, in chunks and with partners far fewer than the buckets': no link is lost."""
    monkeypatch.setattr(buckets, "CHUNK", 4)
    monkeypatch.setattr(buckets, "PARTNERS", 2)
    rng, rows = np.random.default_rng(5), []
    for i in range(90):
        own = [f"{'ab'[i % 2]}{k}" for k in range(80)]
        for at in rng.choice(80, rng.integers(0, 4), replace=False):
            own[at] = f"v{rng.integers(99)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.near_duplicates([{"doc_id": i, "text": t} for i, t in rows], 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(df).collect()} == want
    assert len({c for _, c in want.values()}) < 80


def test_ngram_join_filters_keep_every_link():
    """The rule, held against random pairs at the first n-gram that they share in a common order."""
    rng = np.random.default_rng(1)
    rule, kept, dropped = ngramjoin._rule(85), 0, 0
    for _ in range(400):
        base = rng.choice(5000, rng.integers(2, 60), replace=False)
        edits = rng.integers(0, 1 + len(base) // 8)
        a, b = set(base.tolist()), set(base[edits:].tolist()) | set((5000 + rng.choice(900, edits, replace=False)).tolist())
        sort_a, sort_b = sorted(a), sorted(b)
        linked = 100 * len(a & b) >= 85 * len(a | b)
        take_a, take_b = (sorted(s)[: int(ngramjoin.prefix_length(np.array(len(s)), 85))] for s in (a, b))
        common = [g for g in take_a if g in take_b]
        assert common or not linked
        if not common:
            continue
        sketch = [np.bincount(np.array(s) % 64, minlength=64).astype("<u2").view(np.uint64) for s in (sort_a, sort_b)]
        one = np.array([1])
        score = rule(sketch[0][None], sketch[1], one * len(a), len(b), one * sort_a.index(common[0]), sort_b.index(common[0]))
        assert score[0] <= ngramjoin._MOST or not linked
        kept, dropped = kept + linked, dropped + (score[0] > ngramjoin._MOST)
    assert kept > 20 and dropped > 20


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)


def test_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(300)] + [(7, rows[7][1]), (None, rows[3][1]), (None, [0.0] * 4)]
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf")] * 4), (905, [])]
    want, centres = brute.clusters(rows, 5, 3, 4)
    got, final = centroids.cluster_vectors(vectors(spark, rows), clusters=5, width=4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and final == centres


@pytest.mark.parametrize("size", [1e6, 1e4])
def test_clusters_of_large_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * size).tolist()) for i in range(40)]
    want, centres = brute.clusters(rows, 4, 3, 3)
    got, final = centroids.cluster_vectors(vectors(spark, rows), clusters=4, width=3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and final == centres
    with pytest.raises(Exception, match="beyond a long"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e200] * 3)]), width=3)[0].collect()


def test_clusters_of_few_rows(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.1, 3.0])]
    want, centres = brute.clusters(rows, 16, 3, 2)
    got, final = centroids.cluster_vectors(vectors(spark, rows), width=2)
    assert sorted(map(tuple, got.collect())) == sorted(want) and final == centres and len(final) == 3
    got, final = centroids.cluster_vectors(vectors(spark, rows[:0]), width=2)
    assert got.collect() == [] and final == []


def test_hot_join_deals_hot_keys(spark, monkeypatch):
    from entroflow.llm import common

    left = spark.createDataFrame([(1, k) for k in range(500)] + [(k, k) for k in range(2, 50)], "key long, v long")
    facts = left.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted(map(tuple, left.join(facts.drop("n"), "key").collect()))
    assert sorted(map(tuple, common.hot_join(left, facts, ["key"], "n").collect())) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, common.hot_join(left, facts, ["key"], "n").collect())) == want


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_ann_of_extreme_components(spark, size):
    """Finite vectors whose squares overflow or vanish are found in the order of their true products."""
    from entroflow.llm import ann

    x = np.random.default_rng(8).normal(size=(30, 6))
    got = ann.nearest(spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), k=4).collect()
    s = x @ x.T
    for i in range(30):
        want = [j for j in np.argsort(-s[i], kind="stable") if j != i][:4]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_contact_lists_are_no_product(spark):
    """Documents that repeat a list of addresses: the pairs of classes and words grow with words and values, not their product."""
    from entroflow.llm import pii

    mails, words = " ".join(f"u{k}@host{k}.org" for k in range(40)), " ".join(f"term{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    rows = [(i, f"{mails} {words}") for i in range(4)] + [(10 + i, f"plain text number {i} without anything") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.base_spans(docs)
    values, pairs, total = pii._term_pairs(docs, base)
    assert total == 64 and values.count() == 40 and values.select("s1", "s2").distinct().count() == 1
    assert pairs.count() == 4 * 100
    told = pii.disclosing_terms(docs, base)
    assert told.count() == 40 * 100 and told.filter("together <> 4 or documents <> 4").count() == 0

def test_license_insertions_and_templates(spark):
    """Words put into a notice, however many up to twice its length; templates given by the caller, of 1,500 words too."""
    rng = np.random.default_rng(31)
    filler = lambda n: " ".join(f"zz{x}" for x in rng.integers(0, 10**6, n))
    by_label = {label: text.split() for text, label in reversed(licenses.TEMPLATES)}
    rows, want = [], []
    for label in ("mit", "bsd"):
        for n in (0, 3, 5, 10, 40):
            w = by_label[label]
            half = len(w) // 2
            if n <= 2 * len(w):
                rows.append(f"{filler(7)} {' '.join(w[:half])} {filler(n)} {' '.join(w[half:])} {filler(9)}")
                want.append((label, 1.0))
    texts = [*rows, None, "", "permission is", rows[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, rows[0], "x")], "doc_id long, text string, LABEL string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(rows))] == want and got[None] == want[0] and got[len(texts) - 1] == want[0]
    assert all(got[len(rows) + k] == ("", 0.0) for k in range(3))

    whole = [f"w{x}" for x in rng.integers(0, 400, 1500)]
    edited = [y for k, x in enumerate(whole) for y in ((x,) if k % 40 else ("new", x))]
    cut = whole[:300] + filler(900).split() + whole[300:1200]
    docs = [" ".join(whole), "See: " + ", ".join(edited).upper(), " ".join(cut), " ".join(whole[:700]), " ".join(whole[::-1]), "w1 w2 w3 " * 2000]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    table = spark.createDataFrame([(", ".join(whole).title(), "own"), ("Short one", "short"), (None, "none"), ("a b c d", None)], "text string, label string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df, table).collect()}
    assert got[0] == ("own", 1.0) and got[1][0] == "own" and got[1][1] > 0.99 and got[2][0] == "own" and got[2][1] >= 0.8
    assert all(got[k] == ("", 0.0) for k in (3, 4, 5))
    assert [(r.first, r.last, r.label) for r in licenses.license_spans(df.filter("doc_id = 0"), table).collect()] == [(0, 1500, "own")]
    assert licenses.scan_licenses(df, []).filter("labels <> ''").count() == 0 and licenses.scan_licenses(df.limit(0)).count() == 0


def test_secret_candidates_follow_the_examples():
    """Formats of other letters, lengths and joints than the default ones: fresh strings in a sentence are found exactly."""
    rng = np.random.default_rng(4)
    low = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n, of=low + low.upper() + "0123456789": "".join(rng.choice(list(of), n))
    words = secrets.labelled_credentials()[""]
    make = {"sg": lambda: f"SG.{some(22)}.{some(43)}", "pk": lambda: "pk_" + some(13), "tok": lambda: "tok_" + some(30, low), "xx": lambda: f"xx:{some(8)}:{some(30)}"}
    for kind, f in make.items():
        formats = secrets.Formats({kind: [f() for _ in range(150)], "": words})
        found = []
        for _ in range(100):
            own = f()
            found.append(secrets.scan_text(f"use {own}. then (it)", formats) == [(3, 4, 4 + len(own))])
        assert np.mean(found) >= 0.9, kind
        assert np.mean([formats.best(x) is not None for x in words]) < 0.02 and secrets.scan_text("", formats) == []
    together = secrets.Formats({k: [f() for _ in range(150)] for k, f in make.items()} | {"": words})
    a, b = make["pk"](), make["xx"]()
    assert secrets.scan_text(f"{a},{b} and {a[:-1]}", together) == [(3, 0, 16), (3, 17, 17 + len(b))]


def test_urls_with_random_ids_are_no_secrets():
    """Ids shorter than the formats' shortest examples; a longer one looks like a credential, and is taken for one."""
    rng = np.random.default_rng(6)
    low = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n, of=low + low.upper() + "0123456789": "".join(rng.choice(list(of), n))
    formats = secrets.Formats(secrets.labelled_credentials())
    made = (lambda: f"https://x.org/watch/{some(22)}/a", lambda: f"https://cdn.example.com/assets/img_{some(11)}.png?id={some(16)}&v=2",
            lambda: f"https://news.example.com/2024/05/12/the-long-story-of-a-{some(6, low)}-{some(8, '0123456789')}.html", lambda: "https://api.example.com/items/" + "-".join(some(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)))
    for url in made:
        assert np.mean([secrets.scan_text(f"see {url()} now", formats) != [] for _ in range(200)]) < 0.02


def test_long_runs_of_joints_take_time_in_proportion():
    formats = secrets.Formats(secrets.labelled_credentials())
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        assert secrets.scan_text("path" + "/path" * n + "/1", formats) == []
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
