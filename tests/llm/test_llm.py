"""The training-data operators against SQL, brute force, libraries, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from oracle import compare, connect
from veritab.llm import decontamination, host_reputation, html_text, licenses, near_dedup, neighbours, passages, pieces
from veritab.llm import quality, token_files, words
from veritab.llm.queries import QUERIES, SQL

EDGE = [
    (1, None, "x"), (2, "", None), (3, "   \n\t ", "x"), (4, "one", "x"), (5, "One", "x"), (None, "one two three", "x"),
    (6, "a b c d e f " * 4000, None), (6, "a b c d e f " * 4000, None), (7, "ünï 日本語 🎉 " * 30, "x"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    # Extra columns with names the operators use themselves.
    return spark.createDataFrame(EDGE, SCHEMA).withColumns(
        {c: F.lit(0) for c in ("n", "rep", "row", "h1", "h2", "_w", "_text", "band", "seed", "key", "score", "count")})


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, name):
    assert compare(spark, connect(data), data, QUERIES[name], SQL[name]) is None


def test_registered():
    assert {*QUERIES} <= {*entry.queries()}
    assert "pipeline" in QUERIES and len([n for n in QUERIES if n.startswith("op")]) >= 12


def test_word_hashes_follow_words():
    texts = [None, "", " a\tB\x0bé ", "x" * 50, "B  a"]
    places, hashes = words.word_hashes(pa.array(texts))
    assert np.diff(places).tolist() == [0, 0, 3, 1, 2]
    assert hashes[1] == hashes[4] and hashes[0] == hashes[5] and len(set(hashes.tolist())) == 4


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 2 ** 63, (2, 1000)).astype(np.uint64)
    x, y = words.distinct(np.concatenate((a, b[:250]))), words.distinct(np.concatenate((a, b[500:750])))
    s = near_dedup.set_sketches([x, y, words.distinct(np.concatenate((x, y))), x[:0]])
    assert (np.maximum(s[0], s[1]) == s[2]).all() and (s[3] == 0).all()
    true = 1000 / 1500
    got = near_dedup.joint_similarity(s[:1], s[1:2], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(got - true) < 0.09


def test_near_duplicates_of_hot_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 260):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(120)] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(50))) for i in range(260, 300)]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {*zip(t.split(), t.split()[1:])} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(root, 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in root}
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (find(i) == i) for i, r in got.items())


def test_near_pairs_in_a_family_below_the_threshold(spark):
    # Members share 300 of 400 shingles, planted pairs about 314 of 386.
    common = [f"c{i}" for i in range(301)]
    rows = [(i, common + [f"u{i}.{j}" for j in range(50)]) for i in range(200)]
    for i in range(200, 320, 2):
        both = [f"p{i}.{j}" for j in range(14)]
        rows += [(k, common + both + [f"u{k}.{j}" for j in range(36)]) for k in (i, i + 1)]
    sets = {i: {*zip(t, t[1:])} for i, t in rows}
    alike = {(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert alike == {(i, i + 1) for i in range(200, 320, 2)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).filter("NOT kept").collect()
    assert {(r["component_id"], r["doc_id"]) for r in got} == alike


def test_near_duplicates_edges(spark, edge):
    rows = [tuple(r) for r in near_dedup.near_duplicates(edge).collect()]
    assert len(rows) == len(EDGE)
    found = {r[0]: r[1:] for r in rows}
    assert found[1] == found[1][:1] + (1, True) and found[2][0] == found[3][0] == 0
    assert found[4][1:] == (4, True) and found[5][1:] == (4, False) and found[None][1:] == (None, True)
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0


def test_contained_items_edges(spark, edge):
    long = " ".join(f"k{i}" for i in range(30))
    docs = edge.select("doc_id", "text", "n", "key").unionByName(
        spark.createDataFrame([(20, "x " * 9000 + long + " y" * 9000, 0, 0), (21, long[:60], 0, 0)],
                              "doc_id long, text string, n int, key int"))
    items = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "ONE"), (None, long), (1, long)],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, items).collect()}
    assert got == {(20, 1), (4, 4), (5, 4)}
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0
    assert decontamination.contained_items(docs.limit(0), items).count() == 0


def test_chains_are_best():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 9)
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        x, y = [p[0] for p in pairs], [p[1] for p in pairs]

        def score(chain):
            gaps = sum(x[b] - x[a] + y[b] - y[a] - 2 * passages.SEED for a, b in zip(chain, chain[1:]))
            return passages.SEED * len(chain) - passages.GAP_COST * gaps

        best = max(
            score(c) for k in range(1, len(x) + 1) for c in itertools.combinations(range(len(x)), k)
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:])))
        assert score(passages.best_chains(x, y)[0]) == pytest.approx(best)


def test_passages_found_and_cut(spark):
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    p, q = draw(60), draw(100)
    changed = [w if rng.random() > 0.08 else "zz" for w in q]
    del changed[50]
    rows = [(1, draw(30) + p + draw(20)), (2, draw(10) + p), (3, p + draw(80)), (4, draw(5) + q + draw(5)),
            (5, changed), (8, draw(200)), (9, p[:45] + draw(100)), (10, p + p)]
    docs = spark.createDataFrame([(i, " ".join(t), None) for i, t in rows] + [(11, None, "x"), (None, " ".join(p), "x")],
                                 SCHEMA)
    found = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["source"]) for r in found} == {(2, 1), (3, 1), (5, 4), (10, 1)}
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(left[i] == before[i] for i in (1, 4, 8, 9, 11, None))
    assert left[2] == " ".join(rows[1][1][:10]) and left[3] == " ".join(rows[2][1][60:])
    assert len(left[5].split()) < 12 and len(left[10].split()) <= 60
    assert passages.without_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copied, changed", [((100, 60), 20), ((60, 50, 50, 55), 14), ((90, 50), 22), ((200, 60), 45)])
def test_passages_behind_a_longer_one(copied, changed):
    a, xs = [], []
    for n in copied:
        xs += range(len(a), len(a) + n - passages.SEED + 1, passages.SEED)
        a += [1] * n + [0] * changed
    a = np.array(a, np.uint32) * np.arange(1, len(a) + 1, dtype=np.uint32)
    b = np.where(a == 0, np.uint32(1 << 30), a)
    found = passages.aligned_passages(a, b, xs, xs, 50, 80)
    starts = [sum(copied[:i]) + i * changed for i in range(len(copied))]
    assert [p[:2] for p in found] == [(s, s + n - 1) for s, n in zip(starts, copied)]
    assert [p[4] for p in found] == [*copied]


def test_exact_passages_whose_seeds_were_first_elsewhere(spark):
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    p, q = draw(50), draw(70)
    rows = [(1, draw(20) + p[:25] + draw(20)), (2, draw(9) + p[25:] + draw(20)), (3, draw(30) + p + draw(7)), (4, draw(11) + p + draw(5)),
            # The first holder has a fragment at another place before the whole.
            (5, q[30:50] + draw(20) + q), (6, draw(8) + q + draw(9)), (7, q[:40] + draw(20) + q[40:]), (8, draw(60))]
    docs = spark.createDataFrame([(i, " ".join(t), None) for i, t in rows], SCHEMA)
    found = {(r["doc_id"], r["source"]): r for r in passages.repeated_passages(docs).collect()}
    assert {*found} == {(4, 3), (6, 5)}
    assert (found[4, 3]["first_word"], found[4, 3]["last_word"], found[4, 3]["source_first_word"]) == (11, 60, 30)
    assert (found[6, 5]["first_word"], found[6, 5]["last_word"], found[6, 5]["source_first_word"]) == (8, 77, 40)


def test_passages_edges(edge):
    assert passages.repeated_passages(edge).count() == 0
    assert passages.without_passages(edge).count() == len(EDGE)


def test_quality_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1, 9), (5, None, 9), (6, 0, 9), (6, 7, 9)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_scores(edge, labels.limit(0)).count() == len(EDGE)
    assert quality.quality_scores(edge.limit(0), labels).count() == 0
    assert quality.good_documents(edge, labels).columns == edge.columns


def test_pieces_like_library(spark, data, edge):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame(
        [(900 + i, t) for i, t in enumerate([" a", "a  b ", "▁x▁▁y", "<s>z</s>", "q" * 300, "\x00\x07", "é́ ﬁ  x"])],
        "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = pieces.encoded_texts(docs).collect()
    want = [(i, library.encode(t)) for i, t in texts]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), w) for i, w in want)
    digests = pieces.encoded_digests(docs).collect()
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in digests) == sorted(
        (str(i), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest(),
         hashlib.sha256(library.decode(w).encode()).hexdigest(), len(w)) for i, w in want)


def test_agenda_and_agendas_agree():
    tool = pieces.encoder(pieces.model_path())
    sample = [pieces.SPACE + w for w in ("the", "unbelievable", "xqzzy!!", "é", "日本語", "aaaaaaaaaaa", "THERHAOU!!", "\u200d")]
    assert tool.encode_many(sample) == [tuple(tool.encode_symbols(w)) for w in sample]


def test_html(spark):
    page = ("<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div>"
            "<article><h1>One &amp; two</h1><p>First <b>bo</b>ld\n text<br>more<p>Second.<form>x<input></form>"
            "<div class='comments'><p>Reader: nice</div></article><script>var a='<p>no</p>';</script><footer>F</footer></body>")
    rows = [(1, "http://a.b/x", page), (2, "http://a.b/y", None), (3, None, ""), (4, "http://c.d", "plain  text"),
            (5, "http://a.b/z", "<p>un<closed <a href='x"), (1, "http://a.b/x", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = html_text.main_texts(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and text[1] == "One & two\nFirst bold text more\nSecond."
    assert text[2] == text[3] == "" and text[4] == "plain text"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://X.example.ORG/es/1?q", "https://example.org/en/1a", "example.org/es/", "http://b.com/fr/2#t",
            "http://b.com/de", "http://b.com/de/", None, "http://bad.net/1", "http://good.net/1", "http://org", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("suffix", F.lit(1))
    bad = spark.createDataFrame(
        [(1000 + i, f"http://bad.net/{i}") for i in range(60)] + [(2000 + i, f"http://good.net/{i}") for i in range(60)],
        "page_id long, url string").withColumn("suffix", F.lit(1))
    outcomes = bad.select("page_id", (F.col("page_id") < 2000).cast("int").alias("bad")).union(
        spark.createDataFrame([(1000, None), (None, 1)], "page_id long, bad int"))
    got = {r["page_id"]: r for r in host_reputation.filtered_urls(
        pages.unionByName(bad), outcomes, host_reputation.RULES).collect()}
    expect = {0: ("x.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/1a", "example.org/en/1", "block"),
              2: ("", "", None, "allow"), 3: ("b.com", "/fr/2", "com/fr/", "allow"), 4: ("b.com", "/de", None, "allow"),
              5: ("b.com", "/de/", "com/de/", "block"), 6: ("", "", None, "allow"), 7: ("bad.net", "/1", None, "block"),
              8: ("good.net", "/1", None, "allow"), 9: ("org", "", None, "allow"), 10: ("b:", "//c/d", None, "allow")}
    assert {i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in expect} == expect
    assert host_reputation.filtered_urls(pages.limit(0), outcomes).count() == 0
    assert host_reputation.filtered_urls(pages, outcomes.limit(0)).count() == len(urls)


def test_hosts_without_outcomes(spark):
    rows = [(i, f"http://a.spam.com/{i}") for i in range(1000)] + [(1000 + i, f"http://a.good.org/{i}") for i in range(1000)]
    rows += [(3000, "http://b.spam.com/1"), (3001, "http://b.good.org/1"), (3002, "http://new.net/1"), (3003, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = pages.filter("page_id < 2000").select("page_id", (F.col("page_id") < 1000).cast("int").alias("bad"))
    got = {r["page_id"]: r for r in host_reputation.filtered_urls(pages, outcomes).filter("page_id >= 3000").collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {3000: "block", 3001: "allow", 3002: "allow", 3003: "allow"}
    assert [i for i, r in got.items() if r["bad_bound"] is None] == [3003]
    assert got[3000]["bad_bound"] > 0.9 and got[3001]["bad_bound"] < 0.1


def test_token_files(spark, data, edge, tmp_path):
    library = Tokenizer.from_file(token_files.tokenizer_path())
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").filter("doc_id > 10").unionByName(
        edge.select("doc_id", "text"))
    files, dictionary = token_files.write_token_files(docs, f"file://{tmp_path}/t")
    files = spark.createDataFrame(files.collect(), files.schema)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t", files, dictionary).collect()
    ids = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    placed = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in placed] == sorted(i or -1 for i, _ in ids)
    assert [r["start"] for r in placed] == list(np.cumsum([0] + [r["n_tokens"] for r in placed[:-1]]))


def test_token_frames_alone():
    arrays = [np.arange(n, dtype=np.uint32) * 7 for n in (0, 1, 5, 4000)]
    dictionary = token_files.train_dictionary(arrays)
    file = token_files.TokenFile(token_files.pack([3, None, 5, 6], arrays, dictionary), dictionary)
    assert file.ids == [3, None, 5, 6] and all((file[i] == a).all() for i, a in enumerate(arrays))
    with pytest.raises(ValueError):
        token_files.TokenFile(token_files.pack([1], arrays[:1], dictionary), b"\0" * 64)


def test_nearest_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16),
                                                         (None, [1.0] * 16), (3003, [1.0, None]), (3004, []), (3020, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    got = neighbours.nearest(frame).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
        assert r["score"] == pytest.approx(x[r["query_id"]] @ x[r["vec_id"]])
    hits = 0
    for q in range(0, 3000, 20):
        p = x @ x[q]
        p[q] = -np.inf
        hits += len({*np.argsort(-p)[:20].tolist()} & {*found[q]})
    assert hits >= 0.9 * 150 * 20 and set(found) == set(range(0, 3000, 20))
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_licenses(spark, edge):
    text = "Some text.\n\n" + licenses.TEMPLATES["MIT"].replace("software", "program", 1) + "\nmore words\nAll rights reserved."
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(
        [(50, text), (51, "we licensed nothing of that kind"), (52, "x\nLicensed under the Apache License, Version 2.0.\ny")],
        "doc_id long, text string"))
    got = {(r["doc_id"], r["license"]): r for r in licenses.license_blocks(docs).collect()}
    assert {*got} == {(50, "MIT"), (50, "all-rights-reserved"), (52, "Apache-2.0")}
    assert got[50, "MIT"]["n_missing"] == 1 and got[52, "Apache-2.0"]["n_missing"] == 0


def test_compression_decides_licenses(monkeypatch):
    """Templates are chosen by what they save, not by the count of their words; without savings nothing is confirmed."""
    short = "Permission granted to use this work"
    wordings = {"short": short, "long": short + " freely without any further restriction"}
    text = short + " freely without any other restriction"
    assert [h[2] for h in licenses.LicenseScanner(wordings).scan(text)] == ["long"]
    monkeypatch.setattr(licenses.LicenseScanner, "held", lambda *_: 0.0)
    assert licenses.LicenseScanner(wordings).scan(text) == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_changed_wordings_pass_the_compression(name):
    """A wording with every fifth word replaced or missing is still found between long random words."""
    scanner, chance = licenses.LicenseScanner({name: licenses.TEMPLATES[name]}), random.Random(7)
    words = scanner.words[name]
    for at in range(0, len(words), len(words) // 12 + 1):
        left = [w for i, w in enumerate(words) if (i - at) % len(words) >= len(words) // 5]
        around = ["".join(chance.choices("abdefgjkmqvxz", k=chance.randint(3, 12))) for _ in range(240)]
        block = [*around[:120], *left, *around[120:]]
        direct: set = set()
        scanner._search(block, 0, len(block), name, set(), direct)
        marked = any(licenses._MARKER.search(w) for w in left)
        if marked and direct:
            assert name in {h[2] for h in scanner.scan(" ".join(block))}


@pytest.mark.parametrize("width, prefix", [(72, ""), (76, "# "), (80, " * ")])
@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause"])
def test_wrapped_licenses(name, width, prefix):
    lines = ["import x", ""] + textwrap.wrap(licenses.TEMPLATES[name], width, initial_indent=prefix, subsequent_indent=prefix)
    got = licenses.LicenseScanner(licenses.TEMPLATES).scan("\n".join([*lines, "", "more text"]))
    assert [(g[0], g[1], g[2], g[5]) for g in got] == [(2, len(lines) - 1, name, 0)]


def test_notices_in_long_lines():
    rng = random.Random(1)
    filler = lambda: " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(150))
    text = f"{filler()} Licensed under CC BY 4.0. {filler()} All rights reserved. {filler()} ALL RIGHTS RESERVED. {filler()}"
    text += f" Licensed under license {filler()} Licensed under CC BY-NC 4.0."
    got = licenses.LicenseScanner(licenses.TEMPLATES).scan(text)
    assert [g[2] for g in got] == ["CC-BY-4.0", "CC-BY-NC-4.0", "all-rights-reserved", "all-rights-reserved"]
    assert all(g[5] == g[6] == 0 for g in got)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, data)
        assert after.columns == docs.columns, name
        seen = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < seen.count() <= docs.count()
    final = corpus_pipeline.run(spark, data)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(r["doc_id"] for r in seen.collect())
    assert decontamination.contained_items(seen, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
