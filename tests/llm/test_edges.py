"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator; and brute force on a small table."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from corvane.llm import decontamination, html_extract, langid, line_dedup, packing, pii, quality, resemblance, simhash, token_store, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, fp string, row_hash string, length int, rank int, spread string, __raw int, __stats int, key string, bytes int, text_ string"
LONG = "alpha beta gamma delta " * 30_000
LINE = "A Shared line of text "
TEXTS = [(1, f"{LINE}\nfirst"), (2, f"second\n{LINE.lower()}"), (3, None), (4, ""), (5, LONG), (6, f"second\n{LINE.lower()}"), (6, f"second\n{LINE.lower()}"), (None, f"{LINE}\nnull id"), (7, "\n\n"), (8, "9 \t x y é")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, 1, "x", "y", 2, 3, "s", 4, 5, "k", 6, "z") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "shared LINE of"), (2, None), (3, "..."), (10, "a shared line of text"), (10, "a shared line of text")], "item_id long, text string")


def result(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


OPERATORS = {
    "packing": lambda d, i: packing.pack_documents(d, VOCABULARY),
    "store": lambda d, i: token_store.round_trip(d, VOCABULARY),
    "contamination": lambda d, i: decontamination.contamination(d, i),
    "pii": lambda d, i: pii.spans(d),
    "language": lambda d, i: langid.predict(d, langid.fit(d)),
    "lines": lambda d, i: line_dedup.dedup_digest(d),
    "quality": lambda d, i: quality.judge(d, []),
    "simhash": lambda d, i: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_give_rows_and_empty_tables_none(spark, edges, items, name):
    found = OPERATORS[name](edges, items)
    ids = Counter(r["doc_id"] for r in found.collect() if r.asDict().get("piece", 0) == 0)
    assert ids == Counter(i for i, _ in TEXTS)
    assert OPERATORS[name](edges.limit(0), items).count() == 0
    assert OPERATORS[name](edges, items.limit(0)).count() == found.count()


def test_line_dedup_keeps_first_documents(edges):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in result(line_dedup.dedup_digest(edges))}
    assert {(1, 2, 0), (2, 2, 1), (3, 1, 0), (4, 1, 0), (6, 2, 1), (None, 2, 1), (7, 3, 0)} <= got
    kept = line_dedup.drop_lines(edges, line_dedup.keep_bitmaps(edges))
    assert kept.columns == edges.columns
    assert sorted(r.text for r in kept.filter("doc_id = 6").collect()) == ["second"] * 2
    assert hashlib.sha256(b"").hexdigest() in {r["kept_sha256"] for r in result(line_dedup.dedup_digest(edges))}


def test_decontamination_edges_and_proximity(spark, edges, items):
    got = {r["doc_id"]: r for r in result(decontamination.contamination(edges, items))}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["items_sha256"]) == (5, 2, hashlib.sha256(b"1,10").hexdigest())
    assert not got[5]["contaminated"] and got[5]["n_words"] == 120_000 and got[3]["n_words"] == 0
    clean = decontamination.drop_contaminated(edges, items)
    assert clean.columns == edges.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 7, 8}
    index = decontamination.build_index(edges)
    near = decontamination.proximity(index, {"p": "line a", "far": "first a"}, 2)
    assert Counter((r.phrase, r.doc_id) for r in near.collect()) == Counter({("p", 1): 1, ("p", 2): 1, ("p", 6): 2, ("p", None): 1})


def test_simhash_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    prints = got.fingerprint.map(lambda s: int(s, 16)).to_numpy(np.uint64)
    ids, root = got.doc_id.to_numpy(), got.doc_id.to_numpy().copy()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    while True:
        new = np.where(near, root[None, :], ids.max() + 1).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert (root == got.component_id.to_numpy()).all()


def groups_of_all_pairs(texts):
    """The smallest key of each one's group: at most two bits of fingerprints, or five-word shingles at 0.8."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    keys = sorted(texts)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (both and both >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_stage_joins_what_is_alike_by_brute_force(spark):
    draw = np.random.default_rng(7)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for n, i in enumerate(sorted(texts)[:120]):
        w = texts[i].split(" ")
        for at in draw.integers(0, len(w), max(1, int(len(w) * draw.uniform(0.005, 0.04)))):
            w[at] = f"changed{at}"
        texts[10_000 + n] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    expected = groups_of_all_pairs(texts)
    assert len(set(expected.values())) < len(texts) - 60
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(expected.values())


def test_edited_copies_of_one_text_have_the_groups_of_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(11)
    base = [f"w{k}" for k in draw.integers(0, 5000, 200)]
    texts = {0: " ".join(base)}
    for i in range(1, 1001):
        w = list(base)
        for at in draw.choice(200, 4, replace=False):
            w[at] = f"changed{i}x{at}"
        texts[i] = " ".join(w)
    sets = [set(resemblance.shingles(t).tolist()) for t in texts.values()]
    keys = [set(resemblance.sketch(resemblance.shingles(t))[1]) for t in texts.values()]
    expected = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and expected[i] != expected[j]:
                a, b = sorted((expected[i], expected[j]))
                expected = [a if r == b else r for r in expected]
    assert expected.count(0) > 700
    rows = simhash._described(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), "doc_id", "text", 5).checkpoint()
    of = {r.node: r.doc_id for r in rows.collect()}
    for block in (resemblance.BLOCK, 150):  # one block for each list, and several
        monkeypatch.setattr(resemblance, "BLOCK", block)
        root = list(range(len(texts)))
        for r in resemblance.links(rows).collect():
            a, b = sorted((root[of[r.src]], root[of[r.dst]]))
            root = [a if x == b else x for x in root]
        assert root == expected


def test_dense_lists_have_the_groups_of_all_pairs():
    values = np.random.default_rng(1).choice(1 << 16, 700, replace=False)
    near, root = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, np.arange(700)
    while True:
        new = np.where(near, root[None, :], 700).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert (simhash._groups(values) == root).all()


def test_simhash_keeps_one_of_each_group(edges):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5, None, 8])


def test_tokens_equal_the_library_and_shards_give_them_back(spark, edges, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    docs = edges.union(spark.createDataFrame([(40, "Don't <|endoftext|> İx, y.. z, w", "en", None, None, 1, "x", "y", 2, 3, "s", 4, 5, "k", 6, "z")], SCHEMA))
    folder = f"file://{tmp_path}/shards"
    token_store.write(docs, folder, VOCABULARY)
    for i, t in [*TEXTS, (40, "Don't <|endoftext|> İx, y.. z, w")]:
        if i is not None:
            found = token_store.lookup(folder, i)
            assert len(found) == (2 if i == 6 else 1)
            assert found[0].tolist() == library.encode(t or "", add_special_tokens=False).ids + [1]
    assert token_store.lookup(folder, 999) == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 3000)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys)) == list(range(3000))


def test_packing_holds_every_piece_without_gaps(spark):
    got = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    total, most = got.length.sum(), got.groupby("sequence_id").length.sum().max()
    assert most <= 4096 and got.sequence_id.nunique() <= -(-total // 4096) + 2
    assert all(sorted(starts) == [4096 * k for k in range(len(starts))] for _, starts in got.groupby("doc_id").start)


def test_plans_hold_the_histogram():
    histogram = {1: 5000, 7: 3, 63: 10, 1000: 33, 2048: 4, 2049: 3, 4095: 2, 4096: 9}
    held = Counter()
    for g in packing.plan(histogram):
        assert sum(n * k for n, k in g.content) <= 4096
        for n, k in g.content:
            held[n] += k * g.count
    assert held == Counter(histogram) and packing.plan({}) == []


def test_quality_statistics_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
    for d in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", d.text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = got[d.doc_id]
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(w), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert "Python" not in quality.judge(docs, rules)._jdf.queryExecution().toString()


def test_decision_list_learns_a_threshold_and_abstains_without_bad_rows():
    rows = [{"x": k / 100 + (k > 70), "y": k % 7, "bad": k > 70, "fold": k % 3} for k in range(100)]
    rules = quality.learn(rows, ("x", "y"))
    assert all(any(quality._covers(rule, r) for rule in rules) == r["bad"] for r in rows)
    assert quality.learn([r | {"bad": False} for r in rows], ("x", "y")) == []


PAGES = [
    (1, "u", "<nav>Menu</nav><article><h1>Title &amp; more</h1><p>Long text of the article, with  <b>bold</b> words and more of it.<p>Short.</article><footer>foot</footer>", "Title & more\n\nLong text of the article, with bold words and more of it.\n\nShort."),
    (2, None, None, ""), (3, "u", "", ""), (4, "u", "<div class='cookie-notice'>We use cookies</div><div id=content><p>One long paragraph of real content that goes on for a while.</p><p>Another one that is long as well, with words.</p></div><aside>Side</aside>", "One long paragraph of real content that goes on for a while.\n\nAnother one that is long as well, with words."),
    (5, "u", "<article><p>Body text is here for all to read, at some length.</p><section class=comments><p>First!</p></section><form><p>Sign up</p></form></article>", "Body text is here for all to read, at some length."),
    (6, "u", "<article><p>Cut off &am", "Cut off &am"),
]


def test_html(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    for i, _, _, text in PAGES:
        assert got[i].text == text and got[i].n_chars == len(text)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_html_keeps_every_clustered_line_without_article_or_main():
    p = ["".join(f"{k}{n} word " for n in range(60)).strip() for k in "abc"]
    para = [f"<p>{t}</p>" for t in p]
    split = f"<body><div id=content><div>{para[0]}{para[1]}</div><div>{para[2]}</div></div></body>"
    quote = f"<body><div><p>Intro here.</p><blockquote>{para[0]}{para[1]}</blockquote>{para[2]}</div></body>"
    only_quote = f"<body><div><p>He said:</p><blockquote>{para[0]}</blockquote><p>The end.</p></div></body>"
    cells = f"<body><table><tr><td>{para[0]}{para[1]}</td><td>{para[2]}</td></tr></table></body>"
    sections = f"<body><section>{para[0]}{para[1]}</section><section>{para[2]}</section></body>"
    body = f"<body><p><a href=x>Home</a> | <a href=y>About</a></p><h1>Title</h1>{para[0]}{para[1]}{para[2]}<p>One.</p><p>Two.</p><ul><li>Three</li><li>Four</li><li>Five</li></ul></body>"
    assert [html_extract.extract(x).split("\n\n") for x in (split, cells, sections)] == [p] * 3
    assert html_extract.extract(quote).split("\n\n") == ["Intro here.", *p]
    assert html_extract.extract(only_quote).split("\n\n") == ["He said:", p[0], "The end."]
    assert html_extract.extract(body).split("\n\n") == ["Title", *p, "One.", "Two.", "Three", "Four", "Five"]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, None, "same"), (2, "http://a", "same"), (None, "u", "same"), (3, "u", None), (None, "u", "alone"), (9, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (None, "revisit", 2, 4), (3, "response", None, 0), (None, "response", None, 5), (9, "response", None, 3_000_000)])
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.round_trip(pages, least=100).collect())


def test_personal_data_disguises_map_to_their_source():
    cases = {
        "write jo [at] x [dot] org now": [("email", "jo [at] x [dot] org")], "jo at mail dot example dot com": [("email", "jo at mail dot example dot com")], "jоhn@exаmple.com": [("email", "jоhn@exаmple.com")],
        "10 dot 0 dot 0 dot 1": [("ip", "10 dot 0 dot 0 dot 1")], "plus one five five five one two three four": [("phone", "plus one five five five one two three four")],
        "we met at noon. one two three.": [], "256.1.1.1": [], "4539 1488 0343 6467": [("card", "4539 1488 0343 6467")], "4539148803436468": [],
    }
    for text, expected in cases.items():
        assert [(k, text[a:b]) for k, v in pii.detect(text)[1].items() for a, b in v] == expected


def test_spaced_disguises_have_no_caps():
    labels = " dot ".join("abcdefghij")
    for text in (f"{'j' * 65} at x dot org", f"{'j' * 5000} at x dot org", f"jo at {labels}", f"jo at {'d' * 64} dot org", f"jo at x dot {'o' * 300} dot org"):
        assert [(k, f"see {text}, please"[a:b]) for k, v in pii.detect(f"see {text}, please")[1].items() for a, b in v] == [("email", text)]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.predict(docs, langid.fit(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.judge(docs, rules).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    first: dict[str, int] = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(key(line), i)
    texts = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in texts.items()}
    root = groups_of_all_pairs(texts)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontamination.words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    clean = {i for i, t in texts.items() if not any(tuple(w[k : k + n]) in windows for w in [decontamination.words(t)] for n in sizes for k in range(len(w) - n + 1))}
    library = Tokenizer.from_file(VOCABULARY)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert dict(got.groupby("doc_id").length.sum()) == {i: len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i in clean}
