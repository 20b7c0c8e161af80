"""Every operator whose result SQL can't give, against a plain computation of the same contract, and fits on odd labels."""

import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from conftest import SF
from tokenizers import Tokenizer

from corvane.llm import common, decontamination, html_extract, langid, packing, pii, quality, queries, resemblance, simhash, token_store, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(VOCABULARY)
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}


def test_pieces_have_their_ids(docs, ids):
    got = packing.pack_documents(docs, VOCABULARY).collect()
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.start, len(part), r.ids_crc32) == (4096 * r.piece, r.length, zlib.crc32(part.tobytes()))
        assert r.length == 4096 or r.start + r.length == len(ids[r.doc_id])


def test_shards_have_all_ids_in_order(docs, ids):
    start = 0
    got = {r.doc_id: r for r in token_store.round_trip(docs, VOCABULARY).collect()}
    assert len(got) == len(ids)
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])


def test_a_lookup_reads_little_and_repeated_rows_are_all_found(spark, tmp_path):
    rows = [(i // 40 if i < 4000 else i, f"text {i if i % 2 else 0}") for i in range(20_000)]
    folder = f"file://{tmp_path}/store"
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), folder, VOCABULARY)
    store = token_store.Store(folder)
    assert [len(store.lookup(k)) for k in (0, 99, 100, 4000, 19_999, 20_000, -1)] == [40, 40, 0, 1, 1, 0, 0]
    library = Tokenizer.from_file(VOCABULARY)
    assert Counter(tuple(x.tolist()) for x in store.lookup(5)) == Counter(tuple([*library.encode(t, add_special_tokens=False).ids, 1]) for k, t in rows if k == 5)
    shard = max(store.open.values(), key=lambda s: s.size("keys"))
    read, plain = [], shard.file

    class Counted:
        def read_at(self, n, at):
            read.append(n)
            return plain.read_at(n, at)

    shard.file = Counted()
    key = int(shard.entries("keys", shard.size("keys") - 1, 1)[0])
    read.clear()
    assert len(shard.get(key)) == 1 and sum(read) < 200 and shard.size("keys") > 1000


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {kind: [m.span() for m in re.finditer(pattern, text) if good(kind, m[0])] for kind, pattern in BASE.items()}


def test_base_spans_of_personal_data(spark, texts):
    odd = ["a@b.c@d.e", "@x.y", "a@@b.cd", "1.2.3.4.5.6.7.8.9", "01.002.0255.1", "4539 1488 0343 6467 1", "+1 (555) 010-9999 99 +2", "++12 34567 8", "a@b-.c..d", "é@é.é x+y@é.fr", "٣.1.1.1.1", "", "4539-1488-0343-6467." * 3]
    rows = {**texts, **{10_000 + k: t for k, t in enumerate(odd)}}
    got = pii.spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = base_spans(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base.values()))
        listed = [f"{k}:{a}:{b}" for k, spans in base.items() for a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_kernel_is_that_of_shared_grams(texts):
    some = [t for t in texts.values() if 50 < len(t) < 4000][:24]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    sets = [grams(t.lower()) for t in some]
    model = langid.train(some, ["x", "y"] * 12, landmarks=6)
    marks = [sets[i] for i in [*range(0, 12, 2), *range(1, 12, 2)]]
    exact = np.array([[len(s & m) / (len(s) * len(m)) ** 0.5 for m in marks] for s in sets])
    assert np.abs(model.kernel([langid._codes(t) for t in some]) - exact).max() < 0.02  # grams that share a hash


def test_language_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"eins zwei {i}", "de") for i in range(3000)] + [(11, "un deux trois", "fr")] * 3000 + [(i, f"one two {'x' * 2000}", f"l{i}") for i in range(300)] + [(1, None, "de"), (2, "...", "fr"), (3, "text", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    taken = Counter(r.lang for r in langid.sample(frame, 50).collect())
    assert len(taken) == langid.LANGUAGES and taken["de"] == 50 and taken["fr"] == 1
    assert langid.fit(frame.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(frame.limit(5), None).collect()} == {"und"}
    assert langid.fit(spark.createDataFrame([(1, "only one", "en")], "doc_id long, text string, lang string")).languages == ["en"]


LABELS = "doc_id long, quality int, toxic int"


def test_quality_fit_on_odd_labels(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(60))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"#{k}$ !!" for k in range(60))) for i in range(200)]
    frame = spark.createDataFrame([*good, *bad, (None, "null id"), (5000, None)] + [bad[0]] * 500, "doc_id long, text string").repartition(4)
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    odd = [(None, 0, 0), (None, 1, 0), (3, None, 0), (99_999, 0, 0), (5000, 0, 0), (4, 0, 0), (4, 1, 0), *labels[:50] * 3]
    rules = quality.fit(frame, spark.createDataFrame(labels + odd, LABELS))
    kept = {r.doc_id for r in quality.judge(frame, rules).filter("kept").collect()}
    assert rules and kept == {i for i, _ in good}
    few = quality.fit(frame, spark.createDataFrame(labels + odd, LABELS), limit=100)
    assert isinstance(few, list)
    for rows in ([], labels[:200], labels[200:], odd[:4]):
        assert quality.fit(frame, spark.createDataFrame(rows, LABELS)) == []
    assert quality.fit(frame.limit(0), spark.createDataFrame(labels, LABELS)) == []


def test_all_quality_statistics(docs, texts):
    for r in quality.judge(docs, []).collect():
        t = texts[r.doc_id]
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert r.word_chars == sum(map(len, re.findall("[^\x20\x09-\x0d]+", t)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.n_dup_lines == len(lines) - len(set(lines))


def test_fingerprints_bit_by_bit(docs, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(low))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        assert got[i] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_prefix_lists_find_all_pairs_whatever_their_length():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    family = draw.integers(0, 1 << 16, 2000).astype(np.uint64) << np.uint64(8)  # four lists of more than LIST members
    parts = [base, family]
    for _ in range(6):
        x = base.copy()
        for _ in range(draw.integers(1, 4)):
            x ^= np.uint64(1) << draw.integers(0, 64, len(x)).astype(np.uint64)
        parts.append(x)
    fp = np.unique(np.concatenate(parts)).view(np.int64)

    def batches(rows, names):
        whole = pa.RecordBatch.from_arrays([pa.array(r) for r in np.array(sorted(rows), np.int64).T], names)
        return [whole.slice(at, 300) for at in range(0, whole.num_rows, 300)]

    mask = lambda places: np.int64(simhash._bytes_mask(places))
    met = pa.Table.from_batches(list(simhash._prefix_lists(batches({(c, int(f & mask(p)), int(f)) for c, p in enumerate(simhash.PREFIXES) for f in fp}, ["combo", "kept", "fp"])))).to_pylist()
    edges = [(r["src"], r["dst"]) for r in met if r["combo"] is None]
    again = set()
    for r in met:
        if r["combo"] is not None:
            for pair in combinations([p for p in range(8) if p not in simhash.PREFIXES[r["combo"]]], 2):
                again.add((simhash._PAIRS.index(pair), int(np.int64(r["src"]) & mask(tuple(p for p in range(8) if p not in pair))), r["src"]))
    assert len(again) > 10_000
    edges += [(r["src"], r["dst"]) for b in simhash._bounded_lists(batches(again, ["left_out", "kept", "fp"])) for r in b.to_pylist()]
    place = {int(f): k for k, f in enumerate(fp)}
    root = np.arange(len(fp))
    for a, b in edges:
        a, b = sorted((root[place[a]], root[place[b]]))
        root[root == b] = a
    u, expected = fp.view(np.uint64), np.arange(len(fp))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    while True:
        new = np.where(near, expected[None, :], len(fp)).min(axis=1)
        if (new == expected).all():
            break
        expected = new
    assert (root == expected).all()


def test_twins_within_a_large_family_are_found():
    """4,500 texts at a similarity just below 0.8 to each other, and twins of 60 of them just above it."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)

    def changed(of, n):
        out = of.copy()
        out[draw.choice(len(of), n, replace=False)] = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        return out

    sets = [changed(base, 20) for _ in range(4500)]  # about 260 of 340 shared: 0.765
    twins = [changed(sets[k], 32) for k in range(60)]  # 268 of 332 shared: 0.807
    met = 0
    for k, twin in enumerate(twins):
        (a, keys), (b, others) = resemblance.sketch(np.unique(sets[k])), resemblance.sketch(np.unique(twin))
        met += bool(set(keys) & set(others)) and sum(x == y for x, y in zip(a, b, strict=True)) >= resemblance.minimum_matches(0.8)
    assert met >= 0.97 * len(twins)
    every = [np.unique(s) for s in [*sets[:300], *twins]]
    bytes_ = np.array([np.frombuffer(resemblance.sketch(s)[0], np.uint8) for s in every])
    left, right = resemblance.joined_sets(every, bytes_, resemblance.minimum_matches(0.8), 0.8)
    root = list(range(len(every)))
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    assert sum(root[k] == root[300 + k] for k in range(60)) >= 58


P = "<p>" + "Long text of a page with words. " * 10 + "</p>"
TEXT = " ".join(["Long text of a page with words."] * 10)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<body><nav>m</nav><div class='post social-science'>{P}{P}</div></body>", [TEXT] * 2),
        (f"<body><nav>m</nav><div class='related-work'>{P}{P}</div><div class='related-posts'>x</div></body>", [TEXT] * 2),
        (f"<body><form>{P}{P}<button>Go</button></form></body>", [TEXT] * 2),
        (f"<body><form><label>Name</label><input></form>{P}</body>", [TEXT]),
        (f"<body><div id=menu>{P}{P}{P}</div></body>", [TEXT] * 3),
        (f"<body><div class=comments>{P * 6}</div><div>{P}</div></body>", [TEXT]),
        (f"<body><div class=site-footer>{P}</div><div class=adSlot>x</div><div>{P}{P}</div></body>", [TEXT] * 2),
        (f"<body><div class=comments>{P}</div></body>", [""]),
        ("<body><p>a b c\n d</p></body>", ["a b c d"]),
    ],
)
def test_names_and_forms_cannot_empty_a_page(html, expected):
    assert html_extract.extract(html).split("\n\n") == expected


def test_deep_long_and_repeated_pages(spark):
    began = time.perf_counter()
    assert len(html_extract.extract("<div>a" * 200_000)) == 3 * 200_000 - 2
    assert len(html_extract.extract("<div>a<p>b<dd>" * 50_000 + "</dd></div>" * 50_000).split("\n\n")) == 100_000
    assert html_extract.extract(f"<article><p>{'word ' * 400_000}</p></article>") == " ".join(["word"] * 400_000)
    assert time.perf_counter() - began < 60
    pages = spark.createDataFrame([(1, "u", P, "x", 3)] * 3 + [(None, None, P, "y", 4)], "page_id long, url string, html string, text string, n_chars int")
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.main_text(pages).collect()) == Counter({(1, "u", TEXT, len(TEXT)): 3, (None, None, TEXT, len(TEXT)): 1})


def test_archives_give_the_pages_back(spark):
    import base64

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    clash = pages.selectExpr("*", "'x' as digest", "1 as best", "2 as first", "3 as payload")
    for frame in (pages, clash):
        got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(frame).collect()}
        assert got == {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if last[p] == i else ("revisit", last[p]))) for i, p in rows.items()}


def test_blocks_of_a_benchmark_add_up(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").repartition(3)
    whole = sorted(map(tuple, decontamination.contamination(docs, items).collect()), key=str)
    small = spark.createDataFrame(items.collect(), items.schema).repartition(40)
    assert len(decontamination._blocks(small, "item_id", "text", 10)[1]) > 20
    assert sorted(map(tuple, decontamination.contamination(docs, small).collect()), key=str) == whole


def test_queries_with_sql(spark, duck, same):
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF).toPandas(), duck.sql(sql).df())


def test_work_folders_go(spark, docs):
    before = set(common._FOLDERS)
    kept = simhash.keep_one(docs.limit(50))
    assert {f.rsplit("/", 1)[1].split("-")[0] for f in set(common._FOLDERS) - before} == {"stay"}
    assert kept.count() > 0


def test_pipeline_on_empty_tables_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    schemas = {n: spark.read.parquet(f"{SF}/{n}.parquet").schema for n in ("documents", "labels", "benchmark")}
    for n, s in schemas.items():
        spark.createDataFrame([], s).write.parquet(f"file://{tmp_path}/none/{n}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    words = " ".join(f"word{k}" for k in range(50))
    rows = [(None, words, None, None, None), (None, f"{words} end", "en", "s", 9), (1, None, None, None, None), (2, "other " + words[::-1], None, None, None)]
    spark.createDataFrame(rows, schemas["documents"]).write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for n in ("labels", "benchmark"):
        spark.createDataFrame([tuple(None for _ in schemas[n])] * 2, schemas[n]).write.parquet(f"file://{tmp_path}/odd/{n}.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()) == ["2", "None"]
