"""Edge cases and brute-force versions of the llm operators."""


import hashlib
import re
import sys
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import components, html, mixing, pieces, quality, simhash, substrings, syncmers, tokens
from tests.llm.test_operators import filled, grouped_by_brute_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


# pieces


def test_suffix_arrays_of_all_sizes(library):
    text = "wordédé 中 aaaa b" * 4
    for n in range(1, 41):
        for size in {n, max(1, n - 3)}:
            part = text[:size]
            got = [i for ids in pieces.Coder(pieces.model_of(PIECES)).units([part]) for i in ids]
            assert got and pieces.model_of(PIECES).encode_units([" " + part])
            coder = pieces.Coder(pieces.model_of(PIECES))
            units = next(iter(coder.units([part])))
            flat = np.frombuffer(b"".join(coder.ids[u] for u in units), np.int32).tolist()
            assert flat == library.encode(part), part


def test_a_later_batch_with_one_short_new_unit(library):
    coder = pieces.Coder(pieces.model_of(PIECES))
    first = "one two three " * 50
    for texts in ([first], [first + "word"], ["a"], [""], ["x" * 500], ["x" * 500 + " a"]):
        for text, units in zip(texts, coder.units(texts), strict=True):
            assert np.frombuffer(b"".join(coder.ids[u] for u in units), np.int32).tolist() == library.encode(text)
    assert all(len(u) <= pieces.LONG_UNIT for u in coder.at)


def test_columns_may_have_any_name(spark, library):
    docs = spark.createDataFrame([("word", 1, 2, "old", [5])], "text string, _t int, _i int, decoded string, piece_ids array<int>")
    row = pieces.decode(pieces.encode(docs, PIECES), PIECES).first()
    assert list(row.piece_ids) == library.encode("word") and row.decoded == "word" and (row._t, row._i) == (1, 2)


def test_calls_do_not_grow_with_units(library):
    rnd = np.random.default_rng(9)
    text = " ".join("".join(rnd.choice(list("etaoinshr\n"), 9)) for _ in range(5000))
    coder, calls = pieces.Coder(pieces.model_of(PIECES), spell=True), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        units = next(iter(coder.units([text])))
    finally:
        sys.setprofile(None)
    assert len(set(units)) > 4900 and calls[0] < 5000
    ids = coder.ids
    assert np.frombuffer(b"".join(ids[u] for u in units), np.int32).tolist() == library.encode(text)


def test_digests_of_mixed_batches_equal_the_library(spark, library):
    rnd = np.random.default_rng(10)
    letters = ["a", "the", " ", "  ", "\n", "\0", "é", "中", "😀", "▁", "\ufffd", "\x80", "</s>", "<0x0A>", "q" * 60]
    texts = ["".join(rnd.choice(letters, rnd.integers(0, 40))) for _ in range(300)] + [None, "", " ", "▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in pieces.coded(docs, PIECES).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text)
        back = library.decode(ids)
        assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert (r.decoded_sha256, r.round_trip) == (hashlib.sha256(back.encode()).hexdigest(), back == text)


def test_small_batches_are_gathered():
    rows = [pa.RecordBatch.from_pydict({"n": [k], "text": [t]}) for k, t in enumerate(["a"] * 500 + ["b" * pieces.BATCH] + ["c"] * 500)]
    got = list(pieces.gathered(iter(rows)))
    assert [b.num_rows for b in got] == [500, 1, 500] and pa.Table.from_batches(got) == pa.Table.from_batches(rows)


# tokens


def test_long_pre_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, bpe, rnd = Tokenizer.from_file(path), tokens.bpe_of(path), np.random.default_rng(4)
    count = tokens.counter(path)
    for n in (199, 200, 201, 400, 3000):
        for letters in ("ab", "etaoinshr", "中文é", "#-=", "ACGT"):
            text = "".join(rnd.choice(list(letters), n))
            assert bpe.count_long(text.encode()) == len(whole.encode(text, add_special_tokens=False).ids) == count(text) == bpe.count(text.encode())
    many = tokens.Counts(bpe)
    for k in range(50):
        many["z" * (tokens.LONG + k + 1)]
    assert len(many) == len(many.start)


# quality


def test_linear_time_score_equals_all_pairs():
    rnd = np.random.default_rng(5)
    n, rows = 40, [(rnd.permutation(40)[:k].astype(np.int32), rnd.random(k).astype(np.float32)) for k in (1, 2, 7, 40)]
    model = [np.array([0.3], np.float32), rnd.normal(0, 1, n).astype(np.float32), rnd.normal(0, 1, (n, 8)).astype(np.float32)]
    sizes = np.array([len(s) for s, _ in rows])
    got, _ = quality.margins(model, np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
    for z, (slots, x) in zip(got, rows, strict=True):
        naive = 0.3 + float(model[1][slots] @ x) + sum(float(model[2][slots[i]] @ model[2][slots[j]]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(z - naive) < 1e-3


def test_quality_of_odd_rows(spark):
    texts = [(i, f"good words number {i} of a text " * (1 + i % 5), i * 10) for i in range(80)] + [(i, "### $$$ %%% " * (1 + i % 5), i) for i in range(80, 160)]
    texts += [(3, "another row of the same id", None), (3, "another row of the same id", None), (500, None, None), (501, "x", 0), (502, "long " * 300_000, 5), (None, "no id", 7)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, n_chars long, c0 string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    model = quality.fit(docs, labels, metadata=("n_chars",))
    rows = quality.score(docs, model, carry=True, metadata=("n_chars",)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows) and {r.c0 for r in rows} == {"clash"}
    same = {r.score for r in rows if r.doc_id == 3 and r.n_chars is None}
    assert len(same) == 1 and quality.score(docs.limit(0), model, metadata=("n_chars",)).collect() == []
    assert [len(x) for x in model] == [1, quality.SLOTS + (quality.N_STATISTICS + 1) * quality.BINS, quality.SLOTS + (quality.N_STATISTICS + 1) * quality.BINS]
    for slots, counts in (quality.Featurizer()(t.encode()) for t in ("", "a", "a a b", "w " * 30)):
        assert len(slots) == len(counts) + quality.N_STATISTICS and (np.diff(slots[: len(counts)]) > 0).all()


# html


class Walk(HTMLParser):
    """All text outside of raw-text elements, blocks apart: what a page without anything to leave out gives."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in html.RAW or tag == "head"
        if tag not in html.INLINE and tag not in ("img", "input", "wbr"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.raw -= tag in html.RAW or tag == "head"
        if tag not in html.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))


def test_html_text_equals_a_plain_walk():
    for source in html.pages(60, seed=9):
        page, walk = html.Page(source), Walk()
        walk.feed(source)
        walk.close()
        assert page.text(np.ones(len(page.tag), bool)) == " ".join("".join(walk.out).split())


@pytest.mark.parametrize(("source", "want"), [
    ("<p hidden>no</p><p class='a hidden'>yes</p><p HIDDEN=''>no<p>more", "yes more"),
    ("<div style='Display: none'>no<p>no</div>yes", "yes"),
    ("<svg-icon></svg-icon><video-player></video-player>yes", "yes"),
    ("&am<b>p;</b> &lt;x&gt; &#65;", "&amp; <x> A"),
    ("yes <a href='broken", "yes"),
    ("yes<!-- no > no", "yes"),
    ("</p></div></b>yes", "yes"),
    ("<title>no</title><textarea>no</textarea><script>no", ""),
])
def test_html_cases(source, want):
    page = html.Page(source)
    assert page.text(html.decode(page, np.full(len(page.nodes()), 0.9))) == want


def test_html_of_long_and_deep_pages(spark):
    deep = "<div><b>" * 8000 + "</i></p></section>" * 8000 + "text"
    long = "<article>" + "<p>A sentence, with words and marks in it.</p>" * 25_000 + "</article>"
    rows = [(1, "u", deep, "x", 1), (2, None, long, "x", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract(docs).collect()}
    assert got[2].n_chars == len(got[2].text) == 25_000 * 40 - 1 and got[None].text == ""
    assert html.extract(docs.limit(0)).collect() == [] and html.extract(docs).columns == ["page_id", "url", "text", "n_chars"]


# fingerprints


def spelled_anchors(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", syncmers.anchors(F.col("t")).alias("a")).collect()
    return {r.k: [(e.hash, e.n, e["at"]) for e in r.a] for r in rows}


def test_fingerprints_equal_brute_force(spark):
    """Closed syncmers by their definition, counted and placed, for texts of all lengths; likeness by plain counting."""
    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcde"), rnd.integers(1, 6))) for _ in range(60)]
    texts = ["", " \t", "one", "中文字符", "x" * 100, "la " * 400] + [" ".join(rnd.choice(words, n)) for n in (2, 3, 4, 5, 30, 199, 200, 201, 700)]
    token = re.compile(syncmers.TOKEN.encode().decode("unicode_escape"))
    split = [["" for _ in range(syncmers.K - 1)] + token.findall(t) + ["" for _ in range(syncmers.K - 1)] for t in texts]
    known = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for s in split for w in s}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = spelled_anchors(spark, texts)
    runs = {tuple(known[w] for w in s[i : i + 4]) for s in split for i in range(len(s) - 3)}
    names = {tuple(r.r): r.h for r in spark.createDataFrame([(list(r),) for r in runs], "r array<long>").select("r", F.shiftrightunsigned(F.xxhash64(*[F.get("r", i) for i in range(4)]), 16).alias("h")).collect()}
    for k, s in enumerate(split):
        h = [known[w] for w in s]
        places = {}
        for i in range(len(h) - 3):
            run = tuple(h[i : i + 4])
            if min(run[0], run[3]) <= min(run[1:3]):
                places.setdefault(names[run], []).append(i)
        assert got[k] == sorted((x, len(p), p[0]) for x, p in places.items()), texts[k]


def test_likeness(spark):
    rnd = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    text = " ".join(rnd.choice(words, 600))
    cut, other = text.split()[:300], " ".join(rnd.choice(words, 300))
    pairs = [(text, text), (text, " ".join(cut) + " " + other), ("la " * 400, "la " * 200 + other), (text, other), ("", ""), ("", text), (text, "begin " * 20 + text)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    one = lambda c: syncmers.anchors(F.col(c))
    got = [r.x for r in rows.select("k", syncmers.likeness(one("a"), one("b")).alias("x")).orderBy("k").collect()]
    assert got[0] == 1 and 0.42 < got[1] < 0.55 and 0.4 < got[2] < 0.6 and got[3] < 0.02 and got[4] == 1 and got[5] < 0.05 and got[6] > 0.9


@pytest.mark.parametrize("cell", [1, 64 << 20])
def test_next_rows_in_any_number_of_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(syncmers, "CELL_BYTES", cell)
    rows = [(i % 23 if i % 7 else None, f"text {i % 40}") for i in range(90)]
    got = syncmers.with_next(spark.createDataFrame(rows, "id long, text string"))
    h = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]), reverse=True)
    want = Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    assert Counter((r.id, r.text, r.next_text) for r in got.collect()) == want


def test_tokens_equal_those_of_the_pattern(spark):
    """With and without words that are cut, letters of scripts without spaces, and white space of all kinds."""
    rnd = np.random.default_rng(11)
    parts = ["a", "word", "x" * 24, "y" * 25, "z" * 49, "é" * 24, "é" * 25, "😀" * 24, "😀" * 25, "中文", "a中b", "\u0e00", "\u0dff", "\ud7b0", "\xa0", "\x85", "\x1f", "\0", "", " ", "\t", "\n", "\x0b", "\x0c", "\r", "$0 \\1"]
    texts = ["", " ", "\t\n", *parts] + [str(rnd.choice([" ", "\n", "\r\n", "  "])).join(rnd.choice(some, 12)) for some in (parts, parts[:3] + parts[14:]) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    token = re.compile(syncmers.TOKEN.encode().decode("unicode_escape"))
    for r in rows.select("t", syncmers.tokens_of(F.col("t")).alias("tokens")).collect():
        assert r.tokens == token.findall(r.t), r.t


@pytest.mark.parametrize("cell", [1, 64 << 20])
def test_each_text_is_fingerprinted_once(spark, monkeypatch, cell):
    """The next row's fingerprint is that of its own row, handed on: the plan makes two a row, of the text and of the edited one."""
    monkeypatch.setattr(syncmers, "CELL_BYTES", cell)
    docs = spark.createDataFrame([(i if i % 9 else None, " ".join(f"w{j % 50}" for j in range(i, i + i % 60))) for i in range(120)], "doc_id long, text string")
    got = syncmers.compared_with_next(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    base = docs.select(F.col("doc_id").alias("id"), "text")
    made = syncmers.with_next(base, marks=syncmers.packed(syncmers.anchors(F.col("text"))))
    one = lambda c: syncmers.unpacked(F.col(c))
    whole = lambda c: syncmers.anchors(F.col(c))
    assert made.count() == 120 and made.filter((one("marks") != whole("text")) | (one("next_marks") != whole("next_text"))).count() == 0
    near = Counter(r.x for r in made.select(syncmers.likeness(whole("text"), whole("next_text")).alias("x")).collect())
    assert Counter(r.near_next for r in got.collect()) == near and len(near) > 5
    empty = syncmers.with_next(base.limit(0), n=F.length("text"))
    assert empty.columns == ["id", "text", "n", "next_text", "next_n"] and empty.collect() == []


# substrings


@pytest.mark.parametrize("window", [7, 13, 20])
def test_every_repeated_window_is_revealed(window):
    rnd = np.random.default_rng(window)
    for _ in range(300):
        vocabulary = int(rnd.integers(1, 30))
        shared = [f"v{x}" for x in rnd.integers(0, vocabulary, window)]
        around = lambda: [f"v{x}" for x in rnd.integers(0, vocabulary, int(rnd.integers(0, 6)))]  # noqa: B023, E731
        docs = [around() + shared + around() for _ in range(2)]
        b = substrings.Batch(np.array([1, 2]), [" ".join(d).encode() for d in docs], window)
        b.name_joined(np.zeros(len(b.names), bool))
        b.windows(np.zeros(len(b.joined_names), bool))
        for begin, words in ((0, docs[0]), (len(docs[0]), docs[1])):
            for i in range(len(words) - window + 1):
                assert words[i : i + window] != shared or begin + i in b.starts


def test_symbols_are_named_alike_in_all_documents():
    """Names of the symbols of both rounds are shared by documents that share a passage, and by no others."""
    passage = " ".join(f"p{i}" for i in range(200))
    texts = [f"{k} {passage} tail{k}".encode() for k in range(3)] + [" ".join(f"other{i}" for i in range(200)).encode()]
    whole = substrings.Batch(np.arange(4), texts, 13)
    alone = [substrings.Batch(np.arange(1), [t], 13) for t in texts]
    for b in (whole, *alone):
        b.name_joined(np.ones(len(b.names), bool))
    common = set(alone[0].joined_names) & set(alone[1].joined_names) & set(alone[2].joined_names)
    assert len(common) > 60 and not common & set(alone[3].joined_names)
    assert set(whole.joined_names[whole.joined_shared]) == {n for n, c in Counter(n for b in alone for n in b.joined_names).items() if c > 1}


def test_words_are_hashed_at_once_and_told_apart(monkeypatch):
    """Equal words have equal hashes wherever they stand, others don't; only long words are hashed one by one, once each."""
    calls, digest = [], substrings.xxhash.xxh3_128_intdigest
    monkeypatch.setattr(substrings.xxhash, "xxh3_128_intdigest", lambda w: calls.append(w) or digest(w))
    words = [w for n in (*range(1, 42), 64, 100) for w in (b"a" * n, b"\0" * n, b"a" * (n - 1) + b"\0", b"b" + b"a" * (n - 1), b"a" * (n - 1) + b"\xc3", "é".encode() * n)]
    words += [b"\x1c\xc2\x85\xc2\xa0", b"\x1f"]  # no white space of ASCII
    texts = [b"", *[b" " * k + b"\t\r\n\v\f ".join(words) + b"\n" * k for k in range(9)], b" \n", b" ".join(reversed(words)), b""]
    b = substrings.Batch(np.arange(len(texts)), texts, 13)
    flat = [w for t in texts for w in t.split()]
    assert b.sizes.tolist() == [len(t.split()) for t in texts] and b.doc.tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
    assert sorted(calls) == sorted({w for w in words if len(w) > 32})
    high = b.digests(slice(None), 1)
    for hashes in (b.low.tolist(), high.tolist()):
        assert len(set(hashes)) == len(set(words)) == len(set(zip(flat, hashes, strict=True)))
    assert b.digests(np.array([5, 700, 40]), 1).tolist() == high[[5, 700, 40]].tolist() and not set(b.low) & set(high)
    assert substrings.Batch(np.arange(0), [], 13).sizes.tolist() == []


def test_columns_of_the_result_replace_those_of_the_input(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", "y")], "doc_id long, text string, n_words int, kept string, c0 string")
    row = substrings.dedup_substrings(docs).first()
    assert row.asDict() == {"doc_id": 1, "c0": "y", "n_words": 2, "n_removed": 0, "kept": "a b"}


def test_repeated_rows_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substrings, "BUCKET_NAMES", 50)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text)] * 30 + [(None, text)] * 30 + [(9, "x " + text), (2, " ".join(f"w{i}" for i in range(10, 30)))]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter([(5, 20)] * 30 + [(None, 60)] * 30 + [(9, 60), (2, 0)])


# components


def test_components(spark):
    rnd = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_wide_links_stay_within_their_cells():
    rnd = np.random.default_rng(10)
    fps = rnd.integers(0, 2**64, 200, dtype=np.uint64)
    cell = np.sort(rnd.integers(0, 30, 200))
    links = simhash.bit_sliced_links(fps, 24, cell)
    for i in range(200):
        want = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= 24) & (cell == cell[i])).tolist()
        assert (np.flatnonzero(np.unpackbits(links[i].view(np.uint8), bitorder="little")).tolist() if i in links else [i]) == want


# pipeline


def test_pipeline_equals_brute_force(spark, library):
    """run() against plain Python over the same table: scores pair by pair, all pairs of texts, all windows, a sort by hash, the library."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    bias, w, v = quality.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = []
    for r in table.collect():
        slots, counts = quality.Featurizer()((r.text or "").encode())
        x = quality.values_of(slots, counts).astype(np.float64)
        gram = (v[slots] * x[:, None]).astype(np.float64)
        z = bias[0] + w[slots] @ x + ((gram @ gram.T).sum() - (gram**2).sum()) / 2
        if 1 / (1 + np.exp(-z)) >= quality.THRESHOLD:
            rows.append((r.doc_id, r.text or "", r.source))
    source = {(i, t): s for i, t, s in rows}
    kept = sorted(min(g) for g in grouped_by_brute_force([r[:2] for r in rows]))
    firsts, texts = {}, []
    for i, t in kept:
        words = WORD.findall(t)
        for k in range(len(words) - 12):
            firsts.setdefault(tuple(words[k : k + 13]), i)
    for i, t in kept:
        words = WORD.findall(t)
        gone = {j for k in range(len(words) - 12) if firsts[tuple(words[k : k + 13])] < i for j in range(k, k + 13)}
        texts.append((i, " ".join(x for k, x in enumerate(words) if k not in gone) if gone else t, source[i, t]))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    hashed = df.select("doc_id", "text", "source", mixing.row_hash("doc_id", "text").alias("h")).collect()
    size = lambda r: len(WORD.findall(r.text))
    sizes = {s: sum(size(r) for r in hashed if r.source == s) for s in {r.source for r in hashed}}
    goal = filled(sizes)
    want, upper = Counter(), Counter()
    for r in hashed:
        n = size(r)
        base = int(goal[r.source] / sizes[r.source] + 1e-12) if sizes[r.source] else 0
        want[r.doc_id] += base * (n > 0)
        upper[r.doc_id] += (base + 1) * (n > 0)
    got = corpus_pipeline.run(spark, sf).collect()
    times, by_id = Counter(r.doc_id for r in got), {i: t for i, t, _ in texts}
    assert all(want[i] <= times[i] <= upper[i] for i in by_id) and set(times) <= set(by_id)
    for s in sizes:
        taken = sum(size(r) * times[r.doc_id] for r in hashed if r.source == s)
        assert abs(taken - goal[s]) <= max(size(r) for r in hashed if r.source == s)
    assert all(r.text == by_id[r.doc_id] and list(r.piece_ids) == library.encode(r.text) for r in got)
