import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from bindery.llm import html, licenses, mixing, pieces, quality, simhash, substrings, syncmers, tokens, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
TEXTS = [
    (5, "The quick brown fox jumps over the lazy dog. " * 4), (3, "The quick brown fox jumps over the lazy dog. " * 4), (9, None), (1, ""), (2, " \t\n "), (4, "word"),
    (7, LONG), (8, LONG + " tail"), (10, "a b c " + PASSAGE + " d e f"), (11, "x y " + PASSAGE + " z"), (12, "é ü 中文 😀 ▁ <|endoftext|> it's"), (13, "la " * 500), (14, "la " * 700), (None, "no id here " + PASSAGE),
    (15, "same"), (15, "same"),
]
SCHEMA = "doc_id long, text string, source string, batch string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [None, "a", "b", "é"][k % 4], "clash", 0.5) for k, (i, t) in enumerate(TEXTS)], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_topk(spark):
    rnd = np.random.default_rng(1)
    vectors = [(i, rnd.normal(0, 1, 4).round(1).tolist()) for i in range(120)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 160)]
    vectors += [(200, None), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, []), (400, [1.0, 2.0]), (450, [1e300, 1.0, 1.0, 1.0])]
    vectors += [(7, vectors[7][1]), (50, vectors[50][1]), (100, [9.0, -9.0, 0.0, 1.0]), (None, [1.0] * 4), (11, [-1e300, 0.0, 0.0, 2.0]), (12, [2e300, 0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 5, F.col("vec_id") % 50 == 0).collect())
    whole = [(i, tuple(int(np.floor(256 * x)) if abs(x) < 1e200 else int(256 * x) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, own in sorted({(i, v) for i, v in whole if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), c) for c, v in whole if c != q and len(v) == len(own))[:5]
        want += [(q, k + 1, c, max(-(2**63), min(2**63 - 1, -s))) for k, (s, c) in enumerate(scores)]
    assert got == sorted(want) and len([g for g in got if g[0] == 100]) == 10
    assert topk.top_k(df.limit(0), 5, F.lit(True)).collect() == []


def test_topk_over_many_tiles(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 8), ("SHARD", 16), ("SUPER", 2)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(3)
    vectors = {i: rnd.integers(-3, 4, 6).tolist() for i in range(400)}
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 7, F.col("vec_id") % 5 == 0).collect())
    want = []
    for q in range(0, 400, 5):
        scores = sorted((-int(np.dot(vectors[q], v)), c) for c, v in vectors.items() if c != q)[:7]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert got == sorted(want)


def test_wide_scores_sort_as_numbers():
    values = sorted([2**64, 2**64 + 1, 2**70, 3 * 2**200, 2**63, -(2**64), -(2**64) - 5, -(2**90), 5, -5, 0], reverse=True)
    assert sorted(values, key=lambda v: (~topk.long_of(v), topk.wide_of(v))) == values


def test_substrings(docs, none):
    firsts = {}
    key = lambda i: 2**63 - 1 if i is None else i
    for i, t in sorted(TEXTS, key=lambda x: key(x[0])):
        w = words(t)
        for k in range(len(w) - 12):
            firsts.setdefault(tuple(w[k : k + 13]), key(i))
    want = []
    for i, t in TEXTS:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if firsts[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), "clash"))
    got = substrings.dedup_substrings(docs)
    assert {"source", "batch", "score"} <= set(got.columns)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, r.batch) for r in got.collect()), key=str) == sorted(want, key=str)
    assert substrings.dedup_substrings(none).collect() == []


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in TEXTS]
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(none, path).collect() == []


def test_simhash(docs, none):
    def fp(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [(i, fp(t)) for i, t in TEXTS]
    root = {f: f for _, f in fps}
    for _ in root:
        for a in root:
            for b in root:
                if bin(a ^ b).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f, least.get(root[f])) for i, f in fps]
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash.simhash_groups(none).collect() == []
    kept = [r.doc_id for r in simhash.one_of_each_group(docs).collect()]
    assert kept.count(3) == 1 and 5 not in kept and kept.count(15) == 1 and None in kept


def grouped_by_brute_force(rows):
    """The smallest (no id, id) and the text of one row for each group of near copies of rows (id, text)."""

    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(find(k), []).append((i, t))
    return groups.values()


def edited_copies():
    rnd = np.random.default_rng(8)
    rows = []
    for base in range(12):
        own = [f"b{base}w{rnd.integers(1000)}" for _ in range(120)]
        for copy in range(5):  # up to 2 changed words each: likeness from 1 to 0.7
            text = list(own)
            for at in rnd.choice(120, rnd.integers(0, 3), replace=False):
                text[at] = f"new{rnd.integers(10**6)}"
            rows.append((base * 5 + copy, " ".join(text)))
    return rows


def test_near_dedup_stage_takes_edited_copies(spark):
    import corpus_pipeline

    rows = [*edited_copies(), *TEXTS]
    rows = [(i if i is None or k < 60 else i + 1000, t) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    groups = grouped_by_brute_force(rows)
    assert 12 < len(groups) < 60
    want = [min((i is None, i or 0) for i, _ in g) for g in groups]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)
    assert simhash.one_of_each_near_copy(docs.limit(0)).collect() == []


@pytest.mark.parametrize("operator", [simhash.one_of_each_group, simhash.one_of_each_near_copy])
def test_one_of_each_group_with_null_and_repeated_ids(spark, operator):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c)]
    kept = operator(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (None, c)], key=str)


def test_bit_sliced_links_equal_brute_force():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**64, 60, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (240, 3)).astype(np.uint64)
    near = base[rnd.integers(0, 60, 240)]
    for k in range(3):
        near = near ^ np.where(rnd.random(240) < 0.5, flips[:, k], np.uint64(0))
    fps = np.unique(np.concatenate([base, near]))
    links = simhash.bit_sliced_links(fps, 2)
    for i in range(len(fps)):
        want = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist()
        got = np.flatnonzero(np.unpackbits(links[i].view(np.uint8), bitorder="little")).tolist() if i in links else [i]
        assert got == want


def test_licenses(spark, none):
    lines = list(licenses.TEMPLATES.values())
    texts = [(k, "before it all " * 30 + line + " and after " * 20, 1) for k, line in enumerate(lines)] + [(100, None, 1), (101, "the license of nothing", 1), (102, lines[0] + " " + lines[0], 1)]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string, license int")).collect()
    names = list(licenses.TEMPLATES)
    found = {(r.doc_id, r.license): r.containment for r in got}
    assert all(found.get((k, n)) == 1.0 for k, n in enumerate(names)) and found[102, names[0]] == 1.0
    assert not {100, 101} & {r.doc_id for r in got}
    for k, text, _ in texts:
        own = set(licenses.shingles_of(licenses.tokens_of(text or "")))
        for n in names:
            wanted = set(licenses.shingles_of(licenses.tokens_of(licenses.TEMPLATES[n])))
            if len(wanted & own) < 0.8 * len(wanted):
                assert (k, n) not in found
    assert licenses.scan(none).collect() == []


def test_licenses_report_every_text_that_holds_a_template(spark):
    """All pairs by brute force: a text that holds 0.8 and more of a template in one window of its length is reported, with the right share."""
    rnd, names = np.random.default_rng(12), list(licenses.TEMPLATES)
    rows, want = [], {}
    for k in range(150):
        name = names[k % len(names)]
        words = licenses.TEMPLATES[name].split()
        for _ in range(int(rnd.integers(0, 3)) if len(words) > 25 else 0):
            words[int(rnd.integers(0, len(words)))] = "changed"
        before = " ".join(f"w{x}" for x in rnd.integers(0, 500, int(rnd.integers(0, 40))))
        rows.append((None if k % 10 == 0 else k // 2, f"{before} {' '.join(words)} and so on"))
    rows += [rows[5], rows[10], (77, None), (78, ""), (79, "the license " * 40_000 + licenses.TEMPLATES["ISC"])]
    for row in set(rows):
        tokens = licenses.tokens_of(row[1] or "")
        own = licenses.shingles_of(tokens)
        for name in names:
            wanted = set(licenses.shingles_of(licenses.tokens_of(licenses.TEMPLATES[name])))
            if len(wanted & set(own)) >= 0.8 * len(wanted):
                want[row[0], name] = want.get((row[0], name), 0) + 1
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, license string, m int")
    found = licenses.scan(docs).collect()
    got = {}
    for r in found:
        got[r.doc_id, r.license] = got.get((r.doc_id, r.license), 0) + 1
    assert got == want
    best = {(r.doc_id, r.first_token) for r in found if r.best}
    assert best == {(r.doc_id, r.first_token) for r in found}


def test_quality(spark, none):
    rnd = np.random.default_rng(3)
    texts, marks = [], []
    for i in range(300):
        w = ["".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9))) for _ in range(60)]
        bad = i % 3 == 0
        texts.append((i, " ".join(x + "###" if bad and k % 2 else x for k, x in enumerate(w)), "held"))
        marks.append((i, 0 if bad else 1, 0))
    texts += [(1000, None, "x"), (1001, "", "x"), (None, "text", "x"), (5, texts[5][1], "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).withColumn("h", quality.held_out()).withColumn("p", quality.predicted()).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(300) if got[i].h]
    assert 30 < len(held) < 90 and np.mean([got[i].p == (i % 3 != 0) for i in held]) > 0.95
    assert quality.score(none, model).collect() == []
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} and quality.score(docs, model, carry=True).columns == ["doc_id", "text", "score"]


def test_html(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><article><h1>A &amp; B</h1><p>First\n part<b>icle</b>.<p>Second one, with more text in it.</article><footer>&copy; foot</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain &lt;text&gt;"), (1, "u", page)]
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = "A & B First particle. Second one, with more text in it."
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain <text>", 12), (1, want, len(want))]


@pytest.mark.parametrize("source", [
    "<html><head><title>t</title><body>{}",
    "<html><head><meta charset=x><title>t</title>{}",
    "<head><script>if (a < b) '</head>'</script><style>p</style><link rel=x>{}",
    "<body><p>Intro</p>{}".replace("<p>Intro</p>", "<svg width=1/><math/>"),
    "<body><svg><title/><path d=x><g></svg>{}",
    "<body><svg><path d='x'>{}",
    "<body><div><object data=x><video src=y><p>none</div>{}",
    "<body><object><object>none</object>none</object><template><template>none</template>none</template><canvas>none</canvas>{}",
    "<body><figure><audio src=x></figure>{}<head>",
])
def test_html_keeps_what_follows_elements_that_are_left_out(source):
    body = "<article><p>One sentence of the article.</p><p>And another one, a little longer.</p></article>"
    page = html.Page(source.format(body))
    assert page.text(np.ones(len(page.tag), bool)) == "One sentence of the article. And another one, a little longer."


def test_html_on_unseen_written_pages():
    model, hit, out, missed = html.model(), 0, 0, 0
    for source in html.pages(120, seed=5):
        page = html.Page(source)
        all_ = page.text(np.ones(len(page.tag), bool)).split()
        got = page.text(html.decode(page, model.chance(page.features()))).split()
        inside = sum(w.startswith("q") for w in got)
        hit, out, missed = hit + inside, out + len(got) - inside, missed + sum(w.startswith("q") for w in all_) - inside
    assert hit / (hit + out) > 0.95 and hit / (hit + missed) > 0.97


def test_fingerprints(docs, none):
    hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(TEXTS, key=lambda x: (x[0] is None, -(x[0] or 0), -hashes[x[1] or ""]))
    got = sorted(syncmers.compared_with_next(docs).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[5].fingerprint and 0.4 < by[7].near_edited < 0.6 and by[8].near_next > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.compared_with_next(none).collect() == []


def test_fingerprints_of_texts_of_near_lengths(spark):
    rnd = np.random.default_rng(5)
    text = " ".join("".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9))) for _ in range(80))
    pairs = [(201, 200), (205, 198), (199, 198), (240, 239), (200, 200)]
    rows = spark.createDataFrame([(text[:m], text[:n]) for m, n in pairs], "a string, b string")
    got = [r.x for r in rows.select(syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("x")).collect()]
    assert min(got) > 0.6 and got[4] == 1
    blank = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, " \t\n ")], "doc_id long, text string")
    assert len({r.fingerprint for r in syncmers.fingerprints(blank).collect()}) == 1


def test_pieces(docs, none):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    coded = pieces.decode(pieces.encode(docs, path), path)
    for r in coded.collect():
        assert list(r.piece_ids) == library.encode(r.text or "") and r.decoded == library.decode(list(r.piece_ids))
    digests = {r.doc_id: r for r in pieces.coded(docs, path).collect()}
    assert digests[5].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode(dict(TEXTS)[5]))).encode()).hexdigest()
    assert digests[7].round_trip and not digests[12].round_trip
    assert pieces.encode(none, path).collect() == [] and pieces.coded(none, path).collect() == []


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, len(words(t))) for i, t in TEXTS if i is not None)
    assert all(r.taken <= 3 * r.size for r in rows)
    many = spark.createDataFrame([(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(2000)], "doc_id long, text string, source string")
    found = mixing.mix(many)
    sums = found.groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    total = sum(r.source_size for r in sums)
    assert abs(sum(r.target for r in sums) - total) < 1e-6 * total
    assert all(abs(r.t - r.target) <= 50 and r.target <= 3 * r.source_size for r in sums)
    assert sorted(found.collect()) == sorted(mixing.mix(many.repartition(3)).collect())
    assert mixing.mixed(many).count() == found.agg(F.sum("times")).first()[0]
    assert mixing.mix(none).collect() == []


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by brute force: who would pass the limit gets it, the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    out, free = {}, list(order)
    while free:
        left = sum(sizes.values()) - sum(out.values())
        above = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= {s: most * sizes[s] for s in above}
        free = [s for s in free if s not in above]
    return out


@pytest.mark.parametrize("sizes", [{"b": 10, "a": 1000, None: 5}, {"a": 0, "b": 0}, {"x": 7}, {f"s{i}": (i * 37) ** 2 % 1009 for i in range(60)} | {None: 50_000}])
def test_targets(spark, sizes):
    slim = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.with_targets(mixing.sizes_of(slim)).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing_equals_a_sort_by_hash(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, "w " * int(rnd.integers(0, 60) ** 2 // 20), ["a", "b", "c", "d", None][int(rnd.integers(0, 5)) if i % 3 else 0]) for i in range(1500)] + [(7, "same text", "d")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("size"), mixing.row_hash("doc_id", "text").alias("h")).collect()
    sizes = {s: sum(r["size"] for r in hashed if r.source == s) for s in {r.source for r in hashed}}
    goal, want = filled(sizes), []
    for s, target in goal.items():
        own = sorted((r.h, r["size"]) for r in hashed if r.source == s)
        base = int(target / sizes[s] + 1e-12)
        rest = target - base * sizes[s]
        taken, at = set(), None
        for h in sorted({h for h, _ in own}):  # whole groups of one hash, in order, while they fit
            n = sum(n for g, n in own if g == h)
            if n > rest:
                at = h
                break
            taken.add(h)
            rest -= n
        if at is not None:
            on, fits = sum(n for g, n in own if g == at), [h for h in sorted({h for h, _ in own}) if h > at]
            cap, left, extra = int(rest), rest, set()
            for h in fits:
                n = sum(n for g, n in own if g == h and n <= cap)
                if n > left:
                    if left > n / 2:
                        extra, left = extra | {h}, n - left
                    break
                extra.add(h)
                left -= n
            if rest > 0 and on - rest < left:
                taken.add(at)
            elif rest > 0:
                want += [(s, h, n) for h, n in own if h in extra and 0 < n <= cap]
        want += [(s, h, n) for h, n in own if h in taken and n] + [(s, h, n) for h, n in own if n for _ in range(base)]
    got = mixing.mixed(df).select("source", mixing.row_hash("doc_id", "text").alias("h"), F.regexp_count("text", F.lit(r"\S+")).alias("size")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(len(r.piece_ids) > 0 for r in rows)
