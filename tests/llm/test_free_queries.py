"""Queries beyond SQL against brute-force versions, round trips and held-out accuracy."""

import collections
import glob
import hashlib
import html as entities
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.llm import common, html_extract, jaccard_join, neural_lm, token_shards, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, cls long, slot int"


def table(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(2).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Families of near copies, exact copies, a frequent passage, toxic texts, nulls, empty and long texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    out, passage = [], text(60)
    for _ in range(12):
        base = text(rng.randint(40, 200))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    out += [" ".join(passage + text(rng.randint(10, 40))) for _ in range(60)] + [out[0]] * 20 + [" ".join(text(rng.randint(1, 6))) for _ in range(40)]
    out += [None, "", " \n", "Same Word", "same word", "same  WORD", " ".join(text(15000))] + [" ".join(text(80)) for _ in range(150)]
    for k in range(150):
        w = text(rng.randint(20, 90))
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["vilefool", "dirtbrain", "rotface"])
        out.append(" ".join(w))
    rows = [(i, t, "en", "s", 0, "r", 1, 2) for i, t in enumerate(out)]
    rows += [(None, out[3], "en", "s", 0, "r", 1, 2), (None, "nothing like the rest of them all", None, None, None, None, None, None), rows[5], rows[5]]
    folder, none = str(tmp_path_factory.mktemp("corpus")), str(tmp_path_factory.mktemp("empty"))
    table(spark, folder, "documents", rows, DOCS)
    table(spark, folder, "labels", [(i, 1, int(any(b in (t or "") for b in ("vilefool", "dirtbrain", "rotface")))) for i, t in enumerate(out)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    table(spark, folder, "benchmark", [(1, " ".join(passage[:20])), (None, None)], "item_id long, text string")
    table(spark, none, "documents", [], DOCS)
    table(spark, none, "labels", [], "doc_id long, quality int, toxic int")
    table(spark, none, "benchmark", [], "item_id long, text string")
    table(spark, none, "pages", [], "page_id long, url string, html string")
    return folder, none, rows


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)].append(r[0])
    return [(r[0], len(sets[k]), min(ids[find(k)], default=None) if sets[k] else r[0]) for k, r in enumerate(rows)]


def test_jaccard_join(spark, corpus):
    folder, none, rows = corpus
    got = entry.queries()["op2_jaccard_join"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(groups(rows))
    assert entry.queries()["op2_jaccard_join"](spark, none).count() == 0


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 3])
def test_jaccard_join_finds_all_links(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    folder, none, rows = corpus
    sets = [shingles(r[1]) for r in rows]
    like = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    want = collections.Counter((r[0], sum(like(s, o) for o in sets)) for r, s in zip(rows, sets))
    assert max(n for _, n in want) > 5
    got = entry.queries()["op2_jaccard_join"](spark, folder).select("doc_id", "n_links").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_jaccard_join_of_many_near_copies_verifies_few_pairs(spark, monkeypatch):
    """Copies at the border of similarity, some of which link with none: whole sets of few pairs are compared."""
    rng, seen, plain = np.random.default_rng(5), [], jaccard_join.verified

    def counted(pairs, *args):
        seen.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.choice(150, 3 if k < 300 else 8, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, want = [shingles(t) for _, t in rows], list(range(400))
    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                lo, hi = sorted((want[a], want[b]))
                want = [lo if w == hi else w for w in want]
    assert len(set(want)) > 20 and got == dict(enumerate(want))
    assert sum(seen) < 20 * len(rows), seen


def linked(rows):
    """Smallest number of each row's component, by all pairs."""
    sets, want = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                lo, hi = sorted((want[a], want[b]))
                want = [lo if w == hi else w for w in want]
    return want


@pytest.mark.parametrize("block, edits", [(jaccard_join.BLOCK, (2, 4)), (7, (2, 4)), (40, (3, 3))])
def test_jaccard_join_of_many_border_copies_lists_few_pairs(spark, monkeypatch, block, edits):
    """Copies that share rare shingles, though many link with none: candidates are listed by class, not by pair."""
    rng, listed, plain = np.random.default_rng(8), [], jaccard_join.far_pairs

    def counted(lists, *args):
        out = plain(lists, *args)
        listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "far_pairs", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = []
    for k in range(300):
        words = [f"w{n}" for n in range(120)]
        for at in rng.choice(24, edits[k >= 150], replace=False):
            words[at * 5] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = linked(rows)
    assert len(set(want)) > 20 and got == dict(enumerate(want))
    assert sum(listed) < 2 * len(rows), listed


@pytest.mark.parametrize("percent", [50, 90])
def test_jaccard_join_other_settings(spark, corpus, percent):
    rows = [(r[0], r[1]) for r in corpus[2][:160] if r[0] is not None and r[1]]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=percent).collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)) for i, t in rows}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                assert got[a] == got[b]


def test_token_records(spark, corpus, tmp_path):
    folder, none, rows = corpus
    got = entry.queries()["op3_token_shards"](spark, folder).collect()
    pieces = token_shards.Pieces(*token_shards.vocabulary())
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {len(r.tokens) for r in got} == {2 * token_shards.SEQUENCE} and all(r.offset == r.slot % token_shards.SHARD * 1024 and r.shard == r.slot // token_shards.SHARD for r in got)
    texts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.part)):
        texts[r.doc_id].append(np.frombuffer(r.tokens, np.uint16)[: r.n_tokens])
    for i, t, *_ in rows[:330]:
        if t and i != 5:
            ids = np.concatenate(texts[i])
            assert ids[-1] == pieces.end and pieces.encoding.decode(ids[:-1].tolist()) == t
    assert entry.queries()["op3_token_shards"](spark, none).count() == 0
    small = token_shards.training_order(spark.read.parquet(f"{folder}/documents.parquet"), length=64, shard=100)
    place = f"file://{tmp_path}/shards"
    files = token_shards.write_shards(small, place).collect()
    assert sum(f.records for f in files) == small.count() and [f.first_slot for f in sorted(files)] == [100 * k for k in range(len(files))]
    want = {r.slot: r.tokens for r in small.collect()}
    read = token_shards.read_slots(place, 95, 210, 64, 100)
    assert all(read[k].tobytes() == want[95 + k] for k in range(210))


def test_feistel_and_cut_tokens():
    for n in (1, 2, 3, 10, 1000, 5000):
        assert sorted(token_shards.feistel(np.arange(n), n)) == list(range(n))
    pieces, rng = token_shards.Pieces(*token_shards.vocabulary()), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice([" ", " ", "a", "é", "\n", "\t", "'s", "1", ".", "\xa0", "th"]) for _ in range(rng.randint(0, 12)))
        assert pieces.encode(t) == pieces.raw(t)


def test_toxicity(spark, corpus):
    folder, none, rows = corpus
    got = {r.doc_id: r for r in entry.queries()["op6_toxicity"](spark, folder).collect() if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is not None:
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
            assert got[i].predicted == int("vilefool" in (t or "") or "dirtbrain" in (t or "") or "rotface" in (t or "")), t
    assert entry.queries()["op6_toxicity"](spark, none).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.trained(spark, docs.select("doc_id", "text"), folder)
    more = spark.createDataFrame([("you vilefol, dirtbarin and rotfacee",), ('they "vilefool" said',), ("they vilefool say",), (None,)], "text string")
    wrong, quoted, plain, empty = [r.score for r in toxicity.score_toxicity(more, model).collect()]
    assert wrong > 0.3 and quoted < plain and empty < 0.3


def test_automaton_equals_edit_distance():
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [k for k in range(len(a)) if a[k] != b[k]]
            return len(d) <= 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    rng, terms = random.Random(2), ["abcab", "bbacca", "caabbcc"]
    auto = toxicity.Automaton(terms, [])
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) if rng.random() < 0.3 else "".join(c for c in rng.choice(terms) if rng.random() > 0.1) + rng.choice(["", "a"])
        assert (auto.match(w) is not None) == any(near(w, t) for t in terms), w


PAGE = "<!DOCTYPE html><html><head><title>T x</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home page here</a></li></ul></nav>{pre}<article><h1>Big &amp; bold</h1><p>First <b>para</b>\n graph&nbsp;one.<br>next<p>Second{mid} one.</article>{post}<footer>(c) us all</footer>"


def test_html(spark, corpus, tmp_path):
    want = "Big & bold\n\nFirst para graph one. next\n\nSecond one."
    extra = "<div class='comments'><p>I like it very much indeed</p></div>"
    pages = [
        (1, PAGE.format(pre="", mid="", post="")), (2, PAGE.format(pre="<div class=ad>Buy this thing now please</div>", mid="<!-- <p>x -->", post=extra)), (3, PAGE.format(pre="<form>Your name <input></form><aside>More of our stories</aside>", mid="", post="<section id='comments'><article class='comment'>Nice one</article></section>")),
        (4, None), (5, ""), (6, "plain words only"), (7, "<p>unclosed <b>words & more <!-- never closed"), (8, "<div class='cookie-notice'>We use cookies</div>"), (9, "<<<>>> < a <p"), (1, PAGE.format(pre="", mid="", post="")),
        (10, PAGE.format(pre="", mid=" long" * 20000, post="")),
    ]
    folder = str(tmp_path)
    table(spark, folder, "pages", [(i, f"u{i}", h, "x", 1) for i, h in pages], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in entry.queries()["op7_html_extract"](spark, folder).collect()}
    assert all(got[k].text == want for k in (1, 2, 3)), [got[k].text for k in (1, 2, 3)]
    assert got[4].text == got[5].text == got[8].text == "" and got[6].text == "plain words only" and got[7].text == "unclosed words & more"
    assert got[10].text == want.replace("Second", "Second" + " long" * 20000) and all(r.n_chars == len(r.text) for r in got.values())
    assert entry.queries()["op7_html_extract"](spark, corpus[1]).count() == 0
    assert html_extract.extract(entities.unescape("a &lt;b"), html_extract.DEFAULT).startswith("a")


def test_likelihood(spark, corpus):
    folder, none, rows = corpus
    got = entry.queries()["op9_neural_lm"](spark, folder).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for r in rows if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], out(r[0]), len(w := tokens(r[1])), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > 1.3 * sum(r.base_score for r in got)
    assert entry.queries()["op9_neural_lm"](spark, none).count() == 0


def test_likelihood_sums_to_one_and_gradients():
    class Counts:
        head_counts, form_n = np.arange(neural_lm.HEAD, 0, -1), np.ones(neural_lm.FORMS) * 9

    rng = np.random.default_rng(1)
    m = {k: a.astype(np.float64) for k, a in neural_lm.start_model(Counts()).items()}
    m["wc"], m["ww"] = rng.normal(0, 0.3, m["wc"].shape), rng.normal(0, 0.3, m["ww"].shape)
    h = np.repeat(rng.normal(0, 1, (1, neural_lm.HIDDEN)), neural_lm.START, 0)
    lp, _ = neural_lm.output(m, h, np.arange(neural_lm.START))
    assert abs(np.exp(lp).sum() - 1) < 1e-6
    docs = [rng.integers(0, neural_lm.START, size=k).astype(np.int32) for k in (9, 4, 13, 1)]
    loss = lambda mm: -neural_lm.log_probabilities(mm, docs, 2, 5).sum()
    big, new = 1e12, {k: a.copy() for k, a in m.items()}
    neural_lm.train_on(new, {k: np.full_like(a, big) for k, a in m.items()}, docs, 1e6)
    scale = math.sqrt(sum(map(len, docs))) * math.sqrt(big) / 1e6
    for name in neural_lm.NAMES:
        g = (m[name] - new[name]) * scale
        at = int(np.argmax(np.abs(g)))
        up, down = ({k: a.copy() for k, a in m.items()} for _ in range(2))
        up[name].ravel()[at] += 1e-3
        down[name].ravel()[at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g.ravel()[at]) < 2e-2 * abs(g.ravel()[at])


def test_likelihood_tells_head_words_apart_in_short_steps(spark, monkeypatch):
    rows = [(0, -1, 9000)] + [(k, 3, 9000 - k) for k in range(1, 2301)]
    vocab = neural_lm.Vocabulary(spark.createDataFrame(rows, "key long, form int, c long"))
    keys = np.arange(1, 2048, dtype=np.int64)
    assert len(set(vocab.ids(keys, np.full(2047, 3, np.int32)).tolist())) == 2047  # one suffix, still a word each
    updates, real = [], neural_lm.output
    monkeypatch.setattr(neural_lm, "output", lambda *a: updates.append(len(a[1])) or real(*a))
    m = neural_lm.start_model(vocab)
    neural_lm.train_on(m, {k: np.full_like(a, 0.1) for k, a in m.items()}, [np.ones(128, np.int32)] * 512)
    assert updates == [128 * 32] * 16


def test_pipeline(spark, corpus):
    import corpus_pipeline as p

    folder, none, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = p.without_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    clean = [r for r in rows if not any(b in (r[1] or "") for b in ("vilefool", "dirtbrain", "rotface"))]
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(clean)
    once = p.without_near_duplicates(spark, docs, folder)
    best = {}
    for k, (_, _, c) in enumerate(groups([(k, *r[1:]) for k, r in enumerate(rows)])):
        best[c] = min(best.get(c, k), k, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    assert once.columns == docs.columns and collections.Counter(map(tuple, once.collect())) == collections.Counter(rows[k] for k in best.values())
    free = p.without_benchmark(spark, docs, folder)
    assert free.columns == docs.columns and docs.count() - free.count() == 60
    # the mix takes what the SQL-checked query says; whole documents as often as they fit
    mix = p.mixed(spark, docs, folder)
    taken = collections.Counter()
    for r in entry.queries()["op1_mix_sources"](spark, folder).collect():
        taken[r.doc_id] += r.copies
    assert mix.columns == docs.columns and collections.Counter(r.doc_id for r in mix.collect()) == +taken
    # the last stage cuts each document into records of its own tokens, in some order of all slots
    vocab = token_shards.vocabulary()
    pieces, want = token_shards.Pieces(*vocab), collections.Counter()
    for r in rows:
        if r[1]:
            ids = [*np.frombuffer(pieces.raw(r[1]), pieces.kind).tolist(), pieces.end]
            ids += [pieces.end] * (-len(ids) % token_shards.SEQUENCE)
            want.update((r[0], k // token_shards.SEQUENCE, tuple(ids[k : k + token_shards.SEQUENCE])) for k in range(0, len(ids), token_shards.SEQUENCE))
    out = p.token_records(spark, docs, folder).collect()
    assert collections.Counter((r.doc_id, r.part, tuple(np.frombuffer(r.tokens, pieces.kind).tolist())) for r in out) == want
    assert sorted(r.slot for r in out) == list(range(len(out)))
    assert p.run(spark, none).count() == 0
    out = p.run(spark, folder).select("slot").collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))


def test_slots_follow_the_keyed_permutation(spark):
    """One partition: sequences are numbered in order, and each lies at the image of its number."""

    def image(x, n, key):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            a, b = x >> half, x & (1 << half) - 1
            for r in range(token_shards.ROUNDS):
                m = (b + key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) * 0xBF58476D1CE4E5B9 % 2**64
                m = (m ^ m >> 29) * 0x94D049BB133111EB % 2**64
                a, b = b, a ^ (m >> 31 & (1 << half) - 1)
            x = a << half | b
            if x < n:
                return x

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.slot for r in token_shards.training_order(docs, length=8, shard=50, key=7).collect()}
    assert got == {k: image(k, 300, 7) for k in range(300)}


def test_pipeline_decides_near_duplicates_by_row(spark, corpus):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(3).rsplit(" ", 1)[0] + " other"
    rows = [(5, near), (3, text(3)), (5, text(5)), (None, text(3)), (None, text(8)), (None, text(8)), (None, None), (9, text(8)), (None, text(1)), (None, text(1)), (7, text(7)), (7, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = p.without_near_duplicates(spark, docs, "")
    assert once.columns == docs.columns
    assert collections.Counter(map(tuple, once.collect())) == collections.Counter([(3, text(3)), (5, text(5)), (None, None), (9, text(8)), (None, text(1)), (7, text(7))])


def test_pipeline_reads_near_duplicates_where_they_lie(spark, tmp_path, monkeypatch):
    """A table read from files is not written again; rows met twice are."""
    import corpus_pipeline as p

    made = []
    plain = p.written
    monkeypatch.setattr(p, "written", lambda df: made.append(df.columns) or plain(df))
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(5, text(3)), (3, text(3)), (None, text(8)), (None, text(8)), (7, text(7)), (7, text(7)), (1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs, want = spark.read.parquet(f"{tmp_path}/docs"), [(3, text(3)), (None, text(8)), (7, text(7)), (1, None)]
    assert collections.Counter(map(tuple, p.without_near_duplicates(spark, docs, "").collect())) == collections.Counter(want)
    assert not made
    twice = docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("k")
    assert collections.Counter(map(tuple, p.without_near_duplicates(spark, twice, "").collect())) == collections.Counter([*want, (1, None)])
    assert len(made) == 1


def test_near_duplicates_leave_one_table_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Tables on the way and the shuffles that made them go when no step reads them any more."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"{base} x{k // 2} y{k // 2}") for k in range(8)] + [(8, "other words"), (9, None)], "doc_id long, text string")
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before = shuffles()
    got = jaccard_join.near_duplicates(docs, links=True)
    assert len(glob.glob(f"{tmp_path}/shared/table-*")) == 1
    for _ in range(50):  # files go in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
    assert {(r.doc_id, r.component_id, r.n_links) for r in got.collect()} == {(k, 0, 6) for k in range(8)} | {(8, 8, 0), (9, 9, 0)}


def test_components_go_on_with_fewer_edges(spark, monkeypatch):
    """Smallest reachable nodes of random graphs and a long chain; edges inside a component are not met again."""
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(300)]
    crowd = [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(3000)]
    some = [(a := 2000 + rng.randrange(400), a + rng.choice([1, 7, 50])) for _ in range(250)]
    edges = sorted({(min(e), max(e)) for e in chain + crowd + some if e[0] != e[1]})
    top = {}

    def find(c):
        while top.setdefault(c, c) != c:
            c = top[c]
        return c

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    made, plain = [], jaccard_join.written

    def counted(df):
        out = plain(df)
        made.append(out.count() if out.columns == ["x", "y"] else 0)
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    got = {r.cls: r.comp for r in jaccard_join.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {c: find(c) for e in edges for c in e}
    assert sum(made) < 2.5 * len(edges)
