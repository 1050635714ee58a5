"""Prefix trie, tokenizer alignment and suffix arrays against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from spanforge.llm import prefix_trie, suffix_dedup, suffix_sort, token_alignment

# -- prefix trie -----------------------------------------------------------------
TALK = "conv_id long, turn long, role string, text string, depth int, size string, a int"


def brute_trie(rows):
    """Nodes by (smallest member, depth) of the rebuilt conversations."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    talk = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        talk[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(talk):
        for d in range(len(talk[c]) + 1):
            members[tuple(talk[c][:d])].append(c)
    out, sums = {}, collections.defaultdict(lambda: [0, 0])
    parents = collections.Counter(p[:-1] for p in members if p)
    for p, cs in members.items():
        saved = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += saved
            sums[p[:d]][1] += p not in parents
    for p, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(talk[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out[cs[0], len(p)] = (up, len(cs), parents[p], sums[p][1], sums[p][0], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}
    assert len(got) == df.count()
    return got


def run(name, spark, folder):
    return entry.queries()[name](spark, str(folder))


def test_prefix_trie_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rng = random.Random(21)
    roles, texts = ["user", "assistant", None], ["a", "b", "ä", None, "", "x" * 5000]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), 1, "s", 2) for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(c, t, "user", "same", 1, "s", 2) for c in range(100, 160) for t in range(3)]  # copies
    rows += [(200 + k, t, "user", "t" if t < k else f"end{k}", None, None, None) for k in range(40) for t in range(k + 1)]  # a spine
    rows += [(300, t, "user", str(t % 7), 1, "s", 2) for t in range(200)] + [(7, None, None, None, 1, "s", 2), rows[3], (None, 1, "user", "nobody", 1, "s", 2)]
    spark.createDataFrame(rows, TALK).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(run("op11_prefix_trie", spark, tmp_path)) == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_turnless_conversations(spark, tmp_path):
    spark.createDataFrame([], TALK).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert run("op11_prefix_trie", spark, tmp_path / "none").count() == 0
    # the base is absent and all own turns are dropped
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, t, "user", "x", 1, "s", 2) for t in range(2)]
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/bare/conversations.parquet")
    assert nodes(run("op11_prefix_trie", spark, tmp_path / "bare")) == brute_trie(rows)


def test_rounds_of_insertion_grow_slowly(spark):
    """A spine of 300 classes, each leaving it one turn later, needs far fewer rounds."""
    turns = spark.createDataFrame([(k, d, 1 if d <= k else k + 10_000, 1, 1) for k in range(300) for d in range(1, k + 2)], "conv_id long, depth long, a long, b long, size long")
    paths = prefix_trie.written(prefix_trie.prefixes(turns))
    index = prefix_trie.ZFastTrie(paths, 300)
    rounds = index.insert(spark.createDataFrame([(k, k + 1) for k in range(300)], "x long, size long"))
    assert rounds <= 16
    # every class ends at a node, and edges cover each prefix once
    assert sum(r.depth - r.up for r in index.nodes.collect()) == 300 + 299


# -- alignment of two tokenizers -----------------------------------------------------
DOCS = "doc_id long, text string, lang string, id int, block string, n int"


@pytest.fixture(scope="module")
def pair():
    return token_alignment.Pair(*token_alignment.tokenizer_files())


def brute_alignment(pair, text):
    """Groups and links from one owner per byte."""
    if not text:
        return [], [], [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    ra, rb = [pair.bytes_a[k] for k in a], [pair.bytes_b[k] for k in b]
    if not b"".join(ra) == b"".join(rb) == (" " + text).encode():
        return [], [], [], []
    own = list(zip((k for k, t in enumerate(ra) for _ in t), (k for k, t in enumerate(rb) for _ in t), strict=True))
    links = [(a[i], b[j]) for i, j in sorted(set(own))]
    cuts = [k + 1 for k in range(len(own)) if k + 1 == len(own) or (own[k][0] != own[k + 1][0] and own[k][1] != own[k + 1][1])]
    groups = []
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        groups.append(",".join(str(a[k]) for k in dict.fromkeys(o[0] for o in own[lo:hi])) + "|" + ",".join(str(b[k]) for k in dict.fromkeys(o[1] for o in own[lo:hi])))
    return a, b, groups, links


def test_alignment_equals_brute_force(spark, tmp_path, pair, monkeypatch):
    rng = random.Random(22)
    words = ["alpha", "Überläufe", "naïve", "don't", "x1y2", "日本語", "🙂🙃", "<|endoftext|>", "<s>", "</s>", "foo_bar", "3.14159", " ", "á"]
    texts = [None, "", " ", "\n", "  two  blanks  ", "tab\tand\nline", "<|endoftext|>", "<s> </s> <unk>", "no" * 4000, " lead", "trail ", "▁marked", "日本語" * 30, "ﬁ ligature ½", "\x00nul", "é" * 70 + " " + "z" * 70]
    texts += [rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + [texts[4]] * 3
    rows = [(k if k % 9 else None, t, "en", 1, "b", 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = [brute_alignment(pair, t) for t in texts]
    counts = collections.Counter(x for m in made for x in m[3])
    top = collections.defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = collections.Counter()
    for (ident, *_), (a, b, groups, links) in zip(rows, made, strict=True):
        best, total = sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[ident, len(a), len(b), len(groups), len(links), best, total, sha] += 1
    assert sum(1 for m in made if not m[0]) >= 3
    got = run("op12_token_alignment", spark, tmp_path)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    # small blocks and the groups themselves
    parts = token_alignment.aligned(docs, groups=True, block=200).collect()
    assert collections.Counter((r.n_best, r.count_sum, r.groups) for r in parts) == collections.Counter((sum(counts[x] == top[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), ";".join(m[2])) for m in made)


def test_alignment_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert run("op12_token_alignment", spark, tmp_path).count() == 0


# -- suffix arrays ---------------------------------------------------------------------


def test_suffix_array_equals_sorting(monkeypatch):
    rng = random.Random(23)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5, 20])
        t = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        monkeypatch.setattr(suffix_sort, "BUCKETS", rng.choice([0, 2, 4, 4096]))
        assert suffix_sort.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_common_prefixes_and_long_runs():
    data = np.frombuffer(b"ab" * 5000 + b"a" * 20_000 + b"zab", np.uint8)
    order = suffix_sort.suffix_array(data.astype(np.uint16) + 1, 257)
    assert all(bytes(data[i : i + 30_003]) < bytes(data[j : j + 30_003]) for i, j in zip(order[:50], order[1:51], strict=True))
    plcp = suffix_sort.common_prefixes(data, order, np.full(len(data), len(data)))
    raw = data.tobytes()
    for i, j in [(int(order[k - 1]), int(order[k])) for k in range(1, len(order), 997)]:
        n = plcp[j]
        assert raw[i : i + n] == raw[j : j + n] and raw[i + n : i + n + 1] != raw[j + n : j + n + 1]


def test_repeated_starts_equal_counting():
    rng = random.Random(24)
    for _ in range(800):
        length, k = rng.choice([1, 2, 3, 6]), rng.choice([1, 2, 3])
        parts = [bytes(rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 20, 40]))) for _ in range(rng.randint(1, 6))]
        seen = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and seen[p[i : i + length]] > 1 for p in parts for i in range(len(p))]
        got = suffix_sort.repeated_starts(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), length)
        assert got.tolist() == want


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        cover = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if cover[i] and (not i or not cover[i - 1]))
        kept = bytes(c for c, gone in zip(x, cover, strict=True) if not gone)
        out.append((len(x), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(25)
    word = lambda: "".join(rng.choice("abcdefghijklmnopä") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(110), text(90)
    texts = [None, "", "short", "x" * 399, "y" * 400, "z" * 401, "ab" * 600, "ab" * 300 + "!", text(20_000), passage, passage + "."]
    texts += [f"{text(rng.randint(1, 60))} {passage} {text(rng.randint(1, 60))}" for _ in range(40)] + [text(100) for _ in range(30)]
    texts += [texts[12]] * 6 + [texts[8][5000:5700] + text(3) + other, text(50) + other + other] + ["y" * 400, texts[20][:700], "mid " + texts[20][100:800]]
    return [(k if k % 7 else None, t, "en", k, "p", b"") for k, t in enumerate(texts)]


@pytest.mark.parametrize("limits", [{}, {"GROUP": 3}, {"BLOCK": 2000, "PIECE": 1000}])
def test_repeats_equal_brute_force(spark, tmp_path, repeated, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = spark.createDataFrame(repeated, "doc_id long, text string, lang string, start long, print string, data binary").repartition(4)
    group, block = limits.get("GROUP", suffix_dedup.GROUP), limits.get("BLOCK", suffix_dedup.BLOCK)
    rows, texts = suffix_dedup.repeats(docs, group=group, block=block)
    texts = {r["print"]: ([(s.lo, s.hi) for s in r.spans], bytes(r.kept)) for r in texts.collect()}
    got = []
    for r in rows.collect():
        spans, kept = texts.get(r["print"], ([], None))
        sha = r.sha256 if kept is None else hashlib.sha256(kept).hexdigest()
        got.append((r.id, r.n_bytes, sum(b - a for a, b in spans), len(spans), sha))
    assert collections.Counter(got) == collections.Counter((i, *w) for (i, *_), w in zip(repeated, brute_repeats([r[1] for r in repeated]), strict=True))


def test_repeats_query(spark, tmp_path, repeated):
    spark.createDataFrame(repeated, "doc_id long, text string, lang string, start long, print string, data binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = run("op13_suffix_dedup", spark, tmp_path)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, *w) for (i, *_), w in zip(repeated, brute_repeats([r[1] for r in repeated]), strict=True))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run("op13_suffix_dedup", spark, tmp_path / "none").count() == 0


def test_parts_between_blanks_need_no_pattern_where_blanks_stand_alone(monkeypatch):
    pair = token_alignment.Pair.__new__(token_alignment.Pair)
    pair.apart, plain, rng = True, token_alignment.BETWEEN, random.Random(12)
    for _ in range(20_000):
        text = "".join(rng.choice("ab é   \n\t\x1f\x85\u2003   x") for _ in range(rng.randint(0, 9)))
        assert pair.pieces(text) == plain.split(text)
    monkeypatch.setattr(token_alignment, "BETWEEN", None)
    assert pair.pieces("a line\nand a second\u2003one é") == ["a", "line\nand", "a", "second\u2003one", "é"]
