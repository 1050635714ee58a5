"""Toxicity by a learned lexicon, matched with misspellings, weighed by context.

* **Lexicon.**  Words and word beginnings (4 to 7 letters) that labelled toxic
  documents use significantly more often than clean ones, in many different
  contexts; these keep words of copied texts out.  A word weighs its log odds.
* **Matching.**  The lexicon is a trie; a Levenshtein automaton of one edit (or
  swap of neighbours) runs over it.  Both are intersected lazily: a state is a set
  of (trie node, edits used) and its transitions are kept, so most words die after
  a few letters.  Only terms of ``FUZZY`` letters or more match misspelled, and not
  as words that clean documents use; the same holds for words found by beginning.
* **Context.**  Each hit is scored by a window around it: less inside quotation
  marks and near verbs of reporting, more near a second person.
* **Score.**  Logistic regression on the scored hits.

Lexicon and regression are fitted on at most ``SAMPLE`` labelled rows, those first
in hash order of the id; scoring reads every whole text and only the text.

Defined results: null or empty texts are scored as texts without hits; without
toxic labels the lexicon is empty and all scores equal the base rate; repeated
rows score alike; contradictory labels of an id count as toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, saved, scan

SAMPLE = 20_000
FUZZY = 5
CONTEXTS = 4
STEM = (4, 5, 6, 7)
PURE, LIFT = 0.5, 3.0
CUT = 0.3
#: misspelled terms count unless labelled data speak against it, though few labelled rows hold one
PRIOR = [0.0, 0.0, 4.0, 0.0, 0.0]
TOKEN = re.compile(r"\w+")
QUOTED = re.compile(r'"[^"\n]{1,300}"|“[^”\n]{1,300}”|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]')
#: own cue words
REPORTING = {"said", "says", "wrote", "quote", "quoted", "quoting", "called", "term", "word", "dit", "écrit", "sagte", "schrieb", "zitat", "dijo", "escribió"}
SECOND = {"you", "your", "youre", "ur", "du", "dich", "dein", "tu", "toi", "vous", "ton", "tú", "usted", "eres"}


class Automaton:
    """Trie of terms and stems, intersected with the automaton of one edit."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.stem_ends: dict[int, str] = {}
        for terms, ends in ((words, self.ends), (stems, self.stem_ends)):
            for t in sorted(terms):
                node = 0
                for ch in t:
                    node = self.child[node].setdefault(ch, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                ends[node] = t
        first = frozenset({(0, 0, "")})
        self.ids, self.states, self.steps, self.result = {first: 0}, [first], [{}], [None]

    def _step(self, state: int, ch: str) -> int:
        """Next state: -1 dead, -2 a stem was completed."""
        out = set()
        for node, edits, due in self.states[state]:
            kids = self.child[node]
            if due:  # second letter of a swap
                if ch == due:
                    out.add((node, 1, ""))
                continue
            if ch in kids:
                if not edits and kids[ch] in self.stem_ends:
                    return -2
                out.add((kids[ch], edits, ""))
            if not edits:
                out.add((node, 1, ""))
                for c, k in kids.items():
                    out.add((k, 1, ""))
                    if ch in self.child[k]:
                        out.add((self.child[k][ch], 1, ""))  # a letter left out
                        if c != ch:
                            out.add((self.child[k][ch], 1, c))  # two letters swapped
        key = frozenset((n, e, d) for n, e, d in out if not (e and (n, 0, "") in out))
        if not key:
            return -1
        at = self.ids.setdefault(key, len(self.states))
        if at == len(self.states):
            self.states.append(key)
            self.steps.append({})
            self.result.append(self._accept(key))
        return at

    def _accept(self, key) -> tuple[str, int] | None:
        found = []
        for node, edits, due in key:
            if due:
                continue
            if node in self.ends and (not edits or len(self.ends[node]) >= FUZZY):
                found.append((edits, self.ends[node]))
            if not edits:
                found += [(1, self.ends[k]) for k in self.child[node].values() if k in self.ends and len(self.ends[k]) >= FUZZY]
        return (min(found)[1], min(found)[0]) if found else None

    def match(self, word: str) -> tuple[str, int] | None:
        """Term and kind (0 exact, 1 one edit, 2 by its beginning), or None."""
        state = 0
        for ch in word:
            steps = self.steps[state]
            nxt = steps.get(ch)
            if nxt is None:
                nxt = steps[ch] = self._step(state, ch)
            if nxt < 0:
                return None if nxt == -1 else (word, 2)
            state = nxt
        return self.result[state]


def hits_of(text: str, automaton: Automaton, words_weigh: dict[str, float], clean: frozenset[str]) -> list[tuple[str, str, int, int, int, float]]:
    """(term, surface, start, end, kind, score) of each hit in a text; the score is context times the weight of an exact word."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change length; offsets must stay those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words = TOKEN.findall(low)
    found = {}
    for w in set(words):
        m = automaton.match(w)
        if m and m[1] and w in words_weigh:
            m = (w, 0)
        if m and (not m[1] or w not in clean):
            found[w] = m
    if not found:
        return []
    quotes = [m.span() for m in QUOTED.finditer(low)] if any(q in low for q in '"“«„') else []
    tokens, out = [m.span() for m in TOKEN.finditer(low)], []
    for k, w in enumerate(words):
        if w in found:
            term, kind = found[w]
            a, b = tokens[k]
            near = set(words[max(0, k - 8) : k + 9])
            score = (0.35 if any(x < a and b < y for x, y in quotes) else 1.0) * (0.7 if near & REPORTING else 1.0) * (1.25 if near & SECOND else 1.0)
            out.append((term, w, a, b, kind, score if kind else score * words_weigh[w]))
    return out


def features(hits: list, n_words: int) -> list[float]:
    exact, fuzzy, stem = (sum(h[5] for h in hits if h[4] == k) for k in range(3))
    return [min(2.0, exact / 4), math.log1p(exact), math.log1p(fuzzy), math.log1p(stem), math.log1p(100 * (exact + fuzzy + stem) / (n_words + 20))]


def units_of(text: str) -> dict[str, set[int]]:
    """Words and stems (marked ``*``) of a text with hashes of their contexts; stems count different completions."""
    words, out = TOKEN.findall(text.lower()), {}
    for k, w in enumerate(words):
        if len(w) >= 4 and not w.isdigit():
            out.setdefault(w, set()).add(hash_of((words[k - 1] if k else "") + " " + (words[k + 1] if k + 1 < len(words) else "")))
            for n in STEM:
                if len(w) > n:
                    out.setdefault(w[:n] + "*", set()).add(hash_of(w))
    return out


def hash_of(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode()) - (1 << 31)


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Weighted words, and beginnings, from ``text, toxic`` rows."""

    def contexts():
        def work(texts):
            df, ctx = Counter(), {}
            for t in texts:
                for u, seen in units_of((t or b"").decode("utf-8", "replace")).items():
                    df[u] += 1
                    if len(ctx.setdefault(u, set())) < 64:
                        ctx[u] |= seen
            rows = [(u, n, sorted(ctx[u])) for u, n in df.items()]
            return [[rows] + [[] for _ in texts[1:]]] if texts else [[]]

        return work

    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_toxic, n = toxic.count(), sample.count()
    if not n_toxic or n_toxic == n:
        return {}, []
    u = scan(toxic, contexts, "units array<struct<unit:string,df:int,ctx:array<int>>>", carry=["toxic"]).select(F.explode("units").alias("u"))
    contexts_of = F.size(F.array_distinct(F.flatten(F.collect_list("u.ctx")))).alias("contexts")  # at most 64 of each of 24 tasks
    enough = f"df >= 4 and contexts >= if(unit like '%*', {CONTEXTS}, greatest({CONTEXTS}, least(0.4 * df, 40)))"
    few = u.groupBy("u.unit").agg(F.sum("u.df").alias("df"), contexts_of).where(enough).collect()
    wanted = frozenset(r["unit"] for r in few)

    def counts():
        def work(texts):
            df = Counter()
            for t in texts:
                words = set(TOKEN.findall((t or b"").decode("utf-8", "replace").lower()))
                df.update(wanted & ({*words} | {w[:k] + "*" for w in words for k in STEM if len(w) > k}))
            return [[list(df.items())] + [[] for _ in texts[1:]]] if texts else [[]]

        return work

    c = scan(clean, counts, "units array<struct<unit:string,df:int>>", carry=["toxic"]).select(F.explode("units").alias("u"))
    clean_df = {r["unit"]: r["df"] for r in c.groupBy("u.unit").agg(F.sum("u.df").alias("df")).collect()}
    base, toxic_df = n_toxic / n, {r["unit"]: r["df"] for r in few}
    words, stems = {}, set()
    for x, k in toxic_df.items():
        seen = k + clean_df.get(x, 0)
        # Chernoff bound of so many toxic documents by chance, for all candidates together
        rate = k / seen
        surprise = seen * (rate * math.log(rate / base) + ((1 - rate) * math.log((1 - rate) / (1 - base)) if rate < 1 else 0.0)) if rate > base else 0.0
        if surprise < math.log(max(len(few), 1) / 0.01):
            continue
        if x.endswith("*"):
            if rate >= LIFT * base:
                stems.add(x)
        elif rate >= PURE:
            words[x] = min(6.0, math.log((k + 0.5) / (n_toxic + 1) / ((seen - k + 0.5) / (n - n_toxic + 1))))
    longest = [x[:-1] for x in sorted(stems) if not any(toxic_df[y] >= 0.95 * toxic_df[x] for y in stems if len(y) == len(x) + 1 and y.startswith(x[:-1]))]
    return words, longest


def regression(x: np.ndarray, y: np.ndarray, prior: list[float], ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for logistic regression drawn towards ``prior``; the intercept comes last and is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = ridge * np.r_[w[:-1] - prior, 0.0]
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge * np.eye(len(w)), a.T @ (p - y) / len(a) + pull)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from documents (doc_id, text) and labels (doc_id, toxic)."""
    few = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = saved(few.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `sample` ids
    rows = saved(rows.select("text", "toxic", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)) == 0).alias("half")).repartition(24))
    words, stems = learn_lexicon(rows)

    def misspelled():
        automaton = Automaton(list(words), stems)

        def work(texts):
            seen = set()
            for t in texts:
                seen |= {w for w in set(TOKEN.findall((t or b"").decode("utf-8", "replace").lower())) if w not in words and (m := automaton.match(w)) and m[1]}
            return [[sorted(seen)] + [[] for _ in texts[1:]]] if texts else [[]]

        return work

    used = scan(rows.where("toxic = 0 and half"), misspelled, "w array<string>", carry=["half"]).select(F.explode("w").alias("w")).distinct().collect()
    model = {"words": words, "stems": stems, "clean": frozenset(r["w"] for r in used), "weights": [0.0] * 6}
    scored = scan(rows.where("not half"), lambda: _scorer(model, full=True), "x array<double>", carry=["toxic"]).select("row.toxic", "x").collect()
    y = np.array([r["toxic"] for r in scored], float)
    if len(y):
        w = regression(np.array([r["x"] for r in scored]), y, PRIOR)
        model["weights"] = [*(max(float(v), 0.0) for v in w[:-1]), float(w[-1])]
    return model


def _scorer(model: dict, full: bool = False):
    automaton, clean, weights = Automaton(list(model["words"]), model["stems"]), model["clean"], model["weights"]

    def work(texts):
        score, spans = [], []
        for t in texts:
            text = t.decode("utf-8", "replace") if t else ""
            hits = hits_of(text, automaton, model["words"], clean)
            x = features(hits, len(text.split()) if hits else 0)
            if full:
                score.append(x)
                continue
            z = sum(a * b for a, b in zip(x, weights)) + weights[-1]
            score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            spans.append(hits)
        return [score] if full else [score, spans]

    return work


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``carry``, default all) with ``score`` and the scored ``hits``."""
    ddl = "score double, hits array<struct<term:string,surface:string,start:int,end:int,kind:int,score:double>>"
    return scan(docs, lambda: _scorer(model), ddl, text, carry)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, trained(spark, docs, sf_dir), carry=["doc_id"])
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
