"""Queries with SQL, on a fixture of awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry

NAMES = ["op1_mix_sources", "op4_decontaminate", "op5_quality_rules", "op8_url_filter", "op10_chat_format", "op11_prefix_trie"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, row string, size int, bucket int, id long, n_words int, stratum string",
    "benchmark": "item_id long, text string, row int",
    "labels": "doc_id long, quality int, toxic int, good int",
    "pages": "page_id long, url string, html string, host string, row int",
    "conversations": "conv_id long, turn long, role string, text string, depth int, call string",
}


def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "délta", "e5", "zeta", "eta", "theta", "x#y", "IOTA"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quiz = [text(30), text(5), text(13), "", None, "...", text(40)]
    docs = [None, "", " \n\t", "one", "a b c d", text(60), text(3000), text(60) + "\n" + text(20) + "\n" + text(20), "x y z\nx y z\n\n x y z\nx y z", quiz[0].upper(), "pre " + quiz[2] + " post", quiz[1] + "!", text(100) + " " + quiz[6]]
    docs += [text(rng.randint(1, 200)) for _ in range(60)] + ["#$% " * 80, "SHOUT " * 60, text(70).replace(" ", "\x0b")]
    out = [(i if i % 17 else None, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "s10"]), 0, "r", 1, 2, 3, 4, "q") for i, t in enumerate(docs)]
    out += [out[6]] * 5 + [out[20]] * 2 + [(1000 + i, out[7][1], "en", "hot", 0, None, None, None, None, None, None) for i in range(50)]
    talk = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([text(rng.randint(0, 30)), 'quote " and \\ é\n', None, ""]), None, "c") for c in range(12) for t in range(rng.randint(1, 9))]
    talk += [(99, t, "assistant" if t % 2 else "user", text(t % 7), 1, None) for t in range(300)] + [talk[0]]
    urls = [None, "", "no scheme", "http://", "http://A.Com", "https://www.Example.com/en/x?y#z", "http://x.example.com/en/1", "http://example.com/en", "ftp://a.net/es/p", "http://a.net?q=/es/", "http://net/fr/", "http://free.casino.org/", "http://freecasino.org/", "http://win-free.org/b", "http://free.org/free", "http://a.org/#porn", "x://É.org/é?bonus_win", "http://spam-farm.example.org:80/a//b"]
    return {
        "documents": out, "benchmark": [(i if i != 6 else None, q, 1) for i, q in enumerate(quiz)] + [(0, quiz[0], 2)], "labels": [(i, int(i % 9 > 0), 0, 1) for i in range(80)] + [(3, None, None, 1), (None, 1, 1, 1), (5, 0, 0, 1), (5, 1, 0, 1)],
        "pages": [(i, u, None, "h", 1) for i, u in enumerate(urls * 2)], "conversations": talk,
    }


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = str(tmp_path_factory.mktemp("full")), str(tmp_path_factory.mktemp("none"))
    data = rows()
    for t, ddl in SCHEMAS.items():
        spark.createDataFrame(data[t], ddl).coalesce(1).write.parquet(f"{full}/{t}.parquet")
        spark.createDataFrame([], ddl).coalesce(1).write.parquet(f"{empty}/{t}.parquet")
    return full, empty


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, folders, name):
    for folder in folders:
        con = duckdb.connect()
        for t in SCHEMAS:
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
        cur = con.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        df = entry.queries()[name](spark, folder)
        assert sorted(cols) == sorted(df.columns)
        a = collections.Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
        b = collections.Counter(tuple(norm(x) for x in r) for r in cur.fetchall())
        assert a == b


def test_no_python_in_native_queries(spark, folders):
    for name in ("op5_quality_rules", "op10_chat_format"):
        plan = entry.queries()[name](spark, folders[0])._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_contamination_in_several_automata(spark, folders):
    from spanforge.llm import decontaminate

    docs, items = (spark.read.parquet(f"{folders[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (decontaminate.contamination(docs, items, carry=["doc_id", "text"], most=m).select("row.doc_id", "row.text", "n_words", "n_hit", F.concat_ws(",", "items"), "contaminated") for m in (10**6, 3))
    assert collections.Counter(one.collect()) == collections.Counter(many.collect())
    spans = decontaminate.contamination(docs, items).where("n_hit > 0").select("row.text", "spans", "n_hit").collect()
    assert spans and all(sum(len(decontaminate.words_of(r.text[s.start : s.end].encode())) for s in r.spans) == r.n_hit for r in spans)


def test_mix_repeats_documents(spark, folders):
    from spanforge.llm import mixing

    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    taken = {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    want = {r.source: r.n for r in entry.queries()["op1_mix_sources"](spark, folders[0]).join(docs.select("doc_id", "source", "text").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert all(taken.get(s) is not None for s in want)


def test_tool_links(spark):
    from spanforge.llm import chat_format

    calls = spark.createDataFrame([("a", 1, "x", None, "search", '{"query":"q","limit":3}'), ("a", 3, "y", "x", "search", '{"limit":"3"}'), ("a", 4, "z", "y", "nope", "{}"), ("a", 5, "c1", "c2", "search", "["), ("a", 6, "c2", "c1", "search", '{"query":null}'), ("b", 1, None, None, "search", None), ("b", 2, "w", "gone", "search", '{"query":"q"}')], "conv string, turn int, call string, parent string, tool string, arguments string")
    results = spark.createDataFrame([("a", 2, "x", "r1"), ("a", 9, "x", "r2"), ("a", 1, "lost", "r"), ("b", 1, None, None)], "conv string, turn int, call string, content string")
    schemas = spark.createDataFrame(chat_format.SCHEMAS, "tool string, argument string, type string, required boolean")
    talk = spark.createDataFrame([], "conv string, turn int, role string, text string")
    got = {(r.conv, r.turn, r.kind): r for r in chat_format.link_tool_calls(talk, calls, results, schemas).collect()}
    assert [got["a", t, 1].depth for t in (1, 3, 4)] == [0, 1, 2]
    assert got["a", 3, 1].errors == ["limit: wrong type", "query: missing"] and got["a", 4, 1].errors == ["tool: unknown"] and got["a", 5, 1].errors == ["arguments: no object"]
    assert got["a", 5, 1].status == got["a", 6, 1].status == "cycle" and got["b", 2, 1].status == "unknown parent"
    assert [got["a", t, 2].status for t in (2, 9, 1)] == ["linked", "extra", "no call"] and got["b", 1, 2].status == got["b", 1, 1].status == "no id"
    assert got["a", 1, 1].json == '{"arguments":"{\\"limit\\":3,\\"query\\":\\"q\\"}","id":"x","role":"assistant","tool":"search","type":"call"}'
    assert isinstance(talk.schema, T.StructType)
