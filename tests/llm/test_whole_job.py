"""Cases that the operators once left out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, licenses, mixing, near_dedup, pii, quality_rules, repeats
from millrace.llm.common import documents

from ..oracle import same
from . import brute

SMALL, MORE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_pii_next_to_another_number():
    def found(text):
        sure, added = pii.find(text, pii.fitted())
        return sorted((k, text[a:b]) for k, a, b in [*added, *((k, *s) for k in sure for s in sure[k])])

    assert found("ramiar, 4465758382889437 4465758382889437 para") == [("card", "4465758382889437")] * 2
    assert found("sh 2353820953013749 4550997810720808 thheed") == [("card", "4550997810720808")]  # the other fails its check
    assert found("Des +1 (826) 555-4081 190.137.223.204 du") == [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]
    assert found("write to jo.miller at example dot org now") == [("email", "jo.miller at example dot org")]
    assert found("see you at example.com now") == []
    assert found("server 2001:db8::1 is up") == [("ip", "2001:db8::1")]


def test_pii_side_by_side_in_the_tables(spark):
    assert {r.doc_id: r.n_added for r in pii.query(spark, MORE).where("n_added > 0").collect()} == {254: 2, 402: 2}
    got = {r.doc_id: r.n_added for r in pii.query(spark, LARGE).where("n_added > 0").collect()}
    assert got == {46: 2, 1262: 1, 1377: 1, 7052: 1}


def test_pii_candidates_overlap():
    text = "12345678 12345678"
    assert {(k, text[a:b]) for k, a, b in pii.candidates(text, [])} == {("phone", "12345678"), ("card", text)}


def test_quality_rejects_each_kind_of_poor_row(spark):
    docs, labels = documents(spark, LARGE), spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = quality_rules.judge(docs, labels).where("NOT base_failed").join(labels.select("doc_id", "quality"), "doc_id", "left")
    by = {(r.quality, r.symbols): (r.kept, r.n) for r in rows.groupBy("quality", (F.col("n_symbols") > 0).alias("symbols")).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    assert by[0, True] == (0, 293) and by[0, False] == (0, 8)  # symbols; a word again and again
    assert by[1, False][0] >= 0.998 * by[1, False][1]


def test_quality_counts_words_in_a_row():
    x = quality_rules.features(np.array([quality_rules.stats("a a a b b c d e f g"), quality_rules.stats("a b c d e a b c d e")]))
    assert x[:, 5].tolist() == [0.3, 0.0]


def test_repeats_inside_one_document(spark):
    block = lambda k, n: " ".join(f"b{k}x{i}" for i in range(n))
    rows = [
        (1, f"{block(1, 70)} {block(2, 9)} {block(1, 70)}"), (2, "line of words\n" * 30), (3, f"{block(3, 60)} " * 3), (4, block(4, 200)),
        (5, f"{block(5, 80)} {block(1, 70)} {block(6, 55)} {block(6, 55)}"), (6, f"{block(7, 49)} mid {block(7, 49)}"),
    ]
    seen = {}
    rows += [(100 + r.doc_id, r.text) for r in documents(spark, SMALL).where("text IS NOT NULL").orderBy("doc_id").collect() if seen.setdefault(r.text, r.doc_id) == r.doc_id]
    got = {r.doc_id: (r.spans, r.drop_spans) for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)
    assert {1, 2, 3, 5} <= set(got) and not {4, 6} & set(got)
    first, second = len(block(1, 70)), len(f"{block(1, 70)} {block(2, 9)} ")
    assert got[1] == (f"0:{first},{second}:{second + first}", f"{second}:{second + first}")


def test_chat_content_beside_calls_and_empty_lists(spark):
    call = '{"id":"x","name":"reply","arguments":{"prompt":"a"}}'
    texts = ['{"tool_calls":[]}', '{"content":"let me look","tool_calls":[%s]}' % call, '{"content":"none","tool_calls":[]}', '{"content":null,"tool_calls":[%s]}' % call, '{"content":"","tool_calls":[%s]}' % call]
    got = chat.format_chats(spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    said = lambda text: '{"content":"%s","role":"assistant","type":"message"}' % text
    assert sorted((r.turn, r.line) for r in got if r.kind == "message") == [(0, said("")), (1, said("let me look")), (2, said("none"))]
    assert sorted(r.turn for r in got if r.kind == "call") == [1, 3, 4] and len(got) == 6


def test_chat_chains_clashes_and_order(spark):
    """A chain of 500 calls, one that waits for several, written names like the made ones, results before their calls, texts that can't be read."""
    import json

    say = lambda calls: json.dumps({"tool_calls": calls})
    call = lambda i, *after: {"id": i, "name": "reply", "arguments": {"prompt": i}, "after": list(after)}
    rows = [(1, n, "assistant", say([call(f"c{n}", *([f"c{n - 1}"] if n else []))])) for n in range(500)]
    rows += [(1, 500, "assistant", say([call("wide", "c499", "c3"), call("over", "wide", "c499"), call("r1", "r2"), call("r2", "r3"), call("r3", "r1"), call("behind", "r1", "c0")]))]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", say([call("turn-0")])), (2, 2, "tool", '{"call_id":"late","content":"x"}'), (2, 3, "assistant", say([call("late")])), (2, 4, "tool", "not json"), (2, 5, "assistant", '{"tool_calls": [broken')]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 500 + 6 + 6
    level = {r.call_id: r.level for r in got if r.conv_id == 1}
    assert all(level[f"c{n}"] == 2 * n for n in range(500))
    assert (level["wide"], level["over"]) == (1000, 1002)
    assert [level[i] for i in ("r1", "r2", "r3", "behind")] == [None] * 4
    two = {r.turn: (r.kind, r.call_id, r.linked, r.valid) for r in got if r.conv_id == 2}
    assert two == {
        0: ("call", "turn-0", False, True), 1: ("call", "turn-0", False, True), 2: ("result", "late", False, True), 3: ("call", "late", False, True),
        4: ("result", None, False, False), 5: ("message", None, False, False),
    }


def test_pii_takes_long_numbers_in_one_pass():
    from time import process_time

    model, began = pii.fitted(), process_time()
    for text in ("7" * 1_000_000, "1." * 500_000, "12 " * 3000, "1.2.3." * 100_000 + "4"):
        pii.find(text, model)
    assert process_time() - began < 20  # by squares a million digits alone would take an hour
    assert pii.base("1.2.3.4.5.6.7.8.9 1.2.3.256.1.1.1.1 0001.2.3.004")["ip"] == [(0, 7), (8, 15), (28, 35), (36, 48)]


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 Some Body and others. All rights reserved.

"""


def test_licenses_full_texts(spark):
    import textwrap

    text = {n: t for n, t in licenses.KNOWN if len(t) > 400}
    wrap = lambda name, width: textwrap.fill(text[name], width)
    inside = lambda t: f"first words of a page\n\n{t}\n\nand some more"
    rows = {
        "mit": MIT_FILE + wrap("MIT", 72), "wrapped before": MIT_FILE + wrap("MIT", 72).replace("above copyright", "above\ncopyright"), "inside": inside(MIT_FILE + wrap("MIT", 60)), "bsd": "BSD 3-Clause License\n\n(c) 2001, me\n" + wrap("BSD-3-Clause", 80),
        "bsd2": inside(wrap("BSD-2-Clause", 50)), "changed": wrap("MIT", 72).replace("sell", "lend"), "two": inside(wrap("MIT", 70) + "\n" + wrap("Zlib", 70)), "sentence": "Copyright (c) 2020 Me. Released under the MIT License.", "wraps": "a\ncopyright holders of the work",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows.values())], "doc_id long, text string")
    got = dict(zip(rows, [(r.whole_licence, r.licences) for r in licenses.scan(docs).orderBy("doc_id").collect()]))
    assert got == {
        "mit": ("MIT", "MIT"), "wrapped before": ("MIT", "MIT"), "inside": (None, "MIT"), "bsd": ("BSD-3-Clause", "BSD-3-Clause"), "bsd2": (None, "BSD-2-Clause"), "changed": (None, ""), "two": (None, "MIT,Zlib"), "sentence": ("MIT", "MIT"), "wraps": (None, ""),
    }


def test_licenses_as_sql(spark, tmp_path):
    texts = [MIT_FILE + t for _, t in licenses.KNOWN] + ["x\n\n" + t.replace(". ", ".\n") + "\n\ny" for _, t in licenses.KNOWN] + [None, "", "(c) me\n© 2001 you\nCopyright 2000-2020 X. Y. Licensed under CC BY 4.0."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), licenses.query, licenses.SQL)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="long texts come with some systems only")
def test_licenses_long_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    read = {n: open(f"/usr/share/common-licenses/{f}").read() for f, n in files.items()}
    rows = list(read.items()) + [(f"in {n}", f"some page\n{t}\nmore") for n, t in read.items()]
    got = {r.doc_id: (r.whole_licence, r.licences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {n: (n, n) for n in read} | {f"in {n}": (None, n) for n in read}


def test_filters_keep_one_row_a_group(spark):
    """Rows that repeat an id, a text or both, null ids and texts, and columns named like the operators' own."""
    t, u, lone = "T T T a b c d e f g", "u v w x y z q r s", "lone one two three four five six"
    rows = [(1, t), (1, t), (2, t), (2, u), (3, u), (2, t), (None, t), (None, lone), (None, lone), (None, None), (7, None)]
    docs = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], "doc_id long, text string, source string, c0 int, `a.b` int, __copy string")
    pick = lambda df: sorted([(r[0], r[1]) for r in df.collect()], key=repr)
    for f, want in ((exact_dedup.deduplicate, [(2, t), (3, u), (7, None), (None, lone)]), (near_dedup.deduplicate, [(1, t), (7, None), (None, lone), (None, None)])):
        for df in (docs, docs.repartition(5)):
            assert f(df).columns == docs.columns
            assert pick(f(df)) == sorted(want, key=repr)
    for hot, salts in ((0, 3), (1, 2)):
        assert pick(exact_dedup.deduplicate(docs, salts, hot)) == pick(exact_dedup.deduplicate(docs))
        whole = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert whole(exact_dedup.exact_dedup(docs, salts, hot=hot)) == whole(exact_dedup.exact_dedup(docs))
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(docs).collect()}
    assert sum(r.taken for r in mixing.mix(docs).collect()) == int(mixing.mix(docs).first().target) and len(taken) > 4
    assert mixing.mixed(docs).columns == docs.columns
    assert all(pick(f(docs.limit(0))) == [] for f in (exact_dedup.deduplicate, near_dedup.deduplicate, mixing.mixed))


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from millrace.llm import common

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]", applicationId="a")))
