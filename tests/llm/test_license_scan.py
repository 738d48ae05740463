import re

import pytest

from priospread.llm.license_scan import BASE_PHRASES, automaton, evaluate, scan_licenses, scan_text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "   ", "MIT License", "the MIT-license. mit license!", "cc by cc by-nc", "apache license apache license", "gnu general public gnu general public license",
    "É mit licensé mit license", "x\x00mit\nlicense", "licensed under CC BY-SA. " * 50, "cc bye", "SPDX-License-Identifier: MIT OR Apache-2.0", "a " * 60000 + "mit license",
]


def test_base_columns_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


@pytest.mark.parametrize(
    ("expression", "names", "open_"),
    [
        ("MIT", ["mit"], 1.0), ("MIT OR GPL-3.0-only", ["gpl-3.0-only", "mit"], 1.0), ("MIT AND GPL-3.0-only", ["gpl-3.0-only", "mit"], 0.4),
        ("MIT OR GPL-2.0 AND AGPL-3.0", ["agpl-3.0", "gpl-2.0", "mit"], 1.0), ("(MIT OR GPL-2.0) AND AGPL-3.0", ["agpl-3.0", "gpl-2.0", "mit"], 0.3),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0-with-classpath-exception-2.0"], 0.5), ("MIT */", ["mit"], 1.0),
    ],
)
def test_expressions(expression, names, open_):
    got = evaluate(expression)
    assert got[0] == names and got[1] == pytest.approx(open_)


@pytest.mark.parametrize("expression", ["", "AND", "MIT OR", "(MIT", "OR MIT", "()", "MIT AND (", "WITH x"])
def test_malformed_expressions(expression):
    assert evaluate(expression) is None


def test_tag_labels_and_score():
    row = scan_text(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\nfoo", automaton())
    assert row[5] == "apache-2.0,mit" and row[6] == pytest.approx(0.95) and row[1] == 0
    assert scan_text(b"// SPDX-License-Identifier: (MIT OR", automaton())[8] == 1


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prose_after_a_tag_is_no_licence(spark):
    tag = "SPDX-License-Identifier: "
    rows = {
        tag + "see the file LICENSE for details": ("", 1), tag + "the licence of this file": ("", 1), tag + "Foo-1.0 OR what the author says": ("", 1),
        tag + "none of these": ("", 1), tag + "MIT see the file LICENSE": ("mit", 0), tag + "MIT OR Apache-2.0. All of it": ("apache-2.0,mit", 0),
        tag + "LicenseRef-Ours": ("licenseref-ours", 0), tag + "LicenseRef-Ours -->": ("licenseref-ours", 0), tag + "Foo-1.0 */": ("foo-1.0", 0), tag + "Foo-1.0.": ("foo-1.0", 0),
        tag + "GPL-2.0-only WITH Classpath-exception-2.0 as stated": ("gpl-2.0-only-with-classpath-exception-2.0", 0),
    }
    got = {r.text: (r.labels, r.n_malformed) for r in scan_licenses(spark.createDataFrame([(t, t) for t in rows], "text string, t string"), "text", "t").withColumnRenamed("doc_id", "text").collect()}
    assert got == rows
