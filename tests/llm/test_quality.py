"""Quality rules against a plain reading of the contract, and line by line."""

import re

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import quality
from broadsheet.llm.common import importable

WORD = r"[^\x20\x09-\x0D]+"
PROSE = " ".join(f"w{i}" for i in range(60)) + "."
LONG = "\n".join(" ".join(f"w{(i * j) % 4999}" for i in range(40)) + "." for j in range(2_000))
TEXTS = [
    None, "", " \n\t", "one", PROSE, LONG, f"{PROSE}\n{PROSE}\r\n{PROSE}\n\n{PROSE}", "a " * 300, "a b c a b c " + PROSE,
    "# $ <b> | & % *" + PROSE, f"Home | About | Contact\n{PROSE}", "all rights reserved\n" * 40 + PROSE,
    "x y   z\x0bq " + PROSE, "Grüße! " * 30, PROSE + "\nno end here " * 10, "a\nb\n" * 60,
]


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in set(windows) if len(windows) < 3_000 and windows.count(w) > 1}
    if len(windows) >= 3_000:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        twice = {w for w, n in seen.items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, PROSE), (4, PROSE), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"kept": F.lit("mine"), "n_words": F.lit(-1), "tags": F.create_map(F.lit("k"), F.lit(1))}
    ).repartition(3)


def test_counts_equal_a_plain_reading(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = quality.quality(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for row in rows:
        assert tuple(row[n] for n in names) == brute(row.text)
        assert row.kept == (not row.base_failed and 100 * row.n_lost_words <= 30 * row.n_words)
    assert quality.quality(docs.limit(0)).count() == 0
    assert {"tags", "clean_text"} <= set(quality.quality(docs).columns)
    assert "clean_text" not in quality.quality(docs, texts=False).columns


@pytest.mark.parametrize(
    "line, fault",
    [
        ("A plain sentence.", None), ('He said "no."', None), ("这是一句话。", None), ("Really?!", None),
        ("no mark at its end", "punctuation"), ("BUY!! IT!! NOW!!", "punctuation"), ("a### b$$$ c%%% d.", "punctuation"),
        ("Home | News | Contact us.", "navigation"), ("Next page »", "navigation"), ("Back to top.", "navigation"),
        ("Home > Sports > Football", "navigation"), ("Page 2 of 17.", "navigation"),
        ("© 2024 The Owner. All rights reserved.", "boilerplate"), ("We use cookies.", "boilerplate"),
        ("Released under the MIT License.", "boilerplate"), ("This work is licensed under some terms.", "boilerplate"),
        ("HOME IS WHERE THE HEART IS.", None), ("a | b.", None), ("\t Skip to content! \r", "navigation"), ('")]', "punctuation"),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line) == fault


def test_lines_go_first_then_documents(docs, spark):
    few = f"{PROSE}\nHome | About | Help\nAll rights reserved.\n{PROSE[:-1]}"
    rows = spark.createDataFrame([(1, few), (2, PROSE + "\nShare this.")], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.quality(rows).collect()}
    assert found[1].clean_text == PROSE and not found[1].kept
    assert found[1].n_punctuation == 1 and found[1].n_navigation == 1 and found[1].n_boilerplate == 1
    assert found[2].clean_text == PROSE and found[2].kept and found[2].n_lost_words == 2


def test_labelled_quality(spark, sf_dir):
    """Good documents stay, and most junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality(docs, texts=False).join(labels, "doc_id")
    good, bad = judged.filter("quality = 1 AND NOT base_failed"), judged.filter("quality = 0")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert bad.filter("kept").count() <= 0.1 * bad.count()
