"""The pipeline's stages on small tables: what goes, what stays, which columns come out."""

import random

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from compare import connect, rows_of, rows_of_sql

SF_DIR = "/root/testdata/sf0.001"
#: No SQL for merges, automata, fingerprints, models, suffix arrays, the ring or streaming digests.
WITHOUT_SQL = {"op1_licenses", "op5_simhash", "op6_bpe", "op7_suffix_dedup", "op8_token_counts", "op9_language", "op10_sharding", "op11_periodic_runs", "op12_private_data", "op13_prefix_trie", "pipeline"}


def test_stages_are_the_registered_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "bpe"]
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in entry_point.queries()
    assert {n for n in names if n not in entry_point.oracle_sql()} | {"pipeline"} == WITHOUT_SQL


@pytest.mark.parametrize("name", [n for n in entry_point.queries() if n.startswith("op")])
def test_query(spark, name):
    cols, rows = rows_of(entry_point.queries()[name](spark, SF_DIR))
    assert rows
    if name in entry_point.oracle_sql():
        want_cols, want = rows_of_sql(connect(SF_DIR), entry_point.oracle_sql()[name])
        assert cols == want_cols and rows == want


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Clean documents, a near and an exact copy, a leak, boilerplate, letterless and null texts, an extra column."""
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(8)
    syllables = {"en": "the ing th er and ou".split(), "de": "sch ein ung der lich keit".split()}
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    item = say("en", 30)
    rows = [(i, say(("en", "de")[i % 2], 80) + "\nread more stories on our web site\n" + say(("en", "de")[i % 2], 40), ("en", "de")[i % 2], f"s{i % 7}", 1, "own") for i in range(40)]
    words = rows[0][1].split(" ")
    words[30] = "altered"
    rows += [(40, rows[2][1], "en", "s1", 1, "own"), (41, " ".join(words), "en", "s3", 1, "own"), (42, say("en", 50) + " " + item + " " + say("en", 50), "en", "s2", 1, "own")]
    rows += [(43, "123 456 !!!", "en", "s1", 1, "own"), (44, None, None, None, None, None), (45, "", "en", "s1", 1, "own")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_drops_what_it_should_and_keeps_the_rest(spark, small):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, small)
        if name != "bpe":
            assert docs_out.columns == docs.columns
        docs = docs_out
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["language"]) == set(range(43))
    assert all("read more stories" not in r["text"] and r["n_chars"] == len(r["text"]) for r in kept["lines"].values())
    assert set(kept["near_duplicates"]) == set(range(43)) - {40, 41}
    assert set(kept["decontamination"]) == set(range(40))
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in kept["bpe"].values())


def test_pipeline_on_empty_tables(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
