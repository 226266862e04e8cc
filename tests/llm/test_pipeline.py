"""The pipeline's stages against brute force, each on its own input."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tillsight.llm import catalog, encode, pieces, toxicity
from tillsight.llm.common import table

from .conftest import SMALL
from .test_dedup_exact import brute_words
from .test_near import roots, shingles
from .test_tokens import brute_hits


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of every stage, written and read between them."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SMALL, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{i}")
        result = spark.read.parquet(f"{folder}/{i}")
        out.append((docs, {r.doc_id: r for r in docs.collect()}, result,
                    {r.doc_id: r for r in result.collect()}))
        docs = result
    return out


def test_all_stages_but_the_last_keep_the_columns(steps):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[2].columns for s in steps[:-1]] == [want] * 4
    assert "ids" in steps[-1][2].columns
    assert [len(s[1]) for s in steps] == sorted((len(s[1]) for s in steps), reverse=True)


def test_toxic_documents_go(spark, steps):
    docs, given, _, kept = steps[0]
    scores = toxicity.toxicity_report(docs, table(spark, SMALL, "labels")).collect()
    assert set(kept) == {r.doc_id for r in scores if r.predicted == 0}
    assert all(kept[i] == given[i] for i in kept)


def one_of_each(texts, percent):
    """Indices of the texts that are the first of their group of near copies."""
    sets = [shingles(t) for t in texts]
    root = roots(len(texts), [
        (a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])
    return {i for i in range(len(texts)) if root[i] == i}


def test_one_of_each_group_stays_at_80_percent(spark, steps):
    _, given, _, kept = steps[1]
    ids = sorted(given)
    assert set(kept) == {ids[i] for i in one_of_each([given[i].text for i in ids], 80)}
    assert all(kept[i] == given[i] for i in kept)


def test_pairs_between_80_and_85_percent_are_near_copies(spark):
    docs = table(spark, SMALL, "documents")
    rows = docs.orderBy("doc_id").collect()
    want = one_of_each([r.text for r in rows], 80)
    assert len(want) < len(one_of_each([r.text for r in rows], 85))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in kept) == sorted(rows[i].doc_id for i in want)


def test_repeated_passages_go(steps):
    import hashlib
    from collections import Counter
    _, given, _, kept = steps[2]
    assert set(kept) == set(given)
    want = brute_words([r.text for r in given.values()], 35)
    got = Counter()
    for i, r in kept.items():
        n, m = len(given[i].text.split()), len(r.text.split())
        assert r.n_chars == len(r.text)
        got[n, n - m, hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest()] += 1
    assert got == want


def test_benchmark_passages_go(spark, steps):
    _, given, _, kept = steps[3]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    some = sorted(given)[::7] + [i for i in given if i not in kept]
    for i in some:
        assert (i in kept) == (not brute_hits(given[i].text, items, 10)[1])


def test_ids_decode_to_the_texts(steps):
    _, given, _, kept = steps[4]
    encoder = encode.Encoder(pieces.load())
    assert set(kept) == set(given)
    for i, r in kept.items():
        assert r.n_tokens == len(r.ids)
        assert encoder.decode(__import__("numpy").array(r.ids, "int32"), [len(r.ids)])[0].decode() \
            == given[i].text


def test_run_equals_its_stages(spark, steps):
    rows = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert rows == {i: r.ids for i, r in steps[4][3].items()}


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert i == 4 or out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() and (n > 0) == (docs is odd)


def test_stages_keep_extra_columns_whatever_their_names(spark, odd):
    from pyspark.sql import functions as F
    names = ["grp", "score", "predicted", "passages", "n_words", "n_removed", "kept_text", "hit_words",
             "items", "spans", "lo", "root", "kept", "part", "body", "_rest", "a.b", "n items"]
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(catalog.QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLE))
def test_oracles(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
