import re

import corpus_pipeline as C
import pytest
from tokenizers import Tokenizer

import test_decontaminate
import test_jaccard_join
import test_packing
import test_substrings
from conftest import WORDS
from probefleet.llm import perplexity
from probefleet.llm.workspace import settled, table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(WORDS, text or "")


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for name, stage in C.STAGES:
        docs = settled(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(outputs):
    assert [name for name, _ in C.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    for df in outputs[:-1]:
        assert df.columns == COLUMNS and df.schema == outputs[0].schema
        assert df.where("n_chars != length(text)").count() == 0


def test_quality_rejects_only_what_the_classifier_rejects(spark, outputs):
    judged = perplexity.quality_classifier(outputs[0], table(spark, SF, "labels")).collect()
    assert sorted(outputs[1].collect()) == sorted(
        r for r in outputs[0].collect() if r.doc_id in {j.doc_id for j in judged if j.kept}
    )
    assert 0 < outputs[1].count() < outputs[0].count()


def test_one_document_of_each_group(outputs):
    groups = test_jaccard_join.brute(pairs(outputs[1]))
    kept = {d for d, _, c in groups if d == c}
    assert len(kept) < len(groups)
    assert sorted(outputs[2].collect()) == sorted(r for r in outputs[1].collect() if str(r.doc_id) in kept)


def test_repeats_are_cut(outputs):
    want = test_substrings.brute(pairs(outputs[2]))
    assert any(r[2] for r in want)
    digest = lambda text: test_substrings.hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
    assert sorted((str(d), digest(t)) for d, t in pairs(outputs[3])) == sorted((r[0], r[3]) for r in want)


def test_leaks_are_cut(spark, outputs):
    benchmark = pairs(table(spark, SF, "benchmark").withColumnRenamed("item_id", "doc_id"))
    before = test_decontaminate.brute(pairs(outputs[3]), benchmark)
    n_hit = {d: (hit, n) for d, n, hit, *_ in before}
    assert any(hit for hit, _ in n_hit.values())
    stays = {d for d, (hit, n) in n_hit.items() if hit <= 0.5 * n}
    after = {str(d): t for d, t in pairs(outputs[4])}
    assert set(after) == stays
    for d, t in pairs(outputs[3]):
        if str(d) in stays:
            hit, n = n_hit[str(d)]
            assert len(test_decontaminate.words(after[str(d)])) == n - hit and (hit or after[str(d)] == t)


def test_everything_is_packed(outputs):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used, least = test_packing.check(outputs[5].collect(), pairs(outputs[4]), tokenizer, 2048, True)
    assert used <= least + 2


def test_run_gives_the_last_stage(spark, outputs):
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, outputs[-1].collect()))


def test_odd_rows_pass_all_stages(spark, odd_documents, tmp_path):
    # Languages without blanks, with words of more bytes than a piece, and columns named as the stages name their own.
    more = [(20, "日本語のテキストは空白を含まない" * 30, "ja"), (21, "ภาษาไทยไม่มีช่องว่าง" * 20, "th"), (22, "字" * 22, "zh"), (23, "x" * 63 + "é", "en")]
    clashing = odd_documents.unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True
    ).selectExpr("*", "array(1) as spans", "'i' as items", "2 as _key", "struct(3 as `a b`) as _spans", "4 as packed", "5 as `slice`", "6 as id")
    for name, df in (
        ("documents", clashing),
        ("labels", spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, None), (2, "no id here but a few words to read")], "item_id long, text string")),
    ):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in C.STAGES[:-1]:
        docs = settled(stage(spark, docs, str(tmp_path)), name)
    assert docs.columns == clashing.columns
    assert {tuple(map(str, (r["spans"], r["items"], r["_key"], r["_spans"]["a b"], r["packed"]))) for r in docs.collect()} == {
        ("[1]", "i", "2", "3", "4")
    }
    ids = [r.doc_id for r in docs.collect()]
    # The repeated row is one of a group; the row without an id is mostly leaked.
    assert len(ids) == len(set(ids)) and None not in ids and {1, 2, 3, 5, 6, 20, 21, 22, 23} <= set(ids)
    assert C.run(spark, str(tmp_path)).where("doc_id is not null").count() >= len(ids)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
