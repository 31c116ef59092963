"""The pipeline against its stages written plainly, each on the rows that reached it."""

import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from scriptoria.llm import mixing, quality
from tests.llm.test_jaccard_join import shingle_set

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    out, docs = [], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, FOLDER).write.parquet(folder)
        after = spark.read.parquet(folder)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    columns = stages[0][0].columns
    assert [after.columns for _, after in stages[:-1]] == [columns] * 4
    assert stages[-1][1].columns == [*columns, "ids", "n_tokens"]


def test_rejected_go_and_clean_stay(spark, stages):
    before, after = stages[0]
    model = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = quality.score_quality(before, model)
    assert ids(after) == sorted(r["doc_id"] for r in scored.collect() if r["quality_score"] >= 0.5)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(ids(after))
    assert sum(d in kept for d, q in labels.items() if q) / sum(labels.values()) > 0.98


def test_one_of_equal_texts(stages):
    before, after = stages[1]
    best = {}
    for d, t in texts(before).items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(t), d))
    assert ids(after) == sorted(d for _, d in best.values()) and len(best) < before.count()


def test_one_of_similar_texts(stages):
    before, after = stages[2]
    rows = texts(before)
    sets = {d: shingle_set(t, 5) for d, t in rows.items()}
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = {}
    for d in sorted(rows):
        for g in sets[d]:
            by.setdefault(g, []).append(d)
    for d in rows:
        for e in {e for g in sets[d] for e in by[g] if e > d}:
            common = len(sets[d] & sets[e])
            if 100 * common >= 80 * (len(sets[d]) + len(sets[e]) - common):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    assert ids(after) == sorted(d for d in rows if find(d) == d) and after.count() < before.count()


def test_mix_takes_what_the_operator_says(stages):
    before, after = stages[3]
    want = {}
    for r in mixing.mix(before).collect():
        want[r["at"]["doc_id"]] = r["epochs"] + (r["part"] > 0 and 2 * r["part"] >= r["at"]["size"])
    assert ids(after) == sorted(d for d, n in want.items() for _ in range(n))


def test_ids_are_the_librarys(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = stages[4][1].collect()
    assert len(rows) == stages[4][0].count()
    assert all(r["ids"] == library.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(stages[-1][1])
