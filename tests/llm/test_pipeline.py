"""Each stage against a plain version of it, on a small table with nulls, copies and personal data."""

import itertools
import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import mixing, pieces, pii, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(11)
    data = []
    for i in range(150):
        words = [rng.choice(["the", "and", "house", "water", "light", "road", "stone"]) + rng.choice(["", "s", "ing", "ed"]) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(rng.randint(8, 80))]
        data.append([i, " ".join(words) + rng.choice(["", " mail a.b@example.org now", " call +1 (212) 555-0187 or"]), "en" if i % 3 else "de", f"s{i % 3}" if i % 10 else None])
    data += [[200, data[3][1], "en", "s0"], [201, data[4][1], "en", "s1"], [202, data[4][1] + " x", None, "s1"], [203, None, "en", "s1"], [204, "12 !!", "en", "s1"], [205, "", "de", None], [206, "漢字漢字" * 30, None, "s2"]]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in data], COLUMNS)
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return [x.collect() for x in out], out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixing", "pieces"]
    for df in stages[1][1:5]:
        assert df.columns == stages[1][0].columns and dict(df.dtypes) == dict(stages[1][0].dtypes)


def test_language_stage(stages):
    before, after = stages[0][0], stages[0][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {203, 204, 205, 206}
    assert all(r in before for r in after)


def test_duplicate_stage(stages):
    """Runs of five words in lower case, Jaccard similarity of 0.8 or more, the least id of each component stays."""
    before, after = stages[0][1], stages[0][2]
    sets = {}
    for r in before:
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert sorted(r.doc_id for r in after) == sorted(set(root.values()))
    assert {200, 201, 202} & {r.doc_id for r in after} == set()


def test_personal_data_stage(stages):
    before, after = ({r.doc_id: r for r in stages[0][k]} for k in (2, 3))
    assert before.keys() == after.keys()
    for i, r in after.items():
        _, every = pii.all_spans(pii.trained(), pa.array([before[i].text]))[0]
        assert r.text == pii.redact(before[i].text, every) and r.n_chars == len(r.text)
        assert "@" not in r.text and "555-0187" not in r.text
    assert any("[email]" in r.text for r in after.values()) and any("[phone]" in r.text for r in after.values())


def test_mixing_stage(stages, spark):
    before, after = stages[0][3], stages[0][4]
    copies = {r.doc_id: r.mix_copies for r in mixing.mixed(spark.createDataFrame(before, COLUMNS)).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, n in copies.items() for _ in range(n))
    assert set(after) <= set(before)


def test_piece_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model())
    texts = {r.doc_id: r.text for r in stages[0][4]}
    assert len(stages[0][5]) == len(stages[0][4])
    assert all(r.piece_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.piece_ids) for r in stages[0][5])


def test_empty_table(spark, stages):
    docs = stages[1][0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_simhash_keeps_clean(stages):
    assert simhash.simhash_components(stages[1][0].filter("doc_id < 150")).filter(F.col("id") != F.col("component_id")).count() == 0
