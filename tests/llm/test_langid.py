import base64
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import langid

from .corpus import documents, rows

STEMS = {"en": ["the", "ing", "with", "that", "tion", "ough"], "de": ["der", "ung", "sch", "heit", "über", "ein"], "fr": ["que", "eau", "ère", "tre", "oui", "ç"]}


def corpus(spark, n=240):
    rng = random.Random(5)
    data = []
    for i in range(n):
        lang = "en de fr".split()[i % 3]
        text = " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) for _ in range(rng.randint(5, 60)))
        data.append((i, text.upper() if i % 11 == 0 else text, lang if i % 13 else None))
    return spark.createDataFrame(data + [(900, None, "en"), (901, "", "de"), (902, "12 34 !!", "fr"), (903, "漢字" * 40, None)], "doc_id long, text string, lang string")


def brute_counts(text, slots=4096):
    x = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", (text or "").lower().encode())
    out = np.zeros(slots)
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            key = 0
            for b in x[i : i + n]:
                key = (key * 257 + b) % 2**32
            out[((key + n * 0x1000193) * 2654435761) % 2**32 >> 20] += 1
    return out


def test_gram_counts():
    items = ["Hello, World!", None, "", "é", "aé 1 b", "x" * 50, "ÀB"]
    assert np.array_equal(langid.gram_counts(pa.array(items)), np.array([brute_counts(t) for t in items]))


def test_long_text_in_pieces():
    text = "abc dé " * 200_000
    whole = langid.gram_counts(pa.array(["q", text, "z"]))
    assert whole[1].sum() == 3 * len(text.encode()) - 3


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    assert set(model.langs) == {"en", "de", "fr"} and len(model.langs) > 3
    got = {r.id: r for r in langid.languages(docs, model).collect()}
    truth = {r.doc_id: "en de fr".split()[r.doc_id % 3] for r in docs.collect() if r.doc_id < 900}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == truth[i] for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].rejected and not any(got[i].rejected for i in truth)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_text_is_read(spark):
    docs = corpus(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    a = sorted(map(str, langid.languages(docs, model).collect()))
    b = sorted(map(str, langid.languages(docs.withColumn("lang", F.lit("xx")), model).collect()))
    assert a == b


def test_edges(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    assert langid.languages(docs, model).count() == len(rows())
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.languages(docs, empty).collect()} == {"und"}
    assert langid.languages(docs.limit(0), model).count() == 0


OTHERS = {
    "pl": "W Polsce jest wiele pięknych miast, które warto zobaczyć. Dzisiaj pogoda jest bardzo ładna i wszyscy chodzą na spacer do parku. ",
    "fi": "Suomessa on paljon järviä ja metsiä. Tänään on kaunis päivä ja kaikki menevät kävelylle puistoon, koska aurinko paistaa. ",
    "tr": "Bugün hava çok güzel ve herkes parkta yürüyüşe çıkıyor. Ülkemizde birçok güzel şehir ve köy var, hepsini görmek isterim. ",
}


def test_unlearned_languages_and_blobs_are_rejected_and_clean_texts_stay(spark):
    docs = corpus(spark, 1200)
    model = langid.fit(docs.filter(~langid.held_out()))
    assert (np.diff(model.floor, axis=1) >= 0).all()
    rng = random.Random(4)
    strange = [t * 4 for t in OTHERS.values()] + [base64.b64encode(rng.randbytes(600)).decode(), " ".join("".join(rng.choice("bcdfgjkpqvwxyz") for _ in range(6)) for _ in range(90))]
    _, _, rejected = model.predict(pa.array(strange))
    assert rejected.all()
    held = [r.text for r in docs.collect() if r.doc_id < 1200 and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    _, _, rejected = model.predict(pa.array(held + [t[:20] for t in held] + [t[:50] for t in held]))
    assert rejected.mean() <= 0.005


def test_predictions_by_brute_force(spark):
    docs = corpus(spark)
    train = docs.filter(~langid.held_out())
    model = langid.fit(train)
    rows = [r for r in train.collect() if r.lang is not None and re.search(r"[^\W\d_]", r.text or "")]
    df = sum((brute_counts(r.text) > 0).astype(int) for r in rows)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf, atol=1e-5)
    for r in langid.languages(docs, model).collect():
        text = next(d.text for d in docs.collect() if d.doc_id == r.id) if r.id in (1, 17, 44, 143, 900) else None
        if text:
            x = np.log1p(brute_counts(text)) * idf
            cosine = model.centroids @ (x / np.linalg.norm(x))
            assert r.lang_pred == model.langs[int(cosine.argmax())] and abs(r.score - cosine.max()) < 1e-4


def test_sample_is_the_rows_of_least_hash_and_repeats_count_once(spark):
    docs = corpus(spark, 300).filter("lang = 'en' and text is not null")
    many = docs.union(docs.filter("doc_id = 0").crossJoin(spark.range(400)).select("doc_id", "text", "lang"))
    a, b = (langid.fit(x, per_language=20, reject_share=0.0, slack=1.0) for x in (docs, docs.repartition(7)))
    assert np.array_equal(a.centroids, b.centroids) and np.array_equal(a.floor, b.floor)
    assert langid.fit(many, per_language=1000).centroids.shape == (3, langid.SLOTS)


def test_clashing_column_names(spark):
    docs = corpus(spark).withColumn("__lang_rejected", F.lit(7)).withColumn("lang_pred", F.lit("q"))
    model = langid.fit(docs)
    out = langid.with_language(docs, model)
    assert out.columns == [*docs.columns, "__lang_rejected_"] and out.filter("__lang_rejected_").count() >= 3 and out.filter("__lang_rejected = 7").count() == docs.count()
