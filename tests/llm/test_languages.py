import unicodedata

import pytest

from grainstore.llm import languages as L

EN = "The server reads the old table after the restart. It does not keep the lock when the disk is full."
DE = "Der Server liest die alte Tabelle nach dem Neustart. Es gibt keine Sperre, wenn die Platte voll ist."
ES = "El servidor lee la tabla antigua después del reinicio. No hay ningún bloqueo cuando el disco está lleno."
KO = "서버는 다시 시작한 뒤에 오래된 표를 읽습니다. 디스크가 가득 차면 잠금을 유지하지 않습니다."
JA = "サーバーは再起動の後に古い表を読み込みます。ディスクがいっぱいのときはロックを保ちません。"
ZH = "服务器重启以后会读取旧的表。磁盘满的时候不会保持锁定。"
ALL = {"en": EN, "de": DE, "es": ES, "ko": KO, "ja": JA, "zh": ZH}


@pytest.fixture(scope="module")
def model():
    return L.fit([t for t in ALL.values() for _ in range(3)])


def _languages(model, text):
    return list(L.label_texts(model, [text])[0].languages)


@pytest.mark.parametrize("lang", list(ALL))
def test_one_language(model, lang):
    assert _languages(model, ALL[lang]) == [lang]
    assert _languages(model, unicodedata.normalize("NFD", ALL[lang])) == [lang]
    assert _languages(model, "﻿" + ALL[lang].upper()) == [lang]


def test_paragraphs_of_several_languages(model):
    assert _languages(model, f"{EN}\n{KO}\n\n{DE}") == ["de", "en", "ko"]
    assert _languages(model, f"{JA}\n{ZH}") == ["ja", "zh"]


def test_a_quotation_code_and_settings_are_no_language(model):
    assert _languages(model, f'{KO} ("no such column in the table")\nThis is one sentence.') == ["ko"]
    assert _languages(model, f"{KO}\n```\n{EN}\n{EN}\n```\nserver.port=80\n") == ["ko"]


def test_texts_without_words(model):
    for text in ("", " \n", "1234 !!", "`code` /a/b", "ab cd"):
        assert isinstance(_languages(model, text), list)
    assert _languages(model, "12 !!") == []


def test_viterbi_prefers_few_switches():
    import numpy as np

    s = np.full((5, 6), -1.0)
    s[:, 0] = 1.0
    s[2, 1] = 2.0
    assert L.viterbi([s], 6.0)[0].tolist() == [0] * 5
    assert L.viterbi([s], 0.1)[0].tolist() == [0, 0, 1, 0, 0]
    assert [len(x) for x in L.viterbi([s[:0], s[:2], s], 6.0)] == [0, 2, 5]


def test_labels_in_any_notation(spark):
    from pyspark.sql import functions as F

    rows = [("EN", "en"), ("en-US", "en"), (" kor ", "ko"), ("ko_KR", "ko"), ("한국어", "ko"), ("German", "de"), ("??", None), ("", None), (None, None), ("und", None)]
    df = spark.createDataFrame(rows, "label string, want string").withColumn("got", L.named_language(F.col("label")))
    assert all(r.got == r.want for r in df.collect())


def test_operator(spark):
    rows = [(1, EN, "en"), (2, EN, "ko"), (3, KO, None), (4, f"{EN}\n{KO}", "en"), (5, None, "en"), (6, "", None), (7, "x " * 30_000, "en"), (2, EN, "ko")]
    rows += [(10 + i, t, k) for i, (k, t) in enumerate(ALL.items())]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, confidence string")
    found = {(r.doc_id, r.lang) for r in L.mislabelled(df).collect()}
    assert {x for x in found if x[0] != 7} == {(2, "en"), (3, "ko"), (4, "en"), (4, "ko")}
    spans = L.language_spans(df).where("doc_id = 4").orderBy("span").collect()
    assert [(s.span, s.lang) for s in spans] == [(0, "en,ko"), (1, "en"), (2, "ko")]
    text = f"{EN}\n{KO}"
    assert text[spans[2].char_start : spans[2].char_end].startswith("서버는") and all(0 <= s.confidence <= 1 for s in spans)
    assert L.mislabelled(df.where("false")).count() == 0 and L.language_spans(df.where("false")).count() == 0


def test_all_texts_are_fitted_to(spark):
    texts = [t for t in ALL.values() for _ in range(400)]
    texts.append("zzgrault " * 30 + "and the garply is not in this. " + "x " * 60_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").repartition(5)
    model, whole = L.fit_documents(docs), L.fit(texts)
    assert model.grams.keys() == whole.grams.keys() and all((model.grams[g] == whole.grams[g]).all() for g in whole.grams)
    assert "<zzgrault>" in model.grams
