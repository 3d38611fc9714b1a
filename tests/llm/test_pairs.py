import random

import pytest

from grainstore.llm import pairs as P

NOUNS = "server table queue cache index parser session manifest".split()


def _answer(rng):
    return " ".join(f"The {rng.choice(NOUNS)} reads the {rng.choice(NOUNS)} after {rng.randrange(9999)} rows and keeps the {rng.choice(NOUNS)}." for _ in range(rng.randrange(1, 5)))


def _korean(rng):
    return " ".join(f"{rng.choice(['서버는', '캐시는', '색인은'])} 다시 시작한 뒤에 {rng.randrange(999)}개 행을 {rng.choice(['읽습니다', '저장합니다', '비교합니다'])}." for _ in range(rng.randrange(1, 4)))


def _pairs(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ko = i % 2
        q = f"{rng.choice(['캐시가', '서버가'])} {rng.randrange(999)}번에서 멈추는 이유가 무엇인가요?" if ko else f"Why does the {rng.choice(NOUNS)} stop at {rng.randrange(999)} entries?"
        a = _korean(rng) if ko else _answer(rng)
        out.append((q, a, a if i % 3 else None, a))
    return out


@pytest.fixture(scope="module")
def model():
    return P.fit_pairs(_pairs())


def _judge(model, q, a, payload=None):
    return model.judge(q, a, payload, a if a and a.strip(" .\n") else None)[0]


def test_sound_answers_pass(model):
    assert sum(model.judge(*p)[0] is not None for p in _pairs(300, 2)) <= 3


def test_held_out_defects_are_found(model):
    rng = random.Random(5)
    hits = {d: 0 for d in P.DEFECTS}
    n = 60
    for i in range(n):
        q, a = f"Why does the {rng.choice(NOUNS)} stop at {rng.randrange(999)} entries?", _answer(rng)
        hits["truncated"] += _judge(model, q, a[: len(a) // 2].rstrip(" .") + "x") == "truncated"
        hits["copied_question"] += _judge(model, q, rng.choice([q, "> " + q, q + "\n" + q, q[4:]])) == "copied_question"
        hits["wrong_language"] += _judge(model, q, _korean(rng)) == "wrong_language"
        hits["refusal"] += _judge(model, q, P.synthetic_refusal(random.Random(1000 + i), "en")) == "refusal"
    assert all(v >= 0.9 * n for v in hits.values()), hits


def test_kinds(model):
    q = "Why does the server stop at 12 entries?"
    assert _judge(model, q, None) == "empty" and _judge(model, q, " ... ") == "empty"
    assert _judge(model, q, "I'm sorry, but I can't help with that.") == "refusal"
    good = _answer(random.Random(9))
    assert _judge(model, q, f"{good} I cannot answer that part.") is None  # declines in part only
    assert _judge(model, q, f"> {q}\n\n{good} {good}") is None  # quotes the question and answers
    assert model.judge(q, good[:40] + " and th", good, good[:40] + " and th")[0] == "truncated"
    assert _judge(model, q, good + "\n\n```\nx = 1\ny = 2") == "truncated"


def test_pairs_of_threads(spark):
    rows = [
        (1, 5, "user", "q1", None, "2024-01-01 00:00:00"), (2, 5, "system", "s", None, "2024-01-01 00:00:01"), (3, 5, "AI ", None, '{"answer": "a1"}', "2024-01-01 00:00:02"),
        (4, 5, "assistant", "a2", None, "2024-01-05 00:00:03"), (5, 5, "user", " ", None, "2024-02-01 00:00:00"), (6, 5, "bot", "a3", None, "2024-02-01 00:00:01"),
        (7, 6, "user", "q2", None, "2024-01-01T09:00:00+09:00"), (8, 6, "assistant", "", "{bad", "2024-03-01 00:00:00"), (9, None, "assistant", "x", None, "2024-01-01 00:00:00"),
        (3, 5, "AI ", None, '{"answer": "a1"}', "2024-01-01 00:00:02"), (10, 7, "assistant", "first", None, "no time"),
    ]
    df = spark.createDataFrame(rows, "id long, thread_id long, role string, content string, payload_json string, created_at string").selectExpr("*", "timestamp'2024-06-01' as loaded_at", "1 as text")
    got = {(r.turn_id, r.question, r.text) for r in P.question_answer_pairs(df.drop("text")).collect()}
    assert got == {(3, "q1", "a1"), (8, "q2", None)}
    found = {(r.turn_id, r.defect) for r in P.broken_pairs(df).collect()}
    assert (8, "empty") in found
    assert P.broken_pairs(df.where("false")).count() == 0
