"""Problem 2: broken question-answer pairs, by a multi-label linear classifier trained on synthetic defects."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainstore.llm.languages import LANGUAGES, WORD, LanguageConfig, LanguageModel, fit, normal, prose_lines
from grainstore.llm.turns import event_time, is_blank, ordered_lag, payload_answer, role_of, turn_text

DEFECTS = ("truncated", "refusal", "copied_question", "wrong_language")


@dataclass(frozen=True)
class PairConfig:
    """``fit_pairs``: pairs the classifier is fitted on, at most, of ``fit_chars`` characters at most; ``bits`` of the
    hash of an n-gram; ``held_out``: share of the synthetic pairs the thresholds are calibrated on; ``penalty`` on the weights of refusals, whose
    n-grams are many and whose unlabelled counterexamples hold refusals too."""

    fit_pairs: int = 2000
    fit_chars: int = 20_000
    bits: int = 16
    held_out: float = 0.25
    rounds: int = 120
    penalty: float = 2e-3
    seed: int = 7


# ---------------------------------------------------------------- synthetic refusals

#: Parts that synthetic refusals are put together from, one list per slot; {} takes one of the language's objects.
REFUSALS = {
    "en": (
        ["", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "Apologies, ", "Regrettably, ", "As an assistant, "],
        ["I can't help with {}.", "I cannot answer {}.", "I am not able to {v} {}.", "I won't {v} {}.", "I'm unable to {v} {}.", "I have to decline {}.", "I'd rather not {v} {}.", "I must pass on {}.",
         "I am not allowed to {v} {}.", "my guidelines do not let me {v} {}.", "{} is something I cannot {v}.", "{} is outside of what I can {v}.", "{} is not something I'm permitted to {v}.", "{} can't be answered by me.", "no answer can be given to {}.", "it's against my policy to {v} {}."],
        ["", "", " Please ask your administrator.", " Is there something else you need?", " Please contact the owner.", " Thank you for understanding."],
        ["that", "this", "that request", "this question", "your question", "this topic", "that module", "this class", "the code in question", "such information"],
        ["discuss", "share details about", "comment on", "explain", "answer", "talk about", "fulfil", "describe"],
    ),
    "ko": (
        ["", "죄송하지만 ", "죄송합니다. ", "미안하지만 ", "안타깝게도 ", "유감스럽게도 ", "미안합니다. ", "정책상 ", "저는 ", "제가 "],
        ["{}에 대해 설명할 수 없습니다.", "{}에 대해 말씀드릴 수 없습니다.", "{}에는 답할 수 없습니다.", "{}을 알려 드리지 못합니다.", "{}은 논의할 수 없습니다.", "{}에 대해 답변을 드릴 수 없습니다.", "{}은 도와드릴 수 없습니다.", "{}은 설명할 수 없습니다.", "{}에 답변드리기 어렵습니다.", "{}은 제가 다룰 수 있는 범위를 벗어납니다.", "{}은 답하지 않겠습니다.", "{}은 말씀드릴 수 없어요.", "{}은 제공이 제한되어 있습니다.",
         "{}은 안내해 드릴 수 없는 점 양해 부탁드립니다.", "{}은 공개가 불가합니다.", "{}에는 응답이 불가합니다.", "{}은 알려 드릴 수 없습니다.", "{}에 대한 답변은 거절하겠습니다.",
         "답변이 불가한 {}입니다.", "답변할 수 없는 {}입니다.", "안내가 어려운 {}입니다.", "답변이 제한된 {}입니다."],
        ["", "", " 관리자에게 문의해 주세요.", " 양해 부탁드립니다.", " 다른 질문을 해 주세요.", " 담당자에게 확인해 주시기 바랍니다."],
        ["이 질문", "질문", "해당 요청", "그 내용", "관련 내용", "요청하신 정보", "이 부분", "그 클래스", "이 주제", "문의하신 사항"],
        [""],
    ),
    "ja": (
        ["", "申し訳ありませんが、", "すみませんが、", "恐れ入りますが、", "残念ながら、"],
        ["{}にはお答えできません。", "{}についてはお手伝いできません。", "{}は説明できません。", "{}へのお答えは控えさせていただきます。", "{}はご案内できません。", "{}は私の範囲を超えています。", "{}をお伝えすることはできません。", "{}への回答はできかねます。"],
        ["", "", "管理者にお問い合わせください。", "ご了承ください。"],
        ["その質問", "このご依頼", "この内容", "その件", "ご質問の件", "このクラス"],
        [""],
    ),
    "zh": (
        ["", "抱歉，", "很抱歉，", "对不起，", "不好意思，", "很遗憾，"],
        ["我无法回答{}。", "我不能回答{}。", "我无法提供{}。", "{}我帮不了忙。", "我不便讨论{}。", "{}超出了我能处理的范围。", "根据规定，我不能说明{}。", "恕我无法解答{}。"],
        ["", "", "请联系管理员。", "敬请谅解。"],
        ["这个问题", "该请求", "相关内容", "您要的信息", "这个类", "这方面"],
        [""],
    ),
    "de": (
        ["", "Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", "Tut mir leid, "],
        ["kann ich {} nicht beantworten.", "ich kann bei {} nicht helfen.", "darf ich zu {} nichts sagen.", "ich darf {} nicht erläutern.", "möchte ich {} nicht beantworten.", "{} liegt außerhalb dessen, was ich beantworten darf.", "zu {} kann ich keine Auskunft geben.", "ich bin nicht in der Lage, {} zu beantworten."],
        ["", "", " Bitte wenden Sie sich an den Administrator.", " Ich bitte um Verständnis."],
        ["diese Frage", "dieser Anfrage", "diesem Thema", "dieser Klasse", "das"],
        [""],
    ),
    "es": (
        ["", "Lo siento, pero ", "Lamentablemente, ", "Disculpe, ", "Lo lamento, "],
        ["no puedo responder a {}.", "no puedo ayudar con {}.", "no me está permitido hablar de {}.", "prefiero no contestar a {}.", "no estoy autorizado para explicar {}.", "{} está fuera de lo que puedo responder.", "no es posible dar información sobre {}.", "debo rechazar {}."],
        ["", "", " Consulte con el administrador.", " Gracias por su comprensión."],
        ["esa pregunta", "esta solicitud", "ese tema", "esta clase", "eso"],
        [""],
    ),
}


def synthetic_refusal(rng: random.Random, language: str) -> str:
    """One to two refusing sentences put together from parts."""
    lead, core, tail, objects, verbs = REFUSALS[language]
    out = []
    for _ in range(1 if rng.random() < 0.7 else 2):
        body = rng.choice(core).replace("{v}", rng.choice(verbs)).replace("{}", rng.choice(objects))
        start = rng.choice(lead)
        text = start + body if start else body[:1].upper() + body[1:]
        out.append(text)
    sep = "" if language in ("ja", "zh") else " "
    return sep.join(out) + rng.choice(tail)


# ---------------------------------------------------------------- features

SENTENCES = re.compile(r"[^.!?。！？\n]*(?:\.(?=\w)[^.!?。！？\n]*)*(?:[.!?。！？]+[\"'”)」]*|\n|$)")
FENCE_MARK = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
CODE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t\r]*$|\Z)", re.M | re.S)
_EDGE = re.compile(r"[^\w]+")


def _hash(text: str, bits: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def ngrams(text: str) -> list[str]:
    """Words and pairs of words; of Hangul, kana and Han words also the runs of two and three letters."""
    words = WORD.findall(text.lower())
    out = [f"w{w}" for w in words] + [f"p{a} {b}" for a, b in zip(["<", *words], [*words, ">"], strict=True)]
    for w in words:
        if w[0] >= "ᄀ":
            out += [f"c{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)]
    return out


def sentences_of(text: str) -> list[str]:
    """Sentences with a letter or digit in them, outside code blocks."""
    return [s for s in SENTENCES.findall(CODE.sub("\n", text)) if re.search(r"\w", s)]


def _kind(ch: str) -> str:
    if ch in ".!?。！？…":
        return ch
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "hangul" if "가" <= ch <= "힣" else "wide" if ch > "⺀" else "letter"
    return ch if ch in "`)]}\"'”’」』:;,-({[/|*" else "other"


def tail_features(content: str | None, payload: str | None) -> list[str]:
    """How a content stops: its last marks, open code blocks and quotes, and whether the payload goes on."""
    text = (content or "").rstrip()
    if not re.search(r"[^\W_]", text):
        return ["tail-none"]
    out = []
    last = text[text.rfind("\n") + 1 :]
    open_block = len(FENCE_MARK.findall(text)) % 2 == 1
    ends = text[-1]
    if re.search(r"[^.。…](?:\.\.\.|…+)$", text):
        ends = "dots" if not re.search(r"[.!?。！？](?:\.\.\.|…)$", text) else "dots-after"
    item = re.match(r"\s*(?:[-*•]|\d+[.)])\s", last)
    # a list entry, a closed fence and a note in brackets end as they should; bare text does not
    shape = "fence" if last.startswith("```") else "item" if item else "heading" if last.startswith("#") else "plain"
    key = ends if ends in ("dots", "dots-after") else _kind(ends)
    out.append(f"tail {shape} {key}")
    out.append(f"tail-block {open_block}")
    if item:
        out.append(f"item {'whole' if re.search(r'[:=]\s*\S', last) else 'part'} {key}")
    out.append(f"tick {last.count('`') % 2 if shape != 'fence' else 0}")
    out.append(f"bracket {last.count('(') > last.count(')')}")
    if payload and content:
        whole, stem = payload.rstrip(), re.sub(r"(?:\.\.\.|…)$", "", text)
        longer = len(whole) > len(text) and whole.startswith(stem)
        out.append(f"payload {'longer' if longer else 'same' if whole == text else 'other'}")
    else:
        out.append("payload none")
    return out


def _bin(name: str, x: float, steps: int = 10) -> str:
    return f"{name} {min(steps, int(x * steps + 1e-9))}"


def _trigrams(text: str) -> set[str]:
    flat = _EDGE.sub(" ", normal(text).lower()).strip()
    return {flat[i : i + 3] for i in range(max(1, len(flat) - 2))} if flat else set()


def copy_features(question: str, answer: str) -> list[str]:
    """How much of the answer is in the question and of the question in the answer, by runs of three letters."""
    q, a = _trigrams(question), _trigrams(answer)
    if not q or not a:
        return ["copy none"]
    both = len(q & a)
    inside, covered = both / len(a), both / len(q)
    ratio = len(answer) / max(1, len(question))
    return [_bin("inside", inside, 20), _bin("covered", covered), f"inside-covered {int(inside * 5)} {int(covered * 5)}", _bin("ratio", min(1.0, ratio / 4), 8), f"ask {answer.rstrip()[-1:] in '?？'}"]


def language_of(model: LanguageModel, text: str) -> np.ndarray:
    """Mean score of the prose of a text per language; all zero without prose."""
    total, n = np.zeros(len(LANGUAGES)), 0
    for _, line in prose_lines(normal(text)):
        for w in WORD.findall(line.lower()):
            total += model.score(w)
            n += 1
    return total / n if n else total


def language_features(q: np.ndarray, a: np.ndarray) -> list[str]:
    """Whether the languages of question and answer, as ``language_of`` scores them, differ and how surely; a side
    without prose says nothing."""
    if not q.any() or not a.any():
        return ["language none"]
    lq, la = int(q.argmax()), int(a.argmax())
    lead = min(3.0, max(0.0, float(a[la] - a[lq])))
    return [f"language {'same' if lq == la else 'other'}", _bin("lead", lead / 3, 6), _bin("own", min(1.0, max(0.0, (float(a[la]) + 1) / 5)), 5) + f" {lq == la}"]


# ---------------------------------------------------------------- classifier


@dataclass
class PairModel:
    """Weights and thresholds of each defect, and the word scores that languages are told by."""

    weights: dict[str, np.ndarray]
    thresholds: dict[str, float]
    language: LanguageModel
    config: PairConfig

    def score(self, label: str, features: list[str]) -> float:
        w = self.weights[label]
        rows = [_hash(f, self.config.bits) for f in features]
        return float(w[rows].sum() / (len(rows) ** 0.5 if label == "refusal" else 1.0) + w[-1]) if rows else float(w[-1])

    def judge(self, question: str, content: str | None, payload: str | None, text: str | None) -> tuple[str | None, float]:
        """The defect of one pair and how far its score is over its threshold; None where there is none.

        An answer only declines if each of its sentences does, so the least of their scores counts.
        """
        if text is None or not re.search(r"[^\W_]", text):
            return "empty", 1.0
        over = {"truncated": self.score("truncated", tail_features(content, payload)) - self.thresholds["truncated"]}
        over["copied_question"] = self.score("copied_question", copy_features(question, text)) - self.thresholds["copied_question"]
        over["wrong_language"] = self.score("wrong_language", language_features(language_of(self.language, question), language_of(self.language, text))) - self.thresholds["wrong_language"]
        least = float("inf")
        for s in sentences_of(text):
            least = min(least, self.score("refusal", ngrams(s)))
            if least < self.thresholds["refusal"]:
                break
        else:
            if least < float("inf") and "```" not in text:
                over["refusal"] = least - self.thresholds["refusal"]
        # a copy or a refusal may stop anywhere and be in any language; what it is goes first
        for first in ("copied_question", "refusal", "truncated", "wrong_language"):
            if over.get(first, -1.0) > 0:
                return first, over[first]
        return None, max(over.values())


def _train(rows: list[list[str]], y: np.ndarray, config: PairConfig, scale: bool, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression by adaptive gradient steps over hashed features; the last weight is the bias."""
    d = 1 << config.bits
    cols = np.concatenate([np.array([_hash(f, config.bits) for f in r], np.int64) for r in rows])
    lens = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), lens)
    used, cols = np.unique(cols, return_inverse=True)
    val = np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens) if scale else np.ones(len(cols))
    w, b = np.zeros(len(used)), 0.0
    pos = max(1, int(y.sum()))
    weight = np.where(y == 1, len(y) / (2 * pos), len(y) / (2 * max(1, len(y) - pos)))
    weight = weight / weight.sum()
    # steps scaled by each feature's own gradients, so that rare features are fitted as well as common ones
    sw, sb = np.full(len(used), 1e-12), 1e-12
    for _ in range(config.rounds):
        z = np.bincount(at, val * w[cols], minlength=len(rows)) + b
        g = weight * (1 / (1 + np.exp(-z)) - y)
        gw, gb = np.bincount(cols, val * g[at], minlength=len(used)) + penalty * w, g.sum()
        sw, sb = sw + gw * gw, sb + gb * gb
        w, b = w - 0.5 * gw / np.sqrt(sw), b - 0.5 * gb / np.sqrt(sb)
    out = np.zeros(d + 1)
    out[used], out[d] = w, b
    return out


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The widest stretch of thresholds with the best balance of precision and recall, a fifth of it above the lower end:
    real defects vary more than the synthetic ones do."""
    order = np.argsort(-scores)
    s, hit = scores[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    below = np.append(s[1:], s[-1] - 1)
    f1[s - below <= 1e-9] = -1  # equal scores can't be parted
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i = best[(s - below)[best].argmax()]
    return float(below[i] + 0.2 * (s[i] - below[i]))


def _cut(rng: random.Random, text: str) -> str | None:
    """A text stopped inside a word, sentence or code block, there also at the end of a line."""
    breaks = [m.start() for m in re.finditer("\n", text)] if "```" in text and rng.random() < 0.5 else []
    inner = [at for at in breaks if len(FENCE_MARK.findall(text[:at])) % 2 == 1]
    if inner:
        return text[: rng.choice(inner)]
    for _ in range(8):
        at = rng.randrange(max(1, len(text) // 5), len(text)) if len(text) > 12 else 0
        part = text[:at].rstrip() if rng.random() < 0.8 else text[:at]
        inside = len(FENCE_MARK.findall(part)) % 2 == 1
        if at and re.search(r"\w", part) and (inside or (re.search(r"[\w가-힣一-鿿,(`]$", part.rstrip()) and not re.search(r"\n\s*[-*] [^\n]*$", part))):
            return part + (rng.choice(["...", "…"]) if rng.random() < 0.2 else "")
    return None


def _copied(rng: random.Random, q: str) -> str:
    words = q.split(" ")
    kind = rng.randrange(7)
    if kind == 0:
        return q
    if kind == 1:
        return rng.choice(["> ", "Q: ", "질문: ", "Question: ", "**", "質問: ", "Frage: "]) + q
    if kind == 2:
        return rng.choice([f"{q}\n{q}", f"{q} {q}"])
    if kind == 3 and len(words) > 4:
        return " ".join(words[rng.randrange(1, 3) :])
    if kind == 4 and len(words) > 4:
        return " ".join(words[: -rng.randrange(1, 3)]) + "."
    if kind == 5 and len(words) > 4:
        i = rng.randrange(len(words))
        return " ".join([*words[:i], *words[i + 1 :]])
    return q.rstrip("?？.") + rng.choice(["", ".", "!", "??", " ?"])


def fit_pairs(pairs: list[tuple[str, str | None, str | None, str | None]], config: PairConfig = PairConfig()) -> PairModel:
    """A classifier out of unlabelled (question, content, payload answer, text) pairs.

    The pairs stand for sound ones; truncated, copied, swapped and refused answers are made from them. A first fit
    finds the defects among the pairs themselves, and the second is made without those. Thresholds are set on held-out
    synthetic pairs.
    """
    language = fit([t for p in pairs for t in (p[0], p[3]) if t], LanguageConfig())
    spoken = {t: language_of(language, t) for p in pairs for t in (p[0], p[3]) if t}
    sound, model = [p for p in pairs if p[3]], None
    for _ in range(2):
        rng = random.Random(config.seed)
        by_language: dict[int, list] = {}
        for p in sound:
            if spoken[p[0]].any():
                by_language.setdefault(int(spoken[p[0]].argmax()), []).append(p)
        rows = {d: ([], []) for d in DEFECTS}

        def add(label: str, features: list[str], y: int, rows=rows) -> None:
            rows[label][0].append(features)
            rows[label][1].append(y)

        for q, content, payload, text in sound:
            add("truncated", tail_features(content, payload), 0)
            add("truncated", tail_features(content, None), 0)
            if content and (part := _cut(rng, content)):
                # the payload goes on, is missing, or stops with the content
                add("truncated", tail_features(part, rng.choice([payload, None, part])), 1)
            add("copied_question", copy_features(q, text), 0)
            add("copied_question", copy_features(q, rng.choice([f"{q} {text}", f"> {q}\n\n{text}"])), 0)
            add("copied_question", copy_features(q, _copied(rng, q)), 1)
            add("wrong_language", language_features(spoken[q], spoken[text]), 0)
            others = [x for x, ps in by_language.items() if ps and x != int(spoken[q].argmax())]
            if others:
                other = rng.choice(by_language[rng.choice(others)])
                add("wrong_language", language_features(spoken[q], spoken[other[3]]), 1)
                quoted = sentences_of(other[3])
                if quoted and rng.random() < 0.2:
                    add("wrong_language", language_features(spoken[q], language_of(language, f'{text} "{rng.choice(quoted).strip()}"')), 0)
            said = sentences_of(text)
            for s in rng.sample(said, min(3, len(said))):
                add("refusal", ngrams(s), 0)
        for i in range(max(200, len(sound) // 2)):
            for s in sentences_of(synthetic_refusal(rng, LANGUAGES[i % len(LANGUAGES)] if i % 2 else ("en", "ko")[i // 2 % 2])):
                add("refusal", ngrams(s), 1)
        model = PairModel({}, {}, language, config)
        for label, (features, y) in rows.items():
            pick = np.random.default_rng(config.seed).random(len(y)) < config.held_out
            y = np.array(y)
            train = [f for f, p in zip(features, pick, strict=True) if not p]
            if not len(train) or not y.any():  # nothing to learn from: nothing is flagged
                model.weights[label], model.thresholds[label] = np.zeros((1 << config.bits) + 1), 1.0
                continue
            model.weights[label] = _train(train, y[~pick], config, label == "refusal", config.penalty if label == "refusal" else 1e-5)
            held = [f for f, p in zip(features, pick, strict=True) if p]
            scores = np.array([model.score(label, f) for f in held])
            # what is likelier sound than not is never flagged, however wide the gap
            model.thresholds[label] = max(0.0, _threshold(scores, y[pick])) if len(held) and y[pick].any() else 0.0
        sound = [p for p in sound if model.judge(*p)[0] is None]
    return model


# ---------------------------------------------------------------- operator


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """(turn_id, thread_id, question, content, payload_answer, text): each assistant turn directly after a non-blank user
    turn of its thread, system turns left out and blank ones keeping their place.

    A redelivered turn counts once, as last loaded; rows without a thread or id make no pair. Threads are ordered by
    segments of time, so a hot one isn't sorted in one task.
    """
    latest = (
        turns.where(F.col("thread_id").isNotNull() & F.col("id").isNotNull())
        .groupBy("id", "thread_id")
        .agg(F.max_by(F.struct("role", "content", "payload_json", "created_at"), F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))).alias("r"))
    )
    rows = latest.select(
        "thread_id", "id", event_time(F.col("r.created_at")).alias("ts"), role_of(F.col("r.role")).alias("said_by"),
        F.col("r.content").alias("content"), payload_answer(F.col("r.payload_json")).alias("payload_answer"),
        turn_text(F.col("r.content"), F.col("r.payload_json")).alias("text"),
    ).where("said_by <> 'system'")
    # only a user's words are needed by the turn after them
    rows = rows.withColumn("asked", F.when(F.col("said_by") == "user", F.col("text")))
    placed = ordered_lag(rows, "thread_id", "ts", "id", ["said_by", "asked"])
    return placed.where((F.col("said_by") == "assistant") & (F.col("prev.said_by") == "user") & ~is_blank(F.col("prev.asked"))).select(
        F.col("id").alias("turn_id"), "thread_id", F.col("prev.asked").alias("question"), "content", "payload_answer", "text"
    )


def broken_pairs(turns: DataFrame, config: PairConfig = PairConfig()) -> DataFrame:
    """(turn_id, defect, margin): each answer with a defect, and by how much its score is over the threshold.

    ``empty`` is told by rule; the other defects by linear classifiers on hashed n-grams and pair features. The
    classifiers are fitted on at most ``fit_pairs`` pairs, those that hash lowest; every pair is judged, whole. A pair
    has at most one defect. Without any pairs the result is empty.
    """
    pairs = question_answer_pairs(turns)
    size = F.length("question") + F.length("text")
    sample = (
        pairs.where(size <= config.fit_chars)
        .select(F.xxhash64("question", "text").alias("h"), "question", "content", "payload_answer", "text")
        .orderBy("h").limit(config.fit_pairs).drop("h")
    )
    model = fit_pairs([tuple(r) for r in sample.collect()], config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for turn, q, content, payload, text in zip(pdf["turn_id"], pdf["question"], pdf["content"], pdf["payload_answer"], pdf["text"], strict=True):
                defect, margin = model.judge(q, content, payload, text)
                if defect:
                    out.append((turn, defect, margin))
            yield pd.DataFrame(out, columns=["turn_id", "defect", "margin"])

    found = pairs.select("turn_id", "question", "content", "payload_answer", "text").mapInPandas(run, "turn_id long, defect string, margin double")
    return found.groupBy("turn_id", "defect").agg(F.max("margin").alias("margin"))
