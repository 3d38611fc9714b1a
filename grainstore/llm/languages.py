"""Problem 10: languages of documents and of their mixed-language spans."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "ja", "ko", "zh")

#: Notations of each language in labels, in lower case and without region or script (fixed values).
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "독일어", "ドイツ語", "德语"),
    "en": ("en", "eng", "english", "englisch", "inglés", "영어", "英語", "英语"),
    "es": ("es", "spa", "spanish", "español", "castellano", "spanisch", "스페인어", "スペイン語", "西班牙语"),
    "ja": ("ja", "jp", "jpn", "japanese", "japanisch", "日本語", "일본어", "日语"),
    "ko": ("ko", "kr", "kor", "korean", "koreanisch", "한국어", "韓国語", "韩语"),
    "zh": ("zh", "cn", "zho", "chi", "cmn", "chinese", "chinesisch", "中文", "中国語", "汉语", "漢語", "중국어"),
}

#: Function words that start the word scores off before any text is seen (fixed values).
SEEDS = {
    "de": "der die das und ist nicht ein eine einen mit von für auf dem den des wird werden wurde bei nach vor wenn dann aber nur noch sich auch aus wie wir sie es gibt keine im am zum zur bitte".split(),
    "en": "the a an and is are was were not with of for on in to from by that this it when then but only also as at we you which how why what does can should there be has have after before".split(),
    "es": "el la los las un una unos y es son no con de para en del al que se por como pero más también cuando desde hasta sin sobre ya lo su este esta hay está favor".split(),
    "ja": ["は", "が", "を", "に", "の", "で", "と", "も", "から", "まで", "です", "ます", "した", "する", "して", "この", "その", "ので", "たら"],
    "ko": ["은", "는", "이", "가", "을", "를", "에", "에서", "습니다", "입니다", "하는", "그리고"],
    "zh": ["的", "了", "是", "在", "不", "这", "这个", "把", "和", "会", "就", "之后", "以后", "之前", "我们", "什么", "请", "还是", "需要"],
}

WORD = re.compile(r"[가-힣ᄀ-ᇿㄱ-ㆎ]+|[ぁ-ゟ゠-ヿｦ-ﾟー]+|[一-鿿㐀-䶿豈-﫿々]+|[^\W\d_ㄱ-힣ᄀ-ᇿぁ-ヿ一-鿿㐀-䶿豈-﫿]+(?:['’][^\W\d_]+)?")
#: Parts of prose that belong to no language: code spans, addresses, paths, dotted and joined names.
NAMES = re.compile(r"`[^`\n]*`|\w+://\S+|(?<!\w)/?[A-Za-z0-9_\-]+(?:[/.][A-Za-z0-9_\-]+)+|\b[A-Za-z]+(?:[A-Z][a-z0-9]+)+\b|\b\w*[_\d]\w*\b")
FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t\r]*$|\Z)", re.M | re.S)
SETTING = re.compile(r"^\s*[\w.\-\"']+\s*[=:]\s*\S+\s*$|^\s*(?:[-*]\s*)?`[^`]*`\s*[:=].{0,40}$")
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?://|#!|\*|@\w+|(?:import|package|public|private|protected|def|class|const|let|var|for|if|return|select|insert|create)\b.*[(){};=])")
SENTENCE_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|[。！？]+[」』”]*")

_OUT = -9.0  # score of a language that the word's script excludes; finite, so that a foreign letter stays inside its span


@dataclass(frozen=True)
class LanguageConfig:
    """``switch``: what a change of language costs; ``words`` that the counts of a table are scaled to; ``rounds``: times the scores are fitted anew to what they label; ``longest`` n-gram of a word."""

    switch: float = 6.0
    words: int = 250_000
    rounds: int = 3
    longest: int = 4
    cap: float = 4.0


@dataclass
class LanguageModel:
    """Log-probabilities of the n-grams of words for each language."""

    grams: dict[str, np.ndarray]
    unseen: np.ndarray
    config: LanguageConfig
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, word: str) -> np.ndarray:
        """One value per language, best at or above zero; ``_OUT`` where the script excludes it."""
        got = self.cache.get(word)
        if got is None:
            got = self._score(word)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def _score(self, word: str) -> np.ndarray:
        allowed = candidates(word)
        total = np.zeros(len(LANGUAGES))
        if allowed.sum() > 1:
            for g in _grams(word, self.config.longest):
                total += self.grams.get(g, self.unseen)
            total -= total[allowed].mean()
            total = np.clip(total, -self.config.cap, self.config.cap)
        else:
            total[:] = self.config.cap
        total[~allowed] = _OUT
        return total

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}


def candidates(word: str) -> np.ndarray:
    """Which languages the script of a word leaves; a word is of one script."""
    o = ord(word[0])
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF or 0x3130 <= o <= 0x318F:
        names = ("ko",)
    elif 0x3040 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        names = ("ja",)
    elif 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or o == 0x3005:
        names = ("ja", "zh")
    elif o < 0x250:
        names = ("de", "en", "es")
    else:
        names = ()
    return np.array([x in names for x in LANGUAGES])


def _grams(word: str, longest: int) -> list[str]:
    if ord(word[0]) >= 0x3000:
        return [word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)]
    w = f"<{word}>"
    return [w] + [w[i : i + n] for n in range(2, longest + 1) for i in range(len(w) - n + 1)]


def prose_lines(text: str) -> list[tuple[int, str]]:
    """(start, line) of the lines outside code and settings, with names that belong to no language blanked in place."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = FENCE.sub(blank, text) if "```" in text or "~~~" in text else text
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip() and not SETTING.match(line) and not CODE_LINE.search(line):
            out.append((at, NAMES.sub(blank, line)))
        at += len(line) + 1
    return out


def normal(text: str) -> str:
    """Canonical composition, so that Hangul and accents have one form; positions count in this form."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


_AT = {x: i for i, x in enumerate(LANGUAGES)}
_KNOWN = {w: np.array([w in SEEDS[x] for x in LANGUAGES], float) for x in LANGUAGES for w in SEEDS[x]}
_UNIT = 1_000_000  # of a weight; whole numbers have one sum in any order


def _lines_of(text: str) -> Iterator[Counter]:
    """The words of each line of prose that has at least four."""
    for _, line in prose_lines(normal(text)):
        words = WORD.findall(line.lower())
        if len(words) >= 4:
            yield Counter(words)


def _label_of(words: Counter, model: LanguageModel | None) -> int:
    """The language of a line by the model, or without one by function words and script; -1 if there are none."""
    if model is not None:
        return int(np.argmax(sum(np.maximum(model.score(w), -4.0) * n for w, n in words.items())))
    votes = np.zeros(len(LANGUAGES))
    for w, n in words.items():
        allowed = candidates(w)
        if allowed.sum() == 1:
            votes += 3 * n * allowed
        elif w in _KNOWN:
            votes += n * _KNOWN[w] * allowed
        elif ord(w[0]) >= 0x3000:
            votes[_AT["zh"]] += 0.3 * n * sum(c in "的了是在不这把和会就请" for c in w)
            votes[_AT["zh"]] += 0.1 * n * len(w)
    return int(votes.argmax()) if votes.max() > 0 else -1


def _weights(counted: Iterator[tuple[int, str, int]], longest: int, scale: float = 1.0) -> Counter:
    """The weight of each (gram, label) of words counted by label, the counts taken times ``scale``."""
    out: Counter = Counter()
    for label, w, n in counted:
        if candidates(w)[label]:
            unit = round(min(n * scale, 50) ** 0.5 * _UNIT)
            for g in _grams(w, longest):
                out[g, label] += unit
    return out


def _model(weights: Iterator[tuple[str, int, int]], config: LanguageConfig) -> LanguageModel:
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES), np.int64))
    for x, words in SEEDS.items():
        for w in words:
            for g in _grams(w, config.longest):
                counts[g][_AT[x]] += 3 * _UNIT
    for g, label, n in weights:
        counts[g][label] += n
    total = sum(counts.values()) / _UNIT + 0.5 * len(counts)
    return LanguageModel({g: np.log((c / _UNIT + 0.5) / total) for g, c in counts.items()}, np.log(0.5 / total), config)


def fit(texts: list[str], config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Word scores out of unlabelled texts: lines are labelled by function words and script, then by the scores
    fitted to them, ``rounds`` times over."""
    lines = [words for t in texts for words in _lines_of(t)]
    model = None
    for _ in range(config.rounds):
        per: Counter = Counter()
        for words in lines:
            if (label := _label_of(words, model)) >= 0:
                for w, n in words.items():
                    per[label, w] += n
        weights = _weights(((x, w, n) for (x, w), n in per.items()), config.longest)
        model = _model(((g, x, n) for (g, x), n in weights.items()), config)
    return model


def _words_by_label(model: LanguageModel | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            per: Counter = Counter()
            for text in pdf["text"]:
                for words in _lines_of(text):
                    if (label := _label_of(words, model)) >= 0:
                        for w, n in words.items():
                            per[label, w] += n
            yield pd.DataFrame([(x, w, n) for (x, w), n in per.items()], columns=["label", "word", "n"])

    return run


def _weights_of_words(longest: int, scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = _weights(zip(pdf["label"].tolist(), pdf["word"], pdf["n"].tolist(), strict=True), longest, scale)
            yield pd.DataFrame([(g, x, n) for (g, x), n in found.items()], columns=["gram", "label", "weight"])

    return run


def fit_documents(documents: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """``fit`` to all texts of the table: each of the ``rounds`` reads it once; the grams go to the driver with their weights.

    Counts are scaled to those of ``words`` words, or lines labelled wrongly would fill up every word in every language.
    """
    from grainstore.session import written

    texts = documents.where(F.length("text") > 0).select("text")
    model = None
    for _ in range(config.rounds):
        words = written(texts.mapInPandas(_words_by_label(model), "label int, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")), "words")
        scale = min(1.0, config.words / max(1, words.agg(F.sum("n")).first()[0] or 0))
        grams = words.mapInPandas(_weights_of_words(config.longest, scale), "gram string, label int, weight long").groupBy("gram", "label").agg(F.sum("weight").alias("weight"))
        model = _model(((r.gram, r.label, r.weight) for r in grams.collect()), config)
    return model


def viterbi(emissions: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best labels of several sequences of per-word scores, one step at a time for all sequences together."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order])
    k, longest = len(LANGUAGES), int(lengths.max(initial=0))
    live = [int((lengths > t).sum()) for t in range(longest)]
    back: list[np.ndarray] = []
    best = np.zeros((len(order), k))
    flat = [emissions[i] for i in order]
    stacked = np.concatenate(flat) if flat else np.zeros((0, k))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    stay = np.arange(k, dtype=np.int8)
    for t in range(longest):
        n = live[t]
        e = stacked[starts[:n] + t]
        if t == 0:
            best[:n] = e
            back.append(np.tile(stay, (n, 1)))
            continue
        prev = best[:n]
        top = prev.argmax(axis=1)
        leave = prev[np.arange(n), top][:, None] - switch
        keep = prev >= leave
        back.append(np.where(keep, stay, top[:, None].astype(np.int8)))
        best[:n] = np.where(keep, prev, leave) + e
    labels = np.zeros(len(stacked), np.int8)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        labels[starts[:n] + t] = state[:n]
        state[:n] = back[t][np.arange(n), state[:n]]
    out: list[np.ndarray] = [None] * len(order)  # type: ignore[list-item]
    for place, i in enumerate(order):
        out[i] = labels[starts[place] : starts[place] + lengths[place]]
    return out


@dataclass
class Labelled:
    """Words of a text with their places and languages, and the languages in the text."""

    starts: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    sure: np.ndarray
    languages: dict[str, float]


def label_texts(model: LanguageModel, texts: list[str]) -> list[Labelled]:
    """Spans by Viterbi over the words' scores; a language is in a text if a line has two sentences in it.

    A text without such a line has the language of most of its prose; a text without words has none.
    """
    prepared, rows, numbers, table = [], [], {}, []
    for text in texts:
        lines, places, line_of, row = prose_lines(normal(text)), [], [], []
        for number, (base, line) in enumerate(lines):
            for m in WORD.finditer(line.lower()):
                n = numbers.get(m.group())
                if n is None:
                    n = numbers[m.group()] = len(table)
                    table.append(model.score(m.group()))
                lo, hi = m.span()
                places.append((base + lo, base + hi))
                row.append(n)
                line_of.append(number)
        spans = np.array(places, np.int64).reshape(-1, 2)
        prepared.append((lines, spans[:, 0], spans[:, 1], np.array(line_of, np.int64)))
        rows.append(np.array(row, np.int64))
    scored = np.array(table).reshape(-1, len(LANGUAGES))
    emissions = [scored[r] for r in rows]
    out = []
    for (lines, starts, ends, line_of), scores, labels in zip(prepared, emissions, viterbi(emissions, model.config.switch), strict=True):
        shifted = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        own = shifted[np.arange(len(labels)), labels] / shifted.sum(axis=1) if len(labels) else np.zeros(0)
        # a word alone says little; what counts is the evidence of the words around it
        sure = own
        if len(own) > 1:
            log_odds = np.log(np.clip(own, 1e-6, 1 - 1e-6) / (1 - np.clip(own, 1e-6, 1 - 1e-6)))
            near = np.convolve(log_odds, np.ones(9))[4 : 4 + len(own)]
            sure = 1 / (1 + np.exp(-np.clip(near, -30, 30)))
        weight = ends - starts
        in_text: dict[int, list[float]] = defaultdict(list)
        for number, (base, line) in enumerate(lines):
            lo, hi = np.searchsorted(line_of, [number, number + 1])
            if lo == hi:
                continue
            cuts = np.array([base + m.end() for m in SENTENCE_END.finditer(line)], np.int64)
            sentence = np.searchsorted(cuts, starts[lo:hi], side="right")
            votes = np.zeros((int(sentence.max()) + 1, len(LANGUAGES)))
            np.add.at(votes, (sentence, labels[lo:hi].astype(np.int64)), weight[lo:hi])
            held = votes.sum(axis=1) > 0
            if held.sum() < 2:
                continue
            per_sentence = np.bincount(votes[held].argmax(axis=1), minlength=len(LANGUAGES))
            chosen = np.flatnonzero(per_sentence >= 2)
            for i in chosen if len(chosen) else [int(votes.sum(axis=0).argmax())]:
                mine = labels[lo:hi] == i
                in_text[int(i)].append(float(sure[lo:hi][mine].mean()) if mine.any() else 0.5)
        if not in_text and len(labels):
            i = int(np.bincount(labels.astype(np.int64), weights=weight, minlength=len(LANGUAGES)).argmax())
            in_text[i].append(float(sure[labels == i].mean()))
        out.append(Labelled(starts, ends, labels, sure, {LANGUAGES[i]: sum(v) / len(v) for i, v in sorted(in_text.items())}))
    return out


def named_language(label: Column) -> Column:
    """The language a label names in any of its notations; null where it names none of ``LANGUAGES``."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^\s+|\s+$", ""))
    base = F.regexp_replace(plain, r"[-_ (.@].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(base.isin(*names), code).otherwise(out)
    return out


_SPANS = "doc_id long, span int, char_start int, char_end int, lang string, confidence double"


def _label(model: LanguageModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo in range(0, len(texts), 256):
                rows = []
                for doc, text, found in zip(ids[lo : lo + 256], texts[lo : lo + 256], label_texts(model, texts[lo : lo + 256]), strict=True):
                    rows.append((doc, 0, 0, len(normal(text)), ",".join(found.languages), round(min(found.languages.values(), default=0.0), 4)))
                    if len(found.labels):
                        cut = np.flatnonzero(np.diff(found.labels)) + 1
                        for n, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(found.labels)], strict=True)):
                            rows.append((doc, n + 1, int(found.starts[a]), int(found.ends[b - 1]), LANGUAGES[found.labels[a]], round(float(found.sure[a:b].mean()), 4)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPANS.split(", ")])

    return run


def language_spans(documents: DataFrame, config: LanguageConfig = LanguageConfig(), model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, span, char_start, char_end, lang, confidence): the stretches of each text in one language, from span 1.

    Span 0 is the whole document: ``lang`` holds all languages in the text, joined by commas (empty where there are
    none), ``confidence`` that of the least certain. Script ranges leave each word its candidates; words are scored by
    n-grams; Viterbi with a penalty per switch labels them. Positions count code points of the NFC form. Null and
    empty texts have span 0 alone. The scores are fitted to all texts; every text is labelled whole,
    in its own partition, without a shuffle.
    """
    model = model or fit_documents(documents, config)
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(_label(model), _SPANS)


def mislabelled(documents: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(doc_id, lang, confidence): one row per language in the text of documents whose label is missing, meaningless
    or names a language that isn't in the text, and of documents with two or more languages."""
    model = fit_documents(documents, config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            ids, named = pdf["doc_id"].tolist(), pdf["named"].tolist()
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo in range(0, len(texts), 256):
                for i, found in enumerate(label_texts(model, texts[lo : lo + 256]), lo):
                    if len(found.languages) > 1 or named[i] not in found.languages:
                        rows += [(ids[i], x, round(c, 4)) for x, c in found.languages.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "confidence"])

    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", named_language(F.col("lang")).alias("named"))
    return rows.mapInPandas(run, "doc_id long, lang string, confidence double").groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"))
